"""Boosts on retrieved rows, then pages: best chunk of a page, spread over hosts, cut to a page of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text, urls

# What each property of a result adds.
URL_LENGTH, ROOT, DEPTH, COVERAGE, ROOT_MATCH, POPULARITY, LAST_RANK, SPREAD = 0.5, 1.25, 0.12, 3.0, 2.0, 1.0, 1_000_000, 5
DIGITS = 9


def coverage(terms: Column, title: Column, url: Column) -> Column:
    """The share of the terms (repeats count) among the title's and the whole URL's tokens; 0 without terms."""
    known = F.concat(text.tokens(title), text.tokens(url))
    hit = F.size(F.filter(terms, lambda t: F.array_contains(known, t)))
    return F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(0.0)


def root_host_match(terms: Column, title: Column, url: Column) -> Column:
    """Whether url is a site's root and all terms, at least one, are tokens of its host or title."""
    known = F.concat(text.tokens(title), text.tokens(urls.host(url)))
    return urls.parses(url) & urls.is_domain_root(url) & (F.size(terms) > 0) & F.forall(terms, lambda t: F.array_contains(known, t))


def popularity(rank: Column) -> Column:
    """1 for rank 1 down to 0 for LAST_RANK and beyond; 0 for null."""
    r = F.least(F.greatest(rank, F.lit(1)), F.lit(LAST_RANK)).cast("double")
    return F.when(rank.isNotNull(), POPULARITY * (1 - F.log(r) / F.log(F.lit(float(LAST_RANK))))).otherwise(0.0)


def parse_domain_ranks(lines: DataFrame, col: str = "value", pos: str = "pos") -> DataFrame:
    """host and rank of lines "rank,domain"; lines without a rank go, of a host's lines the last counts."""
    parts = F.split(F.col(col), ",", 2)
    rows = lines.select(F.expr(f"try_cast(trim(split({col}, ',', 2)[0]) AS INT)").alias("rank"), urls.normalize_host(F.get(parts, 1)).alias("host"), F.col(pos))
    return rows.filter("rank IS NOT NULL AND host IS NOT NULL").groupBy("host").agg(F.max_by("rank", pos).alias("rank"))


def boost(rows: DataFrame, query: str, domain_rank: DataFrame | None = None, base: str = "score", most_broadcast: int = LAST_RANK) -> DataFrame:
    """rows (source_url, page_title, base) with boosted, the base score plus all boosts. domain_rank (host, rank) is
    broadcast up to most_broadcast hosts, else joined by a shuffle."""
    url, title = F.col("source_url"), F.col("page_title")
    terms = text.tokens(F.lit(query))
    if domain_rank is not None:
        ranks = domain_rank.select(F.col("host").alias("_host"), F.col("rank").alias("_rank"))
        small = ranks.limit(most_broadcast + 1).count() <= most_broadcast
        rows = rows.withColumn("_host", urls.normalize_host(urls.host(url))).join(F.broadcast(ranks) if small else ranks, "_host", "left").drop("_host")
    else:
        rows = rows.withColumn("_rank", F.lit(None).cast("int"))
    total = F.col(base) + URL_LENGTH / urls.url_bytes(url) + F.when(urls.is_domain_root(url), ROOT).otherwise(0.0) + F.when(root_host_match(terms, title, url), ROOT_MATCH).otherwise(0.0) - DEPTH * urls.path_depth(url) + COVERAGE * coverage(terms, title, url) + popularity(F.col("_rank"))
    return rows.withColumn("boosted", F.round(total, DIGITS)).drop("_rank")


def best_chunks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each source_url in the given order, with pos, its place from 1 among them."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_url").orderBy(*order))).filter("_n = 1").drop("_n")
    return first.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


def diversify(rows: DataFrame, spread: int = SPREAD) -> DataFrame:
    """rows with place: the best page of each of the first ``spread`` hosts comes first, all others keep their order."""
    rows = rows.withColumn("_h", urls.diversity_host(F.col("source_url")))
    rows = rows.withColumn("_lead", (F.row_number().over(Window.partitionBy("_h").orderBy("pos")) == 1).cast("int"))
    rows = rows.withColumn("_front", (F.col("_lead") == 1) & (F.sum("_lead").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) <= spread))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_front"), "pos")).cast("long")).drop("_h", "_lead", "_front")


def page_of(placed: DataFrame, limit: int, offset: int) -> DataFrame:
    return placed.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def knowledge_panel(placed: DataFrame, offset: int) -> DataFrame:
    """The first page if it has a title and a description, on the first page of results only."""
    ok = (F.btrim("page_title") != "") & (F.col("page_title") != "No Title") & (F.btrim("description") != "")
    return placed.filter((F.col("place") == 1) & ok & F.lit(offset == 0)).select(F.col("page_title").alias("title"), "description", F.col("source_url").alias("url"))
