"""A crawl over known pages: the frontier of each depth is a table, levels follow one another.

First in, first out order never mixes depths, so a level can be worked on as a whole: a URL's place is the path of
places that led to it, which orders a level without numbering it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import urls
from skein.sources.tables import settled

# Bytes of a page, attempts, a crawl's depth unless it says otherwise, seconds between requests to an origin.
MOST_BYTES, ATTEMPTS, DEPTH, PERIOD = 5 << 20, 3, 10, 2.0
HTML_TYPES = ("text/html", "application/xhtml+xml")


def outcome(status: Column, content_type: Column, size: Column) -> Column:
    """What a fetch comes to: ok, blocked, too_large or failed."""
    html = F.btrim(F.lower(F.substring_index(content_type, ";", 1))).isin(*HTML_TYPES)
    return F.when(status == 403, "blocked").when((status < 200) | (status > 299) | ~html | status.isNull(), "failed").when(size > MOST_BYTES, "too_large").otherwise("ok")


def follow_redirects(hops: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """url and final_url of each start over hops (src, location); null after too many hops or without a location."""
    steps = hops.select(F.col("src").alias("at"), urls.normalize(urls.resolve(F.col("src"), F.col("location"))).alias("to"))
    out = starts.select("url", F.col("url").alias("at"))
    for _ in range(most):
        out = out.join(steps.withColumn("hop", F.lit(True)), "at", "left").select("url", F.when(F.col("hop"), F.col("to")).otherwise(F.col("at")).alias("at"))
    left = out.join(steps.select("at").distinct().withColumn("more", F.lit(True)), "at", "left")
    return left.select("url", F.when(F.col("more").isNull(), F.col("at")).alias("final_url"))


def retry_wait(status: Column, attempt: Column, retry_after: Column, now: Column, jitter: Column) -> Column:
    """Milliseconds before the next attempt (numbered from 0), null where there is none. A null status stands for a
    request that got no answer, which is made again like one with a server's error."""
    backoff = F.pow(F.lit(2), attempt) * 1000 + jitter
    again = F.when(status.isin(429, 503), F.coalesce(retry_after_seconds(retry_after, now) * 1000, backoff)).when(status.isNull() | (status >= 500), backoff)
    return F.when(attempt + 1 < ATTEMPTS, again).cast("long")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds from a Retry-After header, a number or an HTTP date; null for a past or unreadable one."""
    number = value.try_cast("bigint")
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz")))
    return F.when(number >= 0, number).when(at > now, at - now)


def politeness(arrivals: DataFrame, origin: str = "origin", at: str = "arrival", tie: str = "id", period: float = PERIOD) -> DataFrame:
    """arrivals (seconds) with start: one request at a time and one a period for each origin, in order of arrival."""
    line = Window.partitionBy(origin).orderBy(at, tie)
    n = F.row_number().over(line)
    rows = arrivals.withColumn("_n", n)
    return rows.withColumn("start", F.col("_n") * period + F.max(F.col(at) - F.col("_n") * period).over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


@dataclass
class Crawl:
    pages: DataFrame  # url, final_url, depth, outcome: all that was visited
    stats: DataFrame


def enqueue(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """The first of each URL (by ord) that is no trap and not in known (url)."""
    rows = candidates.filter(~F.coalesce(urls.is_crawl_trap(F.col("url")), F.lit(False)))
    return rows.groupBy("url").agg(F.min("ord").alias("ord")).join(known.select("url"), "url", "left_anti")


def crawl(spark: SparkSession, fetches: DataFrame, links: DataFrame, seed: str, max_pages: int, max_depth: int = DEPTH, same_domain: bool = True, sitemap: DataFrame | None = None, disallowed: DataFrame | None = None) -> Crawl:
    """Breadth first from seed over fetches (url, final_url, outcome: ok, blocked or failed) and links (url, pos,
    target). sitemap (url, pos) comes at depth 1 before the seed's links; disallowed (url) is never fetched. A blocked
    page blocks its origin from there on; max_pages counts pages that were got, in order."""
    start = spark.sql("SELECT :u AS url", {"u": seed}).select(urls.normalize(F.col("url")).alias("url"))
    home = start.select(urls.origin(F.col("url"))).collect()[0][0]
    if home is None or start.filter(urls.is_crawl_trap(F.col("url"))).count():
        raise ValueError("no page that can be crawled")
    one = lambda c: F.array(c.cast("long"))
    level = start.withColumn("ord", one(F.lit(0)))
    none = start.limit(0)
    visited, blocked, done = none, none.withColumnRenamed("url", "origin"), None
    got = skipped_depth = 0
    for depth in range(max_depth + 2):
        if depth > max_depth:
            skipped_depth = level.count()
            break
        rows = level.join(fetches, "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed"))).withColumn("final_url", F.coalesce("final_url", "url")).withColumn("origin", urls.origin(F.col("url")))
        if disallowed is not None:
            rows = rows.join(disallowed.select("url").distinct().withColumn("_no", F.lit(True)), "url", "left").withColumn("outcome", F.when(F.col("_no"), "robots").otherwise(F.col("outcome"))).drop("_no")
        rows = settled(rows.join(blocked, "origin", "left_anti"))
        # what an earlier page of this level was redirected to counts as visited
        moved = rows.filter("outcome = 'ok' AND final_url <> url").select(F.col("final_url").alias("f"), F.col("ord").alias("o"))
        rows = rows.join(moved, (F.col("url") == F.col("f")) & (F.col("ord") > F.col("o")), "left_anti")
        stop = rows.filter("outcome = 'blocked'").groupBy("origin").agg(F.min("ord").alias("stop"))
        rows = rows.join(stop, "origin", "left").filter(F.col("stop").isNull() | (F.col("ord") <= F.col("stop"))).drop("stop")
        rows = rows.withColumn("outcome", F.when((F.col("outcome") == "ok") & F.coalesce(urls.is_crawl_trap(F.col("final_url")), F.lit(False)), "trap").otherwise(F.col("outcome")))
        last = rows.filter("outcome = 'ok'").select("ord").orderBy("ord").limit(max_pages - got).agg(F.count("*").alias("n"), F.max("ord").alias("last")).collect()[0]
        if got + last["n"] >= max_pages:
            cut = F.array(*[F.lit(x).cast("long") for x in last["last"]]) if last["n"] else None
            rows = rows.filter(F.col("ord") <= cut) if cut is not None else rows.limit(0)
        rows = settled(rows.withColumn("depth", F.lit(depth).cast("long")))
        got += last["n"]
        done = rows if done is None else done.unionByName(rows)
        blocked = blocked.unionByName(rows.filter("outcome = 'blocked'").select("origin")).distinct()
        visited = settled(visited.unionByName(rows.select("url")).unionByName(rows.filter("outcome = 'ok'").select(F.col("final_url").alias("url"))).distinct())
        out = rows.filter("outcome = 'ok'").select(F.col("final_url").alias("url"), "ord").join(links, "url").select(F.col("target").alias("url"), F.concat("ord", F.array(F.lit(1).cast("long"), F.col("pos").cast("long"))).alias("ord"))
        if same_domain:
            out = out.filter(urls.origin(F.col("url")) == home)
        if depth == 0 and sitemap is not None:
            out = out.unionByName(sitemap.select("url", F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("pos").cast("long")).alias("ord")))
        if got >= max_pages:
            break
        level = settled(enqueue(out, visited))
        if not level.take(1):
            break
    n = lambda k: F.sum((F.col("outcome") == k).cast("long"))
    stats = done.agg(F.coalesce(n("ok"), F.lit(0)).alias("crawled"), F.coalesce(n("failed"), F.lit(0)).alias("failed"), F.coalesce(n("blocked"), F.lit(0)).alias("blocked"), F.coalesce(n("robots"), F.lit(0)).alias("skipped_robots"), F.lit(skipped_depth).cast("long").alias("skipped_depth"))
    return Crawl(done.select("url", "final_url", "depth", "outcome", "ord"), stats)
