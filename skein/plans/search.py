"""Requests end to end: prepare, retrieve three lists, fuse, boost, keep one chunk a page, spread over hosts, cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import urls
from skein.operators import index, ranking, retrieval

# What a similarity request takes as usual, and how many candidates it looks at.
THRESHOLD, MATCHES = 0.6, 5


@dataclass
class Prepared:
    query: str
    limit: int
    offset: int
    candidates: int


def prepare(query: str, limit: int = 10, offset: int = 0) -> Prepared:
    """White space collapsed, limit and offset within their bounds. ValueError for a blank query."""
    query = " ".join(query.split())
    if not query:
        raise ValueError("query must not be blank")
    limit, offset = max(0, min(limit, retrieval.MOST_LIMIT)), max(0, min(offset, retrieval.MOST_OFFSET))
    return Prepared(query, limit, offset, retrieval.candidate_limit(limit, offset))


@dataclass
class Result:
    results: DataFrame
    total: DataFrame
    panel: DataFrame


def search(stored: DataFrame, query: str, limit: int = 10, offset: int = 0, domain_rank: DataFrame | None = None, embedder=retrieval.hash_embedding, postings: str | None = None) -> Result:
    """A page of results over points (point_id, dense, title_text, body_text, source_url, page_title, ...). Candidates
    are at most 1000, so what follows retrieval works on a few rows. With postings, a folder that store_postings has
    written for these points, words are looked up there and no text is split."""
    p = prepare(query, limit, offset)
    k = max(p.candidates, 1)
    words = lambda field: retrieval.bm25_stored(stored.sparkSession, f"{postings}/{field}", p.query, "point_id") if postings else retrieval.bm25(stored, "point_id", f"{field}_text", p.query)
    lists = {
        "dense": retrieval.top(retrieval.dense(stored, "point_id", "dense", embedder("query: " + p.query)), "point_id", k),
        "title": retrieval.top(words("title"), "point_id", k),
        "body": retrieval.top(words("body"), "point_id", k),
    }
    fused = retrieval.fuse(lists, "point_id", k)
    fused = fused if p.candidates else fused.limit(0)
    rows = stored.select("point_id", "source_url", "page_title", "description", "chunk_heading", "chunk_content", "crawled_at").join(F.broadcast(fused), "point_id")
    rows = ranking.boost(rows.filter(urls.is_searchable(F.col("source_url"))), p.query, domain_rank)
    best = ranking.best_chunks(rows, [F.desc("boosted"), F.asc("rank"), F.asc("point_id")])
    placed = ranking.diversify(best)
    page = ranking.page_of(placed, p.limit, p.offset).select("place", "source_url", "page_title", "description", "chunk_heading", "chunk_content", "crawled_at", F.col("boosted").alias("score")).orderBy("place")
    return Result(page, placed.agg(F.count("*").alias("total")), ranking.knowledge_panel(placed, p.offset))


def store_postings(stored: DataFrame, path: str, parts: int | None = None) -> None:
    """The postings of the titles and bodies of points, in folders of path, as search reads them."""
    for field in ("title", "body"):
        retrieval.store_postings(stored, "point_id", f"{field}_text", f"{path}/{field}", parts)


def similar(stored: DataFrame, text: str, threshold: float = THRESHOLD, embedder=retrieval.hash_embedding) -> DataFrame:
    """One row: is_similar, score (the highest, 0 without any) and matches at or above the threshold, best first."""
    best = retrieval.top(retrieval.dense(stored, "point_id", "dense", embedder("query: " + text)), "point_id", MATCHES)
    rows = stored.select("point_id", "source_url", "page_title", "chunk_content").join(F.broadcast(best), "point_id")
    match = F.when(F.col("score") >= threshold, F.struct("rank", "score", "source_url", "page_title", "chunk_content"))
    score = F.coalesce(F.max("score"), F.lit(0.0))
    return rows.agg((score >= threshold).alias("is_similar"), score.alias("score"), F.array_sort(F.collect_list(match)).alias("matches"))


def page(stored: DataFrame, url: str) -> DataFrame:
    return index.page_chunks(stored, url)


def count(stored: DataFrame) -> DataFrame:
    """The number of chunks, not of pages."""
    return stored.agg(F.count("*").alias("count"))


def empty_index(spark, size: int = 384) -> DataFrame:
    """No chunks, with the columns of an index and vectors of size numbers."""
    schema = "point_id string, source_url string, page_title string, description string, chunk_index long, chunk_heading string, chunk_content string, tags array<string>, categories array<string>, paid double, payload_score double, crawled_at long, page_version string, passage string, title_text string, body_text string, dense array<float>"
    return spark.createDataFrame([], schema).withMetadata("dense", {"size": size})


def ensure_table(spark, name: str = "web_pages") -> None:
    """Create the index's table if it isn't there, bucketed by page so that upserts meet without a shuffle."""
    if not spark.catalog.tableExists(name):
        empty_index(spark).write.bucketBy(64, "source_url").format("parquet").saveAsTable(name)
