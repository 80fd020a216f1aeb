"""Sitemaps: files to entries, and the bounded walk over sitemap indexes."""

from __future__ import annotations

import gzip
import io
from datetime import UTC, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import urls
from skein.sources.tables import reach_workers

# Files of a walk, levels below the first, URLs, bytes of a file.
MOST_FILES, MOST_DEPTH, MOST_URLS, MOST_BYTES = 20, 3, 10_000, 10 << 20


def when(text: str | None) -> int | None:
    """Epoch seconds of a W3C date, UTC where it names no zone; None if it is none."""
    try:
        at = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def parse(data: bytes, packed: bool) -> list[tuple[str, str, int | None]]:
    """(kind, loc, lastmod) of each entry; nothing of a file that is broken or too large."""
    try:
        if packed:
            with gzip.open(io.BytesIO(data)) as f:
                data = f.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            return []
        out = []
        for node in ElementTree.fromstring(data):
            kind = node.tag.rpartition("}")[2]
            fields = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in node}
            if kind in ("url", "sitemap") and "://" in fields.get("loc", ""):
                out.append((kind, fields["loc"], when(fields.get("lastmod"))))
        return out
    except (OSError, EOFError, ElementTree.ParseError):
        return []


def entries(files: DataFrame) -> DataFrame:
    """sitemap_url, kind, loc, lastmod and pos from files (url, content, content_type); gzip by name or type."""

    reach_workers(files.sparkSession)
    def run(batches):
        for b in batches:
            out = []
            for url, content, kind in zip(*(c.to_pylist() for c in b.columns)):
                packed = url.partition("?")[0].endswith(".gz") or (kind or "").partition(";")[0].strip() == "application/gzip"
                out += [(url, *e, i) for i, e in enumerate(parse(content or b"", packed))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["sitemap_url", "kind", "loc", "lastmod", "pos"])

    return files.select("url", "content", "content_type").mapInArrow(run, "sitemap_url string, kind string, loc string, lastmod long, pos long")


def discover(entry_rows: DataFrame, seed: str, declared: list[str], max_pages: int) -> DataFrame:
    """url and pos of the pages that sitemaps name, for a crawl from seed: own origin only, newest first in a file,
    files breadth first. Only file names, MOST_FILES at most, come to the driver."""
    spark = entry_rows.sparkSession
    limit = min(4 * max_pages, MOST_URLS)
    home = spark.sql("SELECT :s AS s", {"s": seed}).select(urls.origin(F.col("s"))).collect()[0][0]
    mine = entry_rows.filter(urls.origin(F.col("loc")) == home)
    newest = [F.desc_nulls_last("lastmod"), F.asc("pos")]
    first = declared or [f"{home}/sitemap.xml"]
    at_home = spark.createDataFrame([(u, i) for i, u in enumerate(first)], "u string, i int").filter(urls.origin(F.col("u")) == home).orderBy("i").collect()
    todo, seen, pages = [(r["u"], 0) for r in at_home], [], 0
    while todo and len(seen) < MOST_FILES and pages < limit:
        url, depth = todo.pop(0)
        if depth > MOST_DEPTH:
            break
        if url in seen:
            continue
        seen.append(url)
        own = mine.filter(F.col("sitemap_url") == url)
        pages += own.filter("kind = 'url'").limit(limit).count()
        if depth < MOST_DEPTH:
            todo += [(r["loc"], depth + 1) for r in own.filter("kind = 'sitemap'").orderBy(*newest).limit(MOST_FILES).collect()]
    files = spark.createDataFrame([(u, i) for i, u in enumerate(seen)], "sitemap_url string, file int")
    found = mine.filter("kind = 'url'").join(F.broadcast(files), "sitemap_url").orderBy("file", *newest).limit(limit)
    found = found.withColumn("n", F.row_number().over(Window.orderBy("file", *newest))).withColumn("url", urls.normalize(F.col("loc")))
    return found.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("n").cast("long").alias("pos"))
