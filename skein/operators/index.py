"""The versioned chunk index: identity of versions and points, upsert, removal of stale versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the name space of URLs for version 5 UUIDs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def page_versions(chunks: DataFrame, key: str = "source_url") -> DataFrame:
    """key and page_version: SHA-256 over title, heading, description, content and a zero byte of each chunk in order."""
    part = F.concat(F.coalesce("page_title", F.lit("")), F.coalesce("chunk_heading", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("chunk_content", F.lit("")), F.char(F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("chunk_index").alias("i"), part.alias("part"))))
    return chunks.groupBy(key).agg(ordered.alias("parts")).select(key, F.sha2(F.array_join(F.transform("parts", lambda x: x["part"]), ""), 256).alias("page_version"))


def point_id(url: Column, version: Column, index: Column) -> Column:
    """The version 5 UUID of url, version and index, joined by zero bytes, in the name space of URLs."""
    name = F.concat_ws("\0", url, version, index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def points(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks with page_version, point_id and the texts that are embedded and indexed."""
    out = chunks.join(versions, "source_url")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.withColumns({
        "point_id": point_id(F.col("source_url"), F.col("page_version"), F.col("chunk_index")),
        "passage": F.concat(F.lit("passage: "), text("page_title"), F.lit("\n"), text("chunk_heading"), F.lit("\n"), text("chunk_content")),
        "title_text": F.concat(text("page_title"), F.lit("\n"), text("chunk_heading")),
        "body_text": F.concat(text("description"), F.lit("\n"), text("chunk_content")),
    })


def upsert(stored: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """stored with new's rows in place of those of the same key. Of new rows with one key any one stays."""
    fresh = new.dropDuplicates([key])
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*stored.columns))


def drop_stale(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """stored without rows of a page whose version now is another. Pages that versions doesn't name stay as they are."""
    now = versions.select(F.col("source_url").alias("u"), F.col("page_version").alias("v"))
    return stored.join(now, (F.col("source_url") == F.col("u")) & (F.col("page_version") != F.col("v")), "left_anti")


def index_pages(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """A new snapshot of the index: the chunks' points replace those of their pages; pages without chunks keep theirs."""
    versions = page_versions(chunks)
    return drop_stale(upsert(stored, points(chunks, versions).select(*stored.columns)), versions)


def checked_vectors(df: DataFrame, size: int = 384, col: str = "dense") -> DataFrame:
    """df; a row whose vector hasn't ``size`` elements fails the query."""
    return df.withColumn(col, F.when(F.size(col) == size, F.col(col)).otherwise(F.raise_error(F.lit("vector of a wrong size")).cast(df.schema[col].dataType)))


def decode_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Chunk columns of JSON records: keys that are missing take defaults, rows with a value of another type go."""
    defaults = {"chunk_content": "", "source_url": "", "page_title": "No Title", "description": "No description available"}
    numbers = {"paid": "double", "score": "double", "crawled_at": "long"}
    schema = ", ".join([*(f"{c} string" for c in (*defaults, "chunk_heading")), "tags array<string>", "categories array<string>", *(f"{c} {t}" for c, t in numbers.items()), "_corrupt string"])
    p = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    keys = F.json_object_keys(F.col(col))
    rows = df.withColumn("p", p).withColumn("k", keys)
    given = lambda c: F.array_contains("k", c)
    typed = F.lit(True)
    for c in (*defaults, "tags", "categories", *numbers):  # null isn't a value of these
        typed = typed & (~given(c) | F.col(f"p.{c}").isNotNull())
    rows = rows.filter(F.col("k").isNotNull() & F.col("p._corrupt").isNull() & typed)
    none = F.array().cast("array<string>")
    text = [F.when(given(c), F.col(f"p.{c}")).otherwise(d).alias(c) for c, d in defaults.items()]
    return rows.select(*[c for c in df.columns if c != col], *text, F.col("p.chunk_heading").alias("chunk_heading"), F.coalesce("p.tags", none).alias("tags"), F.coalesce("p.categories", none).alias("categories"), F.coalesce("p.paid", F.lit(0.0)).alias("paid"), F.coalesce("p.score", F.lit(0.0)).alias("payload_score"), F.coalesce("p.crawled_at", F.lit(0)).alias("crawled_at"))


def page_chunks(stored: DataFrame, url: str, most: int = 10_000) -> DataFrame:
    """The chunks of one page, by exact URL, in order."""
    w = Window.orderBy("chunk_index", "point_id")
    found = stored.filter(F.col("source_url") == url).withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0))).orderBy("chunk_index", "point_id").limit(most)
    return found.withColumn("pos", F.row_number().over(w).cast("long"))
