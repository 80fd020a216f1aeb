"""Content blocks to chunks with a budget of characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.html import SPACES
from skein.sources.tables import reach_workers, small

# Characters of a chunk at most, characters from which it is closed, and of a piece without white space.
MOST, ENOUGH, UNBROKEN = 1200, 800, 450
_BLANK = "[" + re.escape(SPACES) + "]"
_TO_LAST_BLANK = re.compile(f"(?s).+(?={_BLANK})")
_BLANKS = re.compile(f"{_BLANK}*")


def split(text: str) -> list[str]:
    """Pieces of at most MOST characters, cut at the last white space that the limit allows; where there is none, after
    UNBROKEN characters."""
    if len(text) <= MOST:
        return [text]
    pieces, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > MOST:
            # the blank that ends a piece is itself within the limit
            cut = _TO_LAST_BLANK.match(text, at, at + MOST)
            end = cut.end() if cut else at + UNBROKEN
        pieces.append(text[at:end].strip(SPACES))
        at = _BLANKS.match(text, end).end()
    return pieces


def pack(blocks: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    """Pieces joined into (heading, content) chunks, in order. A chunk's heading is the last that any piece up to its
    end had."""
    out, held, size, heading = [], [], 0, None

    def close() -> None:
        nonlocal held, size
        if text := " ".join(held).strip(SPACES):
            out.append((heading, text))
        held, size = [], 0

    for own, text in blocks:
        for piece in split(text):
            if size and size + 1 + len(piece) > MOST:
                close()
            size += len(piece) + (1 if size else 0)
            if held and not any(held):
                held = []
            held.append(piece)
            heading = heading if own is None else own
            if size >= ENOUGH:
                close()
    close()
    return out


def split_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos and piece of each row's text (null as empty)."""
    reach_workers(df.sparkSession)
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([split(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], [id_col, "pieces"])

    return rows.mapInArrow(run, f"{id_col} {kind}, pieces array<string>").select(id_col, F.posexplode("pieces").alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


def chunks(extracted: DataFrame, crawled_at: int = 0) -> DataFrame:
    """The chunk records of extracted pages: page_id, source_url, page_title, description, chunk_index, chunk_heading,
    chunk_content, tags, categories, paid, payload_score and crawled_at. A page without content gives none."""
    reach_workers(extracted.sparkSession)
    kind = extracted.schema["page_id"].dataType.simpleString()
    rows = extracted.select("page_id", "url", "title", "description", "blocks")

    def run(batches):
        for b in small(batches):
            got = [pack([(x["heading"], x["text"]) for x in v or []]) for v in b.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([[{"heading": h, "text": t} for h, t in g] for g in got], pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])))], ["page_id", "url", "title", "description", "chunks"])

    out = rows.mapInArrow(run, f"page_id {kind}, url string, title string, description string, chunks array<struct<heading:string,text:string>>")
    none = F.array().cast("array<string>")
    return out.select("page_id", F.col("url").alias("source_url"), F.col("title").alias("page_title"), "description", F.posexplode("chunks").alias("chunk_index", "c")).select("page_id", "source_url", "page_title", "description", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.heading").alias("chunk_heading"), F.col("c.text").alias("chunk_content"), none.alias("tags"), none.alias("categories"), F.lit(0.0).alias("paid"), F.lit(0.0).alias("payload_score"), F.lit(crawled_at).cast("long").alias("crawled_at"))
