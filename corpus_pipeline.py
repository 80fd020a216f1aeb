"""A cleaning pipeline for training text: each stage works on what the one before it kept."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe_codec, decontaminate, lang_id, neardup, substrings
from skein.llm.common import read, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A mean probability below this says that the text is in none of the learned languages.
LEAST_SCORE = 0.35
#: Ids to drop are broadcast up to this number (about 70 bytes each in an executor), more are joined by a shuffle.
FEW_IDS = 400_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not in ids; rows without an id stay."""
    ids = table(ids.distinct(), "drop")
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those that look like no learned language; fill in languages that are missing."""
    model = lang_id.fit(docs.filter(~lang_id.held_out("doc_id")))
    out = lang_id.predict(docs, model, keep=COLUMNS[1:])
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return without(docs, neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that an earlier document has; documents of which no word is left go."""
    out = substrings.dedup(docs, keep_text=True, keep=("lang", "source", "n_chars"))
    out = out.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return without(docs, decontaminate.matches(docs, read(spark, sf_dir, "benchmark")).select("doc_id"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of what is left."""
    return bpe_codec.encode(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=True, keep_decoded=False)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", bpe)]

#: Not expressible in SQL (a trained network, byte-pair merges): tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
