"""Token counts: heap-and-linked-list merging that emits no ids."""

from __future__ import annotations

import pyarrow as pa
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe
from skein.llm.common import reach_workers, read

#: Words whose counts a worker keeps; beyond, it forgets all and starts anew, so memory stays bounded.
MEMO = 1_200_000


class Counts(dict):
    """From a word to its number of tokens, found when first asked for."""

    def __init__(self, path: str):
        self.bpe = bpe.load(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = bpe.count_symbols(self.bpe, word.encode())
        if len(word) <= 64:
            self[word] = n
        return n

    def of(self, text: str) -> int:
        at = self.__getitem__
        return sum(1 if special else sum(map(at, self.bpe.split(piece))) for piece, special in self.bpe.pieces(text))


_COUNTS: dict[str, Counts] = {}


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row, with no shuffle.

    Null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row gives one row. Further columns
    are ignored; an empty table gives an empty result. Whole texts are counted, however long.
    """
    reach_workers(df.sparkSession)

    def run(batches):
        counts = _COUNTS.setdefault(vocabulary, None) or Counts(vocabulary)
        _COUNTS[vocabulary] = counts
        for b in batches:
            n = [counts.of(t) if t else 0 for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
