"""Candidate retrieval: BM25, dense similarity, and weighted reciprocal rank fusion.

A single request over texts counts its few terms where a row is read: no postings are shuffled. Where requests come
again, postings are stored once and a request reads those of its terms. Batches of requests go to the executors as a
block and give a few candidates a row batch.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from skein.functions import text
from skein.sources.tables import reach_workers, settled, small

# Budgets of a search, weights of the three lists.
MOST_LIMIT, MOST_OFFSET, SPARE = 50, 200, 4
WEIGHTS = {"dense": 2.0, "title": 2.0, "body": 1.0}
#: BM25's usual parameters and an assumed field length; the fusion constant, with ranks from 0.
K1, B, AVERAGE_LENGTH, FUSION = 1.2, 0.75, 256.0, 2.0
#: Digits to which scores are rounded before they are compared, so that sums in another order give the same ranks.
DIGITS = 9
_TOKEN = re.compile(r"[^\W_]+")
#: Stands for a null id where ids lie in arrays.
NO_ID = 2**63 - 1


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a request, as tokens() makes them."""
    return list(dict.fromkeys(_TOKEN.findall(query.lower())))


def candidate_limit(limit: int, offset: int) -> int:
    return (min(limit, MOST_LIMIT) + min(offset, MOST_OFFSET)) * SPARE


def top(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best rows by score, ties by id, with rank from 1."""
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def document_frequency(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df and idf of every term of the corpus."""
    n = df.select(F.count("*").alias("n"))
    terms = df.select(F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(F.broadcast(n), how="cross").select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, average: float | None = AVERAGE_LENGTH) -> DataFrame:
    """id and score of each row that has a term of the query. average=None takes the corpus's mean length.

    Without terms no row is found. Null text has no terms.
    """
    terms = query_terms(query)
    rows = df.select(F.col(id_col), text.tokens(F.col(text_col)).alias("tokens"))
    same = lambda t: lambda x: x == F.lit(t)
    counts = [F.size(F.filter("tokens", same(t))) for t in terms]
    rows = rows.select(id_col, F.size("tokens").alias("dl"), *(c.alias(f"tf{i}") for i, c in enumerate(counts)))
    if not terms:
        return rows.limit(0).select(id_col, F.lit(0.0).alias("score"))
    totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    found = rows.filter(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(totals), how="cross")
    base = F.lit(average) if average else F.col("mean")

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / base))).otherwise(0.0)

    return found.select(id_col, F.round(reduce(add, map(part, range(len(terms)))), DIGITS).alias("score"))


def store_postings(df: DataFrame, id_col: str, text_col: str, path: str, parts: int | None = None) -> None:
    """Write what bm25_stored reads: path/postings (term, id, tf, dl), path/terms (term, df), path/totals (n, words).

    Postings lie in order of term and id: a request reads the row groups of its terms alone, and a term of many texts is
    spread over several files. A text's counts are made in its row. Null text has no terms, but counts in n. Tables are
    replaced if they are there; parts is the number of files, else that of shuffle partitions.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.sort_array(text.tokens(F.col(text_col))).alias("tokens")).withColumn("dl", F.size("tokens"))
    starts = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("tokens", i - 1) != F.get("tokens", i)))
    rows = rows.withColumn("starts", F.when(F.col("dl") > 0, starts))
    count = lambda p, k: F.struct(F.get("tokens", p).alias("term"), (F.coalesce(F.get("starts", k + 1), F.col("dl")) - p).alias("tf"))
    # the totals, the ranges' sample and the postings read the counts: a text is split once
    each = settled(rows.select("id", "dl", F.explode(F.transform("starts", count)).alias("c")).select("c.term", "id", "c.tf", "dl"))
    words = each.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("words"))
    df.agg(F.count("*").alias("n")).crossJoin(words).write.mode("overwrite").parquet(f"{path}/totals")
    ordered = each.repartitionByRange(*([parts] if parts else []), "term", "id").sortWithinPartitions("term", "id")
    ordered.write.mode("overwrite").parquet(f"{path}/postings")
    terms = spark.read.schema(each.schema).parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
    terms.repartitionByRange(*([parts] if parts else []), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def bm25_stored(spark: SparkSession, path: str, query: str, id_col: str = "id", average: float | None = AVERAGE_LENGTH) -> DataFrame:
    """What bm25 gives over the texts that store_postings was given, from the postings. Of rows that share an id the
    scores are added up."""
    terms = query_terms(query)
    asked = F.col("term").isin(terms) if terms else F.lit(False)
    known = spark.read.parquet(f"{path}/terms").filter(asked)  # a row for each term of the request at most
    totals = spark.read.parquet(f"{path}/totals")
    found = spark.read.parquet(f"{path}/postings").filter(asked).join(F.broadcast(known), "term").join(F.broadcast(totals), how="cross")
    base = F.lit(average) if average else F.col("words") / F.col("n")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / base))
    return found.groupBy(F.col("id").alias(id_col)).agg(F.round(F.sum(part), DIGITS).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def dense(df: DataFrame, id_col: str, vec_col: str, query: list[float]) -> DataFrame:
    """id and cosine score of each row with a unit vector of the query's size."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.filter(F.size(vec_col) == len(query))
    return rows.select(id_col, F.round(dot(F.col(vec_col), q), DIGITS).alias("score"))


def fuse(lists: dict[str, DataFrame], id_col: str, k: int, weights: dict[str, float] | None = None, constant: float = FUSION) -> DataFrame:
    """The k best ids by the sum of weight / (constant + rank), ranks from 0, over ranked lists."""
    weights = weights or WEIGHTS
    parts = [d.select(id_col, (F.lit(weights[n]) / (constant + F.col("rank") - 1)).alias("w")) for n, d in lists.items()]
    merged = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.round(F.sum("w"), DIGITS).alias("score"))
    return top(merged, id_col, k)


def blocks(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """The rows' ids and vectors in blocks of about size bytes: n, d, ids (eight bytes each) and vecs (doubles). A null id
    is the highest number there is, which sorts last; rows without a vector go."""
    reach_workers(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") > 0)

    def run(batches):
        for b in small(batches, 2**31, size):
            v, n = b.column(1), pa.compute.list_value_length(b.column(1)).to_numpy()
            at, cuts = v.offsets.to_numpy(), [0, *np.flatnonzero(np.diff(n)) + 1, len(n)]
            for i, j in zip(cuts, cuts[1:]):  # vectors of a size
                if i < j:
                    yield pa.RecordBatch.from_arrays([pa.array([j - i]), pa.array([int(n[i])]), pa.array([b.column(0).to_numpy()[i:j].tobytes()]), pa.array([v.values.to_numpy(zero_copy_only=False)[at[i] : at[j]].tobytes()])], ["n", "d", "ids", "vecs"])

    return rows.mapInArrow(run, "n long, d long, ids binary, vecs binary")


class Nearest:
    """The k best ids by score, then by id, of each request of a block, over blocks of rows that come one after another."""

    def __init__(self, requests: np.ndarray, k: int):
        self.block, self.k = requests.T, k
        self.ids = np.full((len(requests), k), NO_ID, np.int64)
        self.scores = np.full((len(requests), k), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, tile: int = 1024) -> None:
        for i in range(0, len(ids), tile):
            mine = ids[i : i + tile]
            for j in range(0, self.block.shape[1], tile):
                self._merge(mine, vectors[i : i + tile] @ self.block[:, j : j + tile], j)

    def _merge(self, ids: np.ndarray, raw: np.ndarray, j: int) -> None:
        least = self.scores[j : j + raw.shape[1], -1]
        if len(ids) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(raw, len(ids) - self.k, axis=0)[len(ids) - self.k])
        # rounding moves a score by less than half a unit of the last digit
        row, req = np.nonzero(raw >= least - 2 * 10.0**-DIGITS)
        if not len(row):
            return
        touched = np.unique(req)
        old = self.scores[j + touched]
        who = np.concatenate([np.repeat(touched, self.k), req])
        new_ids = np.concatenate([self.ids[j + touched].ravel(), ids[row]])
        scores = np.concatenate([old.ravel(), np.round(raw[row, req], DIGITS)])
        order = np.lexsort((new_ids, -scores, who))
        first = np.searchsorted(who[order], touched)
        take = order[first[:, None] + np.arange(self.k)]  # each request has k old ones at least
        self.ids[j + touched], self.scores[j + touched] = new_ids[take], scores[take]


def nearest(requests: list[tuple[int, list[float]]] | DataFrame, df: DataFrame, id_col: str, vec_col: str, k: int = 5, block: int = 2**19) -> DataFrame:
    """request_id, id, score and rank of each request's k best rows by cosine; requests are pairs or rows like df's. Each
    block of requests meets each block of rows, and a task gives k rows a request at most. Memory doesn't grow with either
    side, nothing is gathered in the driver; the work is that of all pairs."""
    spark = df.sparkSession
    asked = requests if isinstance(requests, DataFrame) else spark.createDataFrame(requests, f"{id_col} long, {vec_col} array<double>")
    sides = [settled(blocks(x, id_col, vec_col, block)) for x in (asked, df)]
    left = sides[0].select("d", F.monotonically_increasing_id().alias("at"), F.col("ids").alias("asked"), F.col("vecs").alias("q"))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(sides[1].withColumnRenamed("d", "d2")).filter("d = d2").select("at", "d", "asked", "q", "ids", "vecs")

    def run(batches):
        def result():
            k_each = np.repeat(names, best.k), best.ids.ravel(), best.scores.ravel()
            some = ~np.isneginf(k_each[2])
            a, b, s = (x[some] for x in k_each)
            return pa.RecordBatch.from_arrays([pa.array(a, mask=a == NO_ID), pa.array(b, mask=b == NO_ID), pa.array(s)], ["request_id", "id", "score"])

        at = best = names = None
        for b in batches:
            for i in range(b.num_rows):
                here, d, asked, q, ids, vecs = (c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in b.columns)
                if here != at:
                    if best is not None:
                        yield result()
                    at, names, best = here, np.frombuffer(asked, np.int64), Nearest(np.frombuffer(q, np.float64).reshape(-1, d).copy(), k)
                    names = names.copy()
                best.add(np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float64).reshape(-1, d))
        if best is not None:
            yield result()

    found = pairs.mapInArrow(run, "request_id long, id long, score double")
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


@lru_cache(maxsize=2**16)
def _place(piece: str, size: int) -> int:
    h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
    return h % size + (size if h >> 63 else 0)


@lru_cache(maxsize=2**16)
def _places(word: str, size: int) -> bytes:
    """Where a word and its pieces count: places of a vector, size higher where they count as 1 and not as -1."""
    padded = f"<{word}>"
    place = _place if len(word) <= 64 else _place.__wrapped__
    return np.array([place(x, size) for x in (word, *(padded[i : i + 3] for i in range(len(padded) - 2)))], np.int32).tobytes()


def hash_embedding(passage: str, size: int = 384) -> list[float]:
    """A deterministic stand-in for an embedding model: signed hashes of words and of their three-letter pieces."""
    # long words aren't kept in memory
    found = [_places(w, size) if len(w) <= 64 else _places.__wrapped__(w, size) for w in query_terms(passage) or [""]]
    counts = np.bincount(np.frombuffer(b"".join(found), np.int32), minlength=2 * size)
    out = (counts[size:] - counts[:size]).astype(np.float64)
    n = float(np.linalg.norm(out))
    return (out / n if n else out).tolist()


def embed(df: DataFrame, text_col: str, embedder=hash_embedding, out_col: str = "dense") -> DataFrame:
    """df with the vector of text_col; embedder maps one text to a unit vector and may load a model of its own."""
    reach_workers(df.sparkSession)
    fields = df.schema

    def run(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([embedder(t or "") for t in b.column(text_col).to_pylist()], pa.list_(pa.float32()))], [*fields.names, out_col])

    return df.mapInArrow(run, StructType([*fields, StructField(out_col, ArrayType(FloatType()))]))
