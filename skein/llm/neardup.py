"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

Sketch: round i hashes every shingle to a bin and a value; rounds go on until each of the t bins is filled (from
round t on, round i fills bin i - t, so all are filled after 2t rounds), and a bin keeps its smallest (round, value).
Two sets agree in a bin with a probability that is their similarity, and as each bin is a draw without replacement
the share of equal bins is concentrated around it. Bands of ``rows`` bins make candidates.

Texts with equal sets are one class from the start. Buckets that share classes are clusters, and each class goes to
one task with its cluster, where classes are compared on their full sets unless they are already known to be
connected. In a task only sets meet that share one of their rarest shingles: of two sets as similar as asked, each has
one of the other's among its n - ceil(n * similarity) + 1 rarest. A cluster with more sets, or larger ones, than a
block holds is cut into blocks: first each block is worked on with some members that stand in all of them, then what
is outside the cluster's largest component is compared with each of its blocks. So each pair of classes in a bucket is
compared unless both are already connected, no pairs are ever listed, and no task holds more than a few blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from skein.llm.common import lean, reach_workers, read, release, table
from skein.llm.components import components

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Classes up to this number are broadcast (about 100 bytes each), more are joined by a shuffle.
FEW_NODES = 200_000
#: Bytes of shingle sets that meet at once and their number, and bytes that a task is given.
BLOCK, ROWS, TASK = 8 << 20, 1 << 15, 16 << 20
#: Members of a cluster that stand in all its blocks.
LEADS = 8
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of k words; words are what ASCII white space leaves, with A-Z
    lower-cased. A text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    s = h[: n - k + 1]
    for j in range(1, k):
        s = mix(s) + h[j : n - k + 1 + j]
    return np.unique(mix(s))


class Sketcher:
    def __init__(self, t: int, seed: int = 1):
        self.t = t
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        t, out, i = self.t, np.full(self.t, EMPTY), 0
        while i < 2 * t:
            rounds = np.arange(i, min(2 * t, i + max(1, 4096 // len(s))))
            h = mix(s[None, :] ^ self.seeds[rounds][:, None])
            bins = np.where(rounds[:, None] < t, (h % np.uint64(t)).astype(np.int64), rounds[:, None] - t)
            value = rounds.astype(np.uint64)[:, None] << np.uint64(48) | mix(h) >> np.uint64(16)
            np.minimum.at(out, bins.ravel(), value.ravel())
            if (out != EMPTY).all():
                break
            i = int(rounds[-1]) + 1
        return out


def signature(s: np.ndarray) -> bytes:
    """What stands for a set of shingles."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def band_count(threshold: float, rows: int, miss: float = 1e-6) -> int:
    """Bands so that a pair at the threshold shares none with a probability of at most miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(df: DataFrame, k: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, sig (128-bit hash of the set) and bands (null without shingles) of every row."""
    reach_workers(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seeds = np.arange(bands, dtype=np.uint64)

    def run(batches):
        sketch = Sketcher(rows * bands)
        for b in batches:
            n, sig, out = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                if not len(s):
                    sig.append(None)
                    out.append(None)
                    continue
                sig.append(signature(s))
                key, parts = seeds, sketch(s).reshape(bands, rows)
                for j in range(rows):
                    key = mix(key ^ parts[:, j]) + parts[:, j]
                out.append(mix(key).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "sig", "bands"])

    return docs.mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, sig binary, bands array<long>")


def connect(rep: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect just what all links among these sets connect, beyond what label connects already.

    Rows that share one of their rarest shingles (rare among these rows) and are not connected yet are compared exactly:
    shingles that only one row has are left out, the others get small numbers, and one row is held against all its
    candidates at once. Without probe all pairs count, with it those of a row that it marks and any other row.
    """
    m, out = len(rep), []
    size = np.array([len(s) for s in sets])
    flat, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    rare = np.lexsort((number, often[number], owner))
    place = np.arange(len(rare)) - np.repeat(np.cumsum(size) - size, size)
    rare = rare[(place < (size - (percent * size + 99) // 100 + 1)[owner]) & (often[number[rare]] > 1)]
    by = rare[np.argsort(number[rare], kind="stable")]
    held, code = owner[by], number[by]  # rows by rare shingle
    low, high = (np.searchsorted(code, number[rare], side) for side in ("left", "right"))
    own = np.searchsorted(owner[rare], np.arange(m + 1))
    meets = np.zeros(m, bool)
    meets[owner[rare][high - low > 1]] = True
    shared = often[number] > 1
    owner, number = owner[shared], number[shared]
    bound = np.searchsorted(owner, np.arange(m + 1))
    flag = np.zeros(len(flat), bool)
    members = {int(k): list(v) for k, v in zip(np.unique(label), np.split(np.argsort(label, kind="stable"), np.flatnonzero(np.diff(np.sort(label))) + 1))}
    for x in np.flatnonzero(meets if probe is None else meets & probe):
        near = np.concatenate([held[a:b] for a, b in zip(low[own[x] : own[x + 1]], high[own[x] : own[x + 1]])])
        near = near[label[near] != label[x]]
        near = np.unique(near[near > x] if probe is None else near)
        least = np.minimum(size[near], size[x])
        near = near[100 * least >= percent * (size[near] + size[x] - least)]
        if not len(near):
            continue
        flag[number[bound[x] : bound[x + 1]]] = True
        n = bound[near + 1] - bound[near]
        at = np.repeat(bound[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(np.repeat(np.arange(len(near)), n), flag[number[at]], len(near)).astype(np.int64)
        flag[number[bound[x] : bound[x + 1]]] = False
        good = near[100 * both >= percent * (size[near] + size[x] - both)]
        joined, first = np.unique(label[good], return_index=True)
        out += [(int(rep[x]), int(rep[y])) for y in good[first]]
        if len(joined):
            some = sorted((int(k) for k in (*joined, label[x])), key=lambda k: -len(members[k]))
            for k in some[1:]:
                label[members[k]] = some[0]
                members[some[0]] += members.pop(k)
    return out


def with_sets(df: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """nodes (rep, sig and others) with the shingle set that sig stands for, from the texts themselves."""
    docs = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    joined = docs.join(F.broadcast(nodes) if nodes.count() <= FEW_NODES else nodes, "rep").select("text", *nodes.columns)
    schema = StructType([StructField("shingles", ArrayType(LongType())), *nodes.schema])
    sig_at = 1 + nodes.columns.index("sig")

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(0)]
            out = pa.RecordBatch.from_arrays([pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *b.columns[1:]], schema.names)
            yield out.filter(pa.array([signature(s) == g for s, g in zip(sets, b.column(sig_at).to_pylist())], pa.bool_()))

    return joined.mapInArrow(lean(run), schema)


def compare(rows: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (u, v) found within each task. rows: task, rep, label, probe, shingles."""

    def run(t: pa.Table) -> pa.Table:
        task = t.column("task").to_numpy()
        col = {c: t.column(c).to_numpy() for c in ("rep", "label", "probe")}
        sets = t.column("shingles").combine_chunks()
        order = np.lexsort((col["rep"], task))
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            probe = col["probe"][at]
            found += connect(col["rep"][at], col["label"][at].copy(), [sets[int(i)].values.to_numpy() for i in at], percent, None if not probe.any() else probe)
        release()
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    spread = rows.select(F.pmod(F.xxhash64("task"), F.lit(parts)).alias("part"), "task", "rep", "label", "probe", "shingles")
    return spread.groupBy("part").applyInArrow(run, "u long, v long")


def links(reps: DataFrame, df: DataFrame, k: int, percent: int, id_col: str, text_col: str, block: int = BLOCK, most_rows: int = ROWS) -> DataFrame | None:
    """Verified links (u, v) that connect just what all links connect. reps: rep, sig, n_shingles, bands."""
    entries = reps.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last").select("bucket", "first")
    clusters = components(entries.join(shared, "bucket").select(F.col("rep").alias("u"), F.col("first").alias("v")))
    nodes = table(reps.drop("bands").join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep"), "nodes")
    needed = lambda: F.ceil(F.greatest(F.sum("n_shingles") * 8 / block, F.count("*") / most_rows)).cast("int")
    sizes = nodes.groupBy("cluster").agg(needed().alias("blocks"))
    large = table(sizes.filter("blocks > 1"), "large")
    total = nodes.agg(F.sum("n_shingles")).collect()[0][0]
    if not total:
        return None
    parts = max(8, -(-8 * total // TASK))
    n_large = large.count()
    some = nodes.withColumn("task", F.xxhash64("cluster"))
    if n_large:
        dealt = nodes.join(large, "cluster").withColumn("i", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")))
        # a few members of each large cluster stand in all its blocks, so that what is like them is connected at once
        lead = F.row_number().over(Window.partitionBy("cluster", "i").orderBy("rep"))
        lead = dealt.withColumn("r", lead).filter("r = 1").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("i"))).filter(F.col("r") <= LEADS)
        everywhere = lead.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.unionByName(everywhere.select(*dealt.columns)).dropDuplicates(["cluster", "i", "rep", "sig"])
        some = some.join(large.select("cluster"), "cluster", "left_anti").unionByName(dealt.withColumn("task", F.xxhash64("cluster", "i")).select(*some.columns))
    sets = with_sets(df, some.select("task", "rep", "sig"), k, id_col, text_col)
    found = table(compare(sets.withColumn("label", F.col("rep")).withColumn("probe", F.lit(False)), parts, percent), "links")
    if not n_large:
        return found
    # what is not in a large cluster's largest component is held against all its blocks
    label = components(found).withColumnRenamed("node", "rep").withColumnRenamed("component", "label")
    held = table(nodes.join(large, "cluster").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "held")
    weight = held.groupBy("cluster", "label").agg(F.sum("n_shingles").alias("w"))
    top = weight.groupBy("cluster").agg(F.max(F.struct("w", "label")).alias("t")).select("cluster", F.col("t.label").alias("main"))
    held = held.join(top, "cluster").withColumn("i", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")))
    apart = held.filter("label <> main")
    n_apart = apart.groupBy("cluster").agg(needed().alias("others"))
    held = held.join(n_apart, "cluster")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = held.filter("label <> main").withColumn("j", F.pmod(F.xxhash64("rep", F.lit("other")), F.col("others"))).withColumn("i", each("blocks")).withColumn("probe", F.lit(True))
    against = held.withColumn("j", each("others")).withColumn("probe", F.lit(False))
    tasks = probes.unionByName(against.select(*probes.columns)).withColumn("task", F.xxhash64("cluster", "i", "j"))
    sets = with_sets(df, tasks.select("task", "rep", "sig", "label", "probe"), k, id_col, text_col)
    more = compare(sets, parts, percent)
    return table(found.unionByName(more), "links")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, rows: int = 6, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least percent per cent) and kept
    (doc_id = component_id) of every row.

    Texts that are null or without words have no shingles, no links and are kept. Equal sets are linked. Rows that
    repeat a doc_id are one node of the graph and give a row each; a null doc_id links to nothing, has no component_id
    and is kept.
    Further columns are ignored; an empty table gives an empty result. block (bytes) and most_rows say how much meets at
    once and change the work but not the result.
    """
    sigs = table(signatures(df, k, rows, band_count(percent / 100, rows), id_col, text_col), "signatures")
    reps = table(sigs.filter("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    found = links(reps.select("rep", "sig", "n_shingles", "bands"), df, k, percent, id_col, text_col, block, most_rows)
    # only classes of several texts, and of them only their other members, need to look up their first text
    own = sigs.select("doc_id", "n_shingles", "sig").join(reps.filter("copies > 1").select("sig", "rep"), "sig", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    if found is not None:
        own = own.join(components(found), F.col("rep") == F.col("node"), "left")
        own = own.withColumn("component_id", F.coalesce("component", "rep"))
    else:
        own = own.withColumn("component_id", F.col("rep"))
    own = own.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return own.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)
