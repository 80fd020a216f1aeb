"""Workers hold a part of what they are given, and give the same."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import html, retrieval
from skein.sources import tables


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def best(requests, ids, vectors, k):
    scores = np.round(requests @ vectors.T, retrieval.DIGITS)
    return [[(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k]] for s in scores]


def test_nearest_holds_a_tile():
    rng = np.random.default_rng(1)
    ids, vectors, requests = rng.permutation(6000), rng.integers(-3, 4, (6000, 8)) / 8.0, rng.integers(-3, 4, (3000, 8)) / 8.0
    found = retrieval.Nearest(requests, 5)
    _, most = peak(lambda: [found.add(ids[i : i + 2500], vectors[i : i + 2500]) for i in range(0, 6000, 2500)])
    assert most < 100e6  # all scores are 144 MB
    assert [list(zip(i.tolist(), s)) for i, s in zip(found.ids, found.scores)] == best(requests, ids, vectors, 5)


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (300, 4)) / 4.0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, [1.0, 2.0]), (1001, None), (1002, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = vectors[::20]
    want = {(20 * r, i, s, n) for r, b in enumerate(best(asked, np.arange(300), vectors, 4)) for n, (i, s) in enumerate(b, 1)}
    for requests in (df.filter("id < 300 AND id % 20 = 0"), [(i, v) for i, v in rows[:300] if i % 20 == 0]):
        assert {tuple(r) for r in retrieval.nearest(requests, df, "id", "v", 4, block=7 * 32).collect()} == want
    assert retrieval.nearest(df.limit(0), df, "id", "v").count() == retrieval.nearest([], df, "id", "v").count() == 0
    assert retrieval.nearest([(1, [1.0, 0.0])], df, "id", "v", 9).agg(F.count("id"), F.max("rank")).collect() == [(1, 1)]


def test_pages_and_texts_are_taken_in_slices():
    html_of = "<title>t</title>" + "<p class=x>some words of a page</p>" * 40
    n = 4000
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["http://e.example/"] * n, "html": [html_of] * n})
    sizes, most = peak(lambda: [(b.num_rows, b.column(0)[0].as_py(), len(b.column(4)[-1])) for b in html.extracted([pages])])
    assert most < 30e6  # trees, blocks and Arrow's input of all pages are over 200 MB
    assert sum(s[0] for s in sizes) == n and max(s[0] for s in sizes) <= 256 and {s[2] for s in sizes} == {40}
    assert [s[1] for s in sizes] == sorted(s[1] for s in sizes)
    mixed = pa.RecordBatch.from_pydict({"t": ["x" * 3_000_000, "", None, *["y" * 1000] * 5000]})
    cut = list(tables.small([mixed, mixed.slice(0, 0)]))
    assert pa.Table.from_batches(cut).column("t").to_pylist() == mixed.column("t").to_pylist()
    assert all(b.num_rows <= 256 and (b.nbytes <= 2**20 or b.num_rows == 1) for b in cut)


def test_embeddings_hash_a_piece_once(monkeypatch):
    calls, real = [], hashlib.blake2b
    monkeypatch.setattr(retrieval.hashlib, "blake2b", lambda x, **k: calls.append(x) or real(x, **k))
    once = retrieval.hash_embedding("Quillon varde quillon ostrelmav")
    n = len(calls)
    assert all(retrieval.hash_embedding("Quillon varde quillon ostrelmav") == once for _ in range(9)) and len(calls) == n
    out = np.zeros(384)
    for piece in ["ab_", "ab"]:
        assert retrieval.query_terms(piece) == ["ab"]
    for piece in ["ab", "<ab", "ab>"]:
        h = int.from_bytes(real(piece.encode(), digest_size=8).digest(), "little")
        out[h % 384] += 1.0 if h >> 63 else -1.0
    assert retrieval.hash_embedding("ab_ AB") == (out / np.linalg.norm(out)).tolist()
