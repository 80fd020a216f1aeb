"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names, for each operator."""

import hashlib

import pytest
from public_tokenizers import path

import corpus_pipeline
from skein.llm import bpe_codec, decontaminate, lang_id, licenses, neardup, quality, sharding, substrings, token_counts, warc
from tests.llm import brute

VOCAB = path("byte_bpe_50k.json")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
CLASH = "key bucket rep sig size vslot words raw sure look lang_pred score kept rank first last hist marks band node component u v text_ name".split()
SOME = " ".join(f"word{i} über{i % 7}" for i in range(120))
ROWS = [
    (1, SOME, "en"), (2, SOME, None), (2, SOME, None), (3, None, "en"), (None, SOME, "de"), (None, None, None), (4, "", "en"),
    (5, "   \n\t ", "en"), (6, "a", "fr"), (7, "<|endoftext|> a<|endoftext|>", "en"), (8, "12 34 --", None), (9, SOME + " " + MIT, "en"),
    (10, "é" * 30000 + "\n" + "long text " * 9000, "fr"), (11, "x" * 200000, "en"), (12, "　 日本語 ٣٤ \x85 \x1c\x1d", "ja"), (-5, MIT * 2, "en"),
]
EXPECT = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, lang, None, len(t or ""), *range(len(CLASH))) for d, t, lang in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, MIT, 3), (1, MIT, 4), (2, None, 1), (3, "", 1), (None, SOME[:300], 1), (4, "tiny", 0)], "item_id long, text string, doc_id int")


OPERATORS = {
    "licenses": lambda d, b: licenses.scan(d),
    "quality": lambda d, b: quality.judge(d),
    "codec": lambda d, b: bpe_codec.encode(d, VOCAB, keep_ids=True),
    "lang_id": lambda d, b: lang_id.predict(d, lang_id.fit(d), keep=("text", "lang", "score")),
    "counts": lambda d, b: token_counts.count_tokens(d, VOCAB),
    "substrings": lambda d, b: substrings.dedup(d, keep_text=True, keep=("lang", "key", "raw")),
    "sharding": lambda d, b: sharding.assign(d),
    "neardup": lambda d, b: neardup.near_duplicates(d),
    "decontaminate": lambda d, b: decontaminate.matches(d, b),
    "warc": lambda d, b: None,
}


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "warc"])
def test_empty_tables(spark, docs, benchmark, name):
    empty = docs.limit(0)
    assert OPERATORS[name](empty, benchmark).count() == 0
    if name == "decontaminate":
        assert OPERATORS[name](docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["quality", "codec", "lang_id", "counts", "substrings", "sharding", "neardup"])
def test_a_row_for_each_row(docs, benchmark, name):
    got = OPERATORS[name](docs, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, *_ in ROWS)


def test_quality_values(docs, benchmark):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs).collect()}
    assert got == {(d, *brute.quality(t)) for d, t, _ in ROWS}


def test_js_distance(spark):
    from pyspark.sql import functions as F

    r = spark.sql("SELECT array(1d,0d) a, array(0d,2d) b, array(3d,0d) c, array(0d,0d) z").select(quality.js_distance(F.col("a"), F.col("b")).alias("far"), quality.js_distance(F.col("a"), F.col("c")).alias("same"), quality.js_distance(F.col("a"), F.col("z")).alias("none")).collect()[0]
    assert r["far"] == 1.0 and r["same"] == 0.0 and r["none"] is None


def test_codec_and_counts(docs, benchmark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    want = {}
    for d, text, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.setdefault(str(d), []).append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = {}
    for r in bpe_codec.encode(docs, VOCAB, keep_ids=True).collect():
        assert r["n_tokens"] == len(r["token_ids"]) and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
        got.setdefault(str(r["doc_id"]), []).append((r["n_tokens"], r["ids_sha256"]))
    counts = {}
    for r in token_counts.count_tokens(docs, VOCAB).collect():
        counts.setdefault(str(r["doc_id"]), []).append(r["n_tokens"])
    for d, xs in want.items():
        assert sorted(xs) == sorted(got[d]) and sorted(n for n, _ in xs) == sorted(counts[d])


def test_substrings_values(docs):
    got = sorted(map(str, (tuple(r)[:5] for r in substrings.dedup(docs).collect())))
    assert got == sorted(map(str, brute.repeats([x[:2] for x in ROWS])))


def test_substrings_random(spark):
    import random

    rng = random.Random(3)
    seen = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 400))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [x[rng.randint(0, 30) :][: rng.randint(30, 300)] for x in rng.choices(seen, k=rng.randint(0, 4))]
        rows.append((i - 20, "".join(p + "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) for p in parts)))
    rows += [(200 + i, "ab" * rng.randint(10, 200)) for i in range(20)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.repeats(rows))


def test_neardup_values(docs):
    got = neardup.near_duplicates(docs, k=3, percent=85).collect()
    want = brute.near_duplicates([x[:2] for x in ROWS], 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_neardup_random(spark):
    import random

    rng = random.Random(4)
    rows = []
    for g in range(40):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), " ".join(w if rng.random() > 0.02 else "new" + str(rng.randint(0, 99)) for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent, block in ((3, 85, 1 << 20), (5, 80, 1 << 20), (3, 85, 1000), (2, 60, 2000)):
        got = neardup.near_duplicates(df, k=k, percent=percent, block=block).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near_duplicates(rows, k, percent)


def test_licenses_and_benchmark(docs, benchmark):
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert {(9, "MIT"), (-5, "MIT")} <= found and {d for d, _ in found} == {9, -5}
    held = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert held == {(9, 1), (-5, 1), *((d, None) for d in (1, 2, 9, None))}
    short = docs.sparkSession.createDataFrame([(1, "Permission is"), (2, "ermission"), (3, "日本語"), (4, "A"), (5, "12  34")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.matches(docs, short).collect()} == {(9, 1, 0), (-5, 1, 0), (12, 3, 0), (6, 4, 0), (9, 4, 0), (-5, 4, 0), (8, 5, 0)}


def test_sharding_rebalance():
    sizes = {s: 1 + s % 13 for s in range(sharding.N_SLOTS)}
    m = sharding.plan_map(sizes, 8)
    grown = sharding.rebalance(m, sizes, 9)
    assert grown.version == 2 and sorted(set(grown.owner)) == list(range(9)) and [s for s in range(sharding.N_SLOTS) if m.owner[s] != grown.owner[s]] == grown.moved
    load = [sum(sizes[s] for s in range(sharding.N_SLOTS) if grown.owner[s] == k) for k in range(9)]
    assert max(load) - min(load) <= 13 and sharding.SlotMap.from_json(grown.to_json()) == grown
    shrunk = sharding.rebalance(grown, sizes, 5)
    assert max(shrunk.owner) == 4


def test_slot_map_is_kept(spark, tmp_path):
    m = sharding.plan_map({1: 5, 2: 7}, 3, 16)
    sharding.save_map(spark, m, str(tmp_path / "map"))
    sharding.save_map(spark, sharding.rebalance(m, {1: 5, 2: 7}, 4), str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).version == 2 and sharding.load_map(spark, str(tmp_path / "map"), 1) == m


def test_warc_segments(spark, tmp_path):
    from pyspark.sql import functions as F

    html = [(1, "http://a/", "x" * 5000), (2, None, None), (3, "http://b/", ""), (4, "http://c/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" * 700), (5, "http://d/", "x" * 5000), (6, "http://e/", "0\r\n\r\n"), (6, "http://e/", "0\r\n\r\n")]
    pages = spark.createDataFrame([(p, u, h, 0, "z") for p, u, h in html], "page_id long, url string, html string, payload int, same string")
    warc.write(pages, str(tmp_path / "w"), segment_bytes=700, per_file=2)
    got = {r["page_id"]: r for r in warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert {p: (r["payload_bytes"], r["record_type"], r["refers_to"], r["ok"]) for p, r in got.items()} == {1: (5000, "response", None, True), 2: (0, "response", None, True), 3: (0, "revisit", 2, True), 4: (len(html[3][2].encode()), "response", None, True), 5: (5000, "revisit", 1, True), 6: (5, "response", None, True)}
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.captures(warc.read_records(spark, str(tmp_path / "none"))).count() == 0
    lost = warc.read_records(spark, str(tmp_path / "w")).filter(F.col("number").isNull())
    assert lost.filter("NOT ok").count() == 0


def test_pipeline_stages(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for d in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            d = stage(spark, d, str(tmp_path))
            assert name == corpus_pipeline.STAGES[-1][0] or tuple(d.columns) == corpus_pipeline.COLUMNS
            d.write.mode("overwrite").parquet(str(tmp_path / f"{k}"))
            d = spark.read.parquet(str(tmp_path / f"{k}"))


def test_substrings_whatever_the_hashes(spark):
    """Hashes of six bits make nearly everything collide; anchors of any size are split into strings."""
    import random

    rng = random.Random(8)
    seen = ["".join(rng.choice("abcd é") for _ in range(rng.randint(40, 300))) for _ in range(10)]
    rows = [(i, "".join(x[rng.randint(0, 20) :][: rng.randint(40, 200)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) for x in rng.choices(seen, k=rng.randint(0, 3)))) for i in range(90)]
    rows += [(i + 30, t) for i, t in rows[::9]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute.repeats(rows))
    for bits, hot in ((6, substrings.HOT), (64, 1), (6, 1)):
        assert sorted(tuple(r) for r in substrings.dedup(df, hash_bits=bits, hot=hot).collect()) == want


def test_neardup_many_short_texts_with_one_common_shingle():
    """Sets of two, one member the same in all: they share buckets, but no two are near; and some short near copies."""
    import numpy as np

    n = 300_000
    sets = [np.array([7, 100 + i], np.uint64) for i in range(n)]
    sets += [np.array([*range(10_000_000, 10_000_020), 20_000_000 + i], np.uint64) for i in range(2000)]
    found = neardup.connect(np.arange(len(sets)), np.arange(len(sets)), sets, 85)
    assert len(found) == 1999 and min(min(x) for x in found) >= n
