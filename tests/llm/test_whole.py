"""What an operator must not lose: cases that a shortened job would miss."""

import random

from skein.llm import decontaminate, quality, sharding, warc


def test_quotes_at_every_offset(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(2 * n)).strip()
    items = [decontaminate.normal(prose(2 * n))[:n].decode().strip() for n in (115, 130, 155, 200, 500)]
    rows = []
    for i, item in enumerate(items):
        for size, changes in ((108, 0), (131, 8)):
            for k in range(len(item) - size + 1):
                quote = list(item[k : k + size].strip())
                for at in rng.sample(range(len(quote)), changes):
                    quote[at] = "Z"
                if len(quote) == size:
                    rows.append((len(rows), "QQQ " * 20 + "".join(quote) + " WWW" * 20, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, i int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert got == {(d, i) for d, _, i in rows}


def test_short_texts_without_common_words(spark):
    common, rng = [f"c{i}" for i in range(24)], random.Random(6)
    good = lambda n, share: " ".join(rng.choice(common) if rng.random() < share else f"rare{rng.randint(0, 9999)}" for _ in range(n))
    # of texts without common words the distance is over 0.5 only where these are frequent
    for share, gone in ((0.7, [1050, 1060, 1099, 1100, 1150]), (0.3, [1100, 1150])):
        rows = [(i, good(rng.randint(60, 300), share), "en") for i in range(300)]
        rows += [(1000 + n, " ".join(f"odd{rng.randint(0, 9999)}" for _ in range(n)), "en") for n in (50, 60, 99, 100, 150)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, most_chars=1.0).collect()}
        assert sorted(d for d, k in kept.items() if not k) == gone


def test_planned_map_is_stored(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "scratch", lambda spark, name: str(tmp_path / name), raising=False)
    rows = sharding.op7_sharding(spark, sf).select("vslot", "shard").distinct().collect()
    m = sharding.load_map(spark, str(tmp_path / "slot_map"))
    assert m.version == 1 and rows and all(m.owner[r["vslot"]] == r["shard"] for r in rows)


def test_warc_row_for_each_page(spark, tmp_path):
    long = "x" * 90000
    rows = [(6, "http://e/", "a")] * 2 + [(None, "http://f/", "b")] * 3 + [(None, None, "a"), (8, "http://h/", None)] + [(7, "http://g/", "a")] * 2 + [(1, "http://i/", long)] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op8_warc(spark, str(tmp_path)).collect()
    assert all(r["ok"] for r in got)
    assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in got) == sorted((str(p), len(h or "")) for p, _, h in rows)
    assert [r["refers_to"] for r in got if r["page_id"] == 7] == [6, 6]


def test_equal_texts_share_a_shard_and_growth_moves_named_slots(spark, tmp_path):
    rows = [(i, f"text {i % 150} " * 9) for i in range(600)] + [(1000 + i, "one very common text " * 40) for i in range(400)] + [(5000, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path / "map")
    got = sharding.assign(df, map_path=path, n_slots=512).collect()
    text, shard = dict(rows), {r["doc_id"]: r["shard"] for r in got}
    assert len(got) == len(rows)
    where, load = {}, {}
    for r in got:
        where.setdefault(text[r["doc_id"]] or "", set()).add(r["shard"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert [len(v) for k, v in where.items() if k.startswith("text") or not k] == [1] * 151
    assert len(where["one very common text " * 40]) == 8 and max(load.values()) - min(load.values()) < 0.05 * max(load.values())
    m = sharding.load_map(spark, path)
    assert len(m.split) == 1
    size, _ = sharding.slot_totals(sharding.with_slots(sharding.sized(df), m.split, 512))
    sharding.save_map(spark, sharding.rebalance(m, size, 9), path)
    grown = sharding.load_map(spark, path)
    moved = {r["vslot"] for r in sharding.assign(df, slot_map=grown, n_slots=512).collect() if r["shard"] != shard[r["doc_id"]]}
    assert grown.version == 2 and moved and moved <= set(grown.moved) and 8 in {grown.owner[s] for s in grown.moved}
