"""Each dealt query against a plain statement of its contract, on every row of the smallest tables."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]


def result(spark, sf, name):
    rows = __spark_entry__.queries()[name](spark, sf).collect()
    return [r.asDict() for r in rows]


def by_id(rows, key="doc_id"):
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_license_scan(spark, sf, docs):
    import re

    from skein.llm import licenses

    notices = [(k, t) for k, v in sorted(licenses.TEMPLATES.items()) for t in v]
    words = lambda x: [w for w in re.findall(r"[^\W_]+", x.lower())]
    want = set()
    for d, text, _ in docs:
        w = words(text or "")
        own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for i, (_, t) in enumerate(notices):
            tw = words(t)
            all_ = {tuple(tw[j : j + 3]) for j in range(len(tw) - 2)}
            if 100 * len(all_ & own) >= 80 * len(all_):
                want.add((d, i))
    got = result(spark, sf, "op1_license_scan")
    assert {(r["doc_id"], r["template"]) for r in got} == want and want
    assert all(r["containment"] >= 0.8 for r in got)


def test_quality_rules(spark, sf, docs):
    got = by_id(result(spark, sf, "op2_quality_rules"))
    assert len(got) == len(docs)
    for d, text, _ in docs:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(text)
        assert not (r["kept"] and r["base_failed"])


def test_bpe_codec_and_token_counts(spark, sf, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    codec, counts = by_id(result(spark, sf, "op3_bpe_codec")), by_id(result(spark, sf, "op5_token_counts"))
    assert len(codec) == len(counts) == len(docs)
    for d, text, _ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert codec[d]["n_tokens"] == counts[d]["n_tokens"] == len(ids)
        assert codec[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert codec[d]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert counts[d]["n_bytes"] == len((text or "").encode()) and counts[d]["over_limit"] == (len(ids) > 512)


def test_language_id(spark, sf, docs):
    got = by_id(result(spark, sf, "op4_language_id"))
    assert len(got) == len(docs)
    langs = {x for *_, x in docs if x}
    right = total = 0
    for d, text, lang in docs:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
            continue
        assert r["lang_pred"] in langs
        if r["held_out"] and lang:
            total += 1
            right += r["lang_pred"] == lang
    assert right >= 0.93 * total


def test_suffix_array_dedup(spark, sf, docs):
    got = result(spark, sf, "op6_suffix_array_dedup")
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == set(brute.repeats([x[:2] for x in docs]))
    assert len(got) == len(docs)


def test_sharding(spark, sf, docs):
    got = by_id(result(spark, sf, "op7_sharding"))
    assert len(got) == len(docs)
    load, slots = defaultdict(int), defaultdict(list)
    for d, text, _ in docs:
        raw, r = (text or "").encode(), got[d]
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in got.values())


def test_warc(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    first = {}
    for p, html in pages:
        first[html or ""] = min(p, first.get(html or "", p))
    got = by_id(result(spark, sf, "op8_warc"), "page_id")
    assert len(got) == len(pages)
    for p, html in pages:
        raw, r = (html or "").encode(), got[p]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["ok"]
        to = first[html or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == p else ("revisit", to))


def test_minhash_neardup(spark, sf, docs):
    got = by_id(result(spark, sf, "op9_minhash_neardup"))
    want = brute.near_duplicates([x[:2] for x in docs], 3, 85)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_decontamination(spark, sf, docs):
    """Every pattern of every item against every document, where a shared gram makes an alignment thinkable."""
    from skein.llm import decontaminate as dc

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {d: dc.normal(t or "") for d, t, _ in docs}
    grams = {d: set(dc.grams(x).tolist()) for d, x in texts.items()}
    want = set()
    for item, text in items:
        for p in dc.patterns(dc.normal(text or "")):
            own, e = set(dc.grams(p).tolist()), int(len(p) * 0.1)
            for d, x in texts.items():
                if (d, item) not in want and len(own & grams[d]) >= 1 and (p in x or len(own & grams[d]) >= len(own) // 8 and brute.edits(p, x) <= e):
                    want.add((d, item))
    got = {(r["doc_id"], r["item_id"]) for r in result(spark, sf, "op10_decontamination")}
    assert got == want and want


def test_suffix_arrays():
    from skein.llm.suffix_array import suffix_array

    rng = np.random.default_rng(5)
    cases = [b"", b"a", b"aaaa", b"banana", b"mississippi", b"abcabcabc" * 9, bytes(range(255, -1, -1))]
    cases += [bytes(rng.integers(0, k, n).astype(np.uint8)) for k in (1, 2, 3, 256) for n in (2, 7, 40, 300) for _ in range(10)]
    for s in cases:
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
