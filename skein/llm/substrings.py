"""Removal of byte strings that an earlier document has too, with suffix arrays where texts diverge.

Every string of LENGTH bytes contains LENGTH - GRAM + 1 grams; the one with the smallest hash (leftmost of equals) is
its anchor. Neighbouring strings with the same anchor form a run, and equal strings have equal anchors, so that only
runs with equal anchors need to meet. A shared string has SIDE bytes before its anchor or SIDE bytes after it, so runs
that share one agree on a side: the anchor with the bytes before it, or with those after it. Steps:

1. scan: the hashes of both sides of each run. Of a side that many documents of a window have, two go on; the others
   are known to be shared.
2. meet, gather: by side hash, which sides several documents have, and how many; the answers are put together by
   document. Nothing is removed on a hash.
3. close: documents with shared sides are dealt and sorted by one of these, so that copies stand side by side, and
   taken in windows. What runs of a window have in common is resolved there. A run goes on (with its bytes) if
   documents elsewhere have a side of it too, and no smaller document of the window has the same run. Anchors with
   very many bytes of such runs are split into single strings, dealt by their own hash, so that none fills a task.
4. order: the same for runs that went on, by anchor.
5. apply: removed ranges are joined to the documents that have any. All others keep their text without meeting anything.

Runs are resolved in this way: equal runs are one text (compared by bytes), of which the smallest document stays. What
different texts may share is put in suffix order (linear grouping); neighbours that agree in LENGTH bytes form a class,
whose smallest document keeps the string. Hashes only decide what meets: a removed byte was compared with an earlier
document's.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import lean, reach_workers, read, release, table
from skein.llm.suffix_array import suffix_array

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams of a string
#: Each string has so many bytes before its anchor, or so many after it.
SIDE = (LENGTH - GRAM + 1) // 2
#: Bytes hashed together (a longer text is cut into overlapping pieces), and bytes whose runs are compared in a scan.
CHUNK, WINDOW = 1 << 18, 3 << 20
#: Groups of sides, and text bytes for each of them where that gives more groups.
BUCKETS, MEET = 128, 1 << 23
#: Of a side that more runs of a window have, only two are sent to meet others. Counts from MANY on are not told apart.
CROWD, MANY = 32, 255
#: Documents with the same side that are dealt to one place.
TOGETHER = 1000
#: Bytes of runs given to one task at a time, of one anchor before it is split, and put in suffix order together.
PART, HOT, ORDER = 1 << 20, 1 << 20, 1 << 15
#: Ids up to this number are broadcast (about 70 bytes each in an executor, 28 MB in all), more are joined by a shuffle.
FEW_IDS = 400_000
_U = np.uint64
_M1, _M2, _C = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_NONE = _U(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def runs(data: bytes, bound: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other in data (bound: where each begins, and the end; each has LENGTH bytes or
    more): each run's first string, number of strings, anchor hash, hash of all its bytes, and hashes of both sides
    (of its own place where a text has no such bytes)."""
    x, n = eights(data), len(data) - LENGTH + 1
    g = x[: len(data) - GRAM + 1] * _C
    g += x[8:] * _M1
    g ^= g >> _U(32)
    g *= _M2
    g ^= g >> _U(29)
    g &= mask
    low = g << _U(24) if mask <= _NONE else g & ~_U(0xFFFFFF)
    low |= np.arange(len(g), dtype=_U)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    low &= _U(0xFFFFFF)
    low[(bound[1:-1, None] - np.arange(1, LENGTH)).ravel()] = _NONE  # strings that would cross texts
    first = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.append(0, first)
    count = np.diff(first, append=n)
    own = low[first] != _NONE
    first, count = first[own], count[own]
    h, end = count.astype(_U), first + count + LENGTH - 1 - GRAM  # the last gram
    for k in range(0, SPAN + LENGTH - GRAM, GRAM):
        h = mix(h ^ g[np.minimum(first + k, end)])
    place = low[first].astype(np.int64)
    anchor, text = g[place], np.searchsorted(bound, first, "right") - 1
    odd, byte = mix(h ^ place.astype(_U)), np.frombuffer(data, np.uint8)
    has = place - SIDE >= bound[text]
    at = np.where(has, place - SIDE, place)
    left = np.where(has, mix(mix(anchor * _C ^ g[at]) ^ byte[at + GRAM].astype(_U)), odd)
    has = place + SIDE + GRAM <= bound[text + 1]
    at = np.where(has, place + SIDE, place)
    right = np.where(has, mix(mix(anchor ^ g[at] * _C) + byte[at - 1].astype(_U)), ~odd)
    return first, count, anchor, h & mask, left & mask, right & mask


class Runs(NamedTuple):
    """The runs of a window of texts: row of the text, first byte in it, first byte in data, bytes, and hashes."""

    data: bytes
    row: np.ndarray
    at: np.ndarray
    pos: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    left: np.ndarray
    right: np.ndarray


def windows(raws, mask: np.uint64):
    """Runs of texts (bytes of LENGTH or more), by windows of about WINDOW bytes."""
    held: list[tuple] = []  # (row, place in its text, bytes)
    size = 0

    def flush() -> Runs:
        blocks, some, n = [], [], 0
        for p in held:
            some.append(p)
            n += len(p[2])
            if n >= CHUNK or p is held[-1]:
                blocks.append(some)
                some, n = [], 0
        parts, datas, base = [], [], 0
        for b in blocks:
            data = b"".join(x for *_, x in b)
            bound = np.cumsum([0, *(len(x) for *_, x in b)])
            first, count, *hashes = runs(data, bound, mask)
            text = np.searchsorted(bound, first, "right") - 1
            parts.append((np.array([r for r, *_ in b])[text], first - bound[text] + np.array([a for _, a, _ in b])[text], first + base, count + LENGTH - 1, *hashes))
            datas.append(data)
            base += len(data)
        return Runs(b"".join(datas), *map(np.concatenate, zip(*parts)))

    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - LENGTH + 1, CHUNK):
            held.append((i, at, raw[at : at + CHUNK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= WINDOW:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def blobs(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary for each slice of values; cut has the slices' bounds."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def strings_of(data: bytes, pos: np.ndarray, size: np.ndarray) -> pa.Array:
    """The size bytes from each pos on."""
    bound = np.concatenate([[0], np.cumsum(size)])
    source, out = np.frombuffer(data, np.uint8), np.empty(bound[-1], np.uint8)
    for k in range(0, len(pos), 1 << 14):
        p, z = pos[k : k + (1 << 14)], bound[k : k + (1 << 14) + 1]
        out[z[0] : z[-1]] = source[np.arange(z[0], z[-1]) + np.repeat(p - z[:-1], np.diff(z))]
    return pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(out)])


def starts(x: np.ndarray) -> np.ndarray:
    """Where x differs from what stands before."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of rows, in order and with growing ends within a row, with those that touch or overlap made one."""
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > end[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], start[new], end[np.append(new[1:], True)] if len(row) else end


def cut_rows(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The rows that have ranges (given in any order), and each one's ranges as pairs of 64-bit numbers."""
    o = np.lexsort((start, row))
    row, start, end = merged(row[o], start[o], end[o])
    first = starts(row)
    return row[first], blobs(np.stack([start, end], 1).ravel().astype(np.int64), 2 * np.append(first, len(row)))


SCAN = "bucket int, base long, sides binary, docs binary, groups binary"


def group_of(side: np.ndarray, buckets: int) -> np.ndarray:
    """A side's bucket and the lower half of its hash, as one number: what it is known by from here on."""
    return ((side >> _U(32)) ^ side) % _U(buckets) << _U(32) | side & _NONE


def scan(rows: DataFrame, buckets: int, mask: np.uint64) -> DataFrame:
    """From doc_id, raw: rows with bucket, sides (32 bits each) and docs (less base), parallel and in order of
    documents. In a row with groups the sides are known to be shared, of any bucket (groups says which); if these are
    empty, they stand for a crowd."""

    def packed(side: np.ndarray, doc: np.ndarray, to: np.ndarray, kind: str = "") -> pa.RecordBatch:
        o = np.argsort(to.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
        side, doc, to = side[o], doc[o], to[o]
        first = starts(to)
        bound, n, base = np.append(first, len(o)), len(first), int(doc.min())
        near = int(doc.max()) - base < 1 << 32
        docs = (doc - base).astype(np.uint32) if near else doc
        groups = blobs((side >> _U(32)).astype(np.uint32), bound) if kind == "known" else pa.array([b"" if kind else None] * n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), pa.array(np.full(n, base if near else 0)), blobs((side & _NONE).astype(np.uint32), bound), blobs(docs, bound), groups], [c.split()[0] for c in SCAN.split(", ")])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for r in windows((t.as_py() for t in b.column(1)), mask):
                side, doc = group_of(np.stack([r.left, r.right], 1).ravel(), buckets), np.repeat(ids[r.row], 2)
                o = np.argsort(side)
                first = starts(side[o])
                size = np.diff(np.append(first, len(o)))
                crowd = np.repeat(size > CROWD, size)
                if crowd.any():
                    o = o[crowd]
                    o = o[np.lexsort((doc[o], side[o]))]
                    first = starts(side[o])
                    size = np.diff(np.append(first, len(o)))
                    inner = np.ones(len(o), bool)
                    inner[first] = inner[first + size - 1] = False  # the smallest and the largest document go on
                    several = np.repeat(doc[o[first]] < doc[o[first + size - 1]], size)
                    known, ends = o[several], o[several & ~inner]
                    send = np.ones(len(doc), bool)
                    send[o[inner | several]] = False
                    if len(known):
                        yield packed(side[known], doc[known], mix(doc[known].view(_U)) % _U(buckets), "known")
                        yield packed(side[ends], doc[ends], side[ends] >> _U(32), "crowd")
                    side, doc = side[send], doc[send]
                if len(doc):
                    yield packed(side, doc, side >> _U(32))

    return rows.mapInArrow(lean(run), SCAN)


def meet(scanned: DataFrame, slices: int) -> DataFrame:
    """Rows (slice, docs, sides, many): parallel arrays of documents, sides of theirs that another document has, and
    how many documents have it."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        sent, known, crowd = [], [], []
        for base, s, d, g in zip(*(t.column(c).to_pylist() for c in ("base", "sides", "docs", "groups"))):
            side = np.frombuffer(s, np.uint32).astype(_U)
            side |= np.frombuffer(g, np.uint32).astype(_U) << _U(32) if g else _U(bucket << 32)
            (known if g else sent).append((side, np.frombuffer(d, np.uint32 if len(d) == len(s) else np.int64).astype(np.int64) + base))
            if g == b"":
                crowd.append(side)
        side, doc = map(np.concatenate, zip(*sent)) if sent else (np.zeros(0, _U), np.zeros(0, np.int64))
        o = np.lexsort((doc, side))
        side, doc = side[o], doc[o]
        new = np.append(True, (side[1:] != side[:-1]) | (doc[1:] != doc[:-1]))[: len(o)]
        side, doc = side[new], doc[new]
        n = np.diff(np.append(starts(side), len(side)))
        n = np.repeat(np.minimum(n, MANY), n).astype(np.uint8)
        if crowd:
            n[np.isin(side, np.concatenate(crowd))] = MANY
        side, doc, n = side[n > 1], doc[n > 1], n[n > 1]
        if known:
            more = list(map(np.concatenate, zip(*known)))
            side, doc, n = np.append(side, more[0]), np.append(doc, more[1]), np.append(n, np.full(len(more[0]), MANY, np.uint8))
        to = mix(doc.view(_U)) % _U(slices)
        o = np.argsort(to, kind="stable")
        first = starts(to[o])
        bound = np.append(first, len(o))
        out = pa.table([pa.array(to[o][first].astype(np.int32)), blobs(doc[o], bound), blobs(side[o], bound), blobs(n[o], bound)], ["slice", "docs", "sides", "many"])
        release()
        return out

    return scanned.groupBy("bucket").applyInArrow(run, "slice int, docs binary, sides binary, many binary")


def gather(met: DataFrame) -> DataFrame:
    """(doc_id, ck, sides, groups, many) of each document that has shared sides: all of them (both halves apart), how many
    documents have each, and one of them by which to deal documents."""

    def run(t: pa.Table) -> pa.Table:
        doc, side, n = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("docs", np.int64), ("sides", _U), ("many", np.uint8)))
        o = np.lexsort((n, side, doc))
        doc, side, n = doc[o], side[o], n[o]
        last = np.append((doc[1:] != doc[:-1]) | (side[1:] != side[:-1]), True)[: len(doc)]
        doc, side, n = doc[last], side[last], n[last]
        first = starts(doc)
        bound = np.append(first, len(doc))
        ck = np.minimum.reduceat(mix(side), first) if len(first) else side
        release()
        return pa.table([pa.array(doc[first]), pa.array(ck.view(np.int64)), blobs((side & _NONE).astype(np.uint32), bound), blobs((side >> _U(32)).astype(np.uint32), bound), blobs(n, bound)], ["doc_id", "ck", "sides", "groups", "many"])

    return met.groupBy("slice").applyInArrow(run, "doc_id long, ck long, sides binary, groups binary, many binary")


NEAR = "anchor long, doc_id long, key long, at long, text binary, cut binary"


def near_rows(anchor=None, doc=None, key=None, at=None, text=None, cut=None) -> pa.RecordBatch:
    n = len(doc)
    columns = [pa.nulls(n, kind) if c is None else pa.array(c) if isinstance(c, np.ndarray) else c for c, kind in ((anchor, pa.int64()), (doc, pa.int64()), (key, pa.int64()), (at, pa.int64()), (text, pa.binary()), (cut, pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NEAR.split(", ")])


def close(rows: DataFrame, buckets: int, mask: np.uint64) -> DataFrame:
    """From doc_id, key, raw, sides, groups, many (copies side by side, a row with sides before the rows with texts of its
    document) to NEAR rows: runs that go on, with their text, and ranges that are removed by a document of the same
    window, as cut."""

    def run(batches):
        look = b"", b"", b""
        for b in batches:
            has = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            sides, groups, many = [], [], []
            for text, *held in zip(has.tolist(), *(b.column(k).to_pylist() for k in (3, 4, 5))):
                if text:
                    for x, y in zip((sides, groups, many), look):
                        x.append(y)
                else:
                    look = held
            b = b.filter(pa.array(has))
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for r in windows((t.as_py() for t in b.column(2)), mask):
                low, high = int(r.row[0]), int(r.row[-1]) + 1
                keyed = lambda side, row: mix(side ^ (row.astype(_U) + _U(1)) * _C)
                rem, group, n = (np.frombuffer(b"".join(x[low:high]), kind) for x, kind in ((sides, np.uint32), (groups, np.uint32), (many, np.uint8)))
                wanted = keyed(group.astype(_U) << _U(32) | rem, np.repeat(np.arange(low, high), [len(x) for x in many[low:high]]))
                o = np.argsort(wanted)
                wanted, n = wanted[o], n[o]
                side, doc = (group_of(r.left, buckets), group_of(r.right, buckets)), ids[r.row]
                count = []
                for s in side:  # documents that have the side; 0 if no other does
                    k = keyed(s, r.row)
                    p = np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)
                    count.append(np.where(wanted[p] == k, n[p], 0))
                # the first and last document of a window may go on in others
                inner = (doc != doc[0]) & (doc != doc[-1])
                c, d = np.concatenate(side), np.tile(doc, 2)
                q = np.flatnonzero(np.concatenate(count))
                q = q[np.lexsort((d[q], c[q]))]
                new = np.append(True, (c[q][1:] != c[q][:-1]) | (d[q][1:] != d[q][:-1]))[: len(q)] & np.tile(inner, 2)[q]
                first = starts(c[q])
                here = np.add.reduceat(new, first, dtype=np.int64) if len(q) else first
                full = np.zeros(2 * len(doc), bool)
                full[q] = np.repeat((here == np.concatenate(count)[q[first]]) & (here < MANY), np.diff(np.append(first, len(q))))
                left, right = full[: len(doc)], full[len(doc) :]
                hit = np.flatnonzero((count[0] > 0) | (count[1] > 0))
                if not len(hit):
                    continue
                some = left[hit] | right[hit]
                text = strings_of(r.data, r.pos[hit], r.size[hit])
                row, start, end, whole = resolve(r.anchor[hit], doc[hit], r.at[hit], text, mask, some)
                who, cut = cut_rows(r.row[hit[row]], start, end)
                if len(who):
                    yield near_rows(doc=ids[who], key=keys[who], cut=cut)
                more = np.flatnonzero(~whole & ~((left[hit] | (count[0][hit] == 0)) & (right[hit] | (count[1][hit] == 0))))
                for k in range(0, len(more), 1 << 14):
                    j = more[k : k + (1 << 14)]
                    i = hit[j]
                    yield near_rows(r.anchor[i].view(np.int64), doc[i], keys[r.row[i]], r.at[i], text.take(pa.array(j)))

    return rows.mapInArrow(lean(run), NEAR)


def distinct(text: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Each text's number among the distinct ones (compared by bytes), these, the smallest document of each, and the
    place of one that has it."""
    coded = text.dictionary_encode()
    which = coded.indices.to_numpy()
    o = np.lexsort((doc, which))
    first = o[starts(which[o])]
    return which, coded.dictionary, doc[first], first


def split(hot: DataFrame, mask: np.uint64) -> DataFrame:
    """Runs of crowded anchors as single strings, dealt by their own hash (NEAR). Of equal ones in a batch only the
    smallest document's goes on; the others are removed."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                some = b.slice(k, 2000)
                doc, key, at = (some.column(c).to_numpy() for c in (1, 2, 3))
                texts = some.column(4).to_pylist()
                data, size = b"".join(texts), np.array([len(x) for x in texts])
                n = size - LENGTH + 1
                row = np.repeat(np.arange(len(texts)), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(np.cumsum(size) - size, n) + off
                string = strings_of(data, pos, np.full(len(pos), LENGTH))
                which, _, least, _ = distinct(string, doc[row])
                gone = doc[row] > least[which]
                who, cut = cut_rows(row[gone], (at[row] + off)[gone], (at[row] + off)[gone] + LENGTH)
                if len(who):
                    yield near_rows(doc=doc[who], key=key[who], cut=cut)
                i = np.flatnonzero(~gone)
                yield near_rows((string_hashes(data)[pos[i]] & mask).view(np.int64), doc[row[i]], key[row[i]], (at[row] + off)[i], string.take(pa.array(i)))

    return hot.mapInArrow(lean(run), NEAR)


def string_hashes(joined: bytes) -> np.ndarray:
    """A hash of the LENGTH bytes from each place on."""
    x = eights(joined)
    n = len(joined) - LENGTH + 1
    h = x[:n] * _C
    for k in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        h ^= x[k : k + n]
        h *= _M1
        h ^= h >> _U(29)
    return mix(h)


def pieces(texts: list[bytes], least: np.ndarray, mask: np.uint64) -> list[tuple[int, int, int]]:
    """(text, first, end) of each piece of a text whose strings all have the hash of a string of another text with
    another smallest document."""
    joined = b"".join(texts)
    bound = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    size = np.diff(bound) - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(owner)) + np.repeat(bound[:-1] - np.cumsum(size) + size, size)
    h, doc = string_hashes(joined)[at] & mask, least[owner]
    o = np.argsort(h)
    first = starts(h[o])
    low, high = np.minimum.reduceat(doc[o], first), np.maximum.reduceat(doc[o], first)
    hit = np.zeros(len(h), bool)
    hit[o] = np.repeat(low < high, np.diff(np.append(first, len(h))))
    edge = owner[1:] == owner[:-1]
    start = np.flatnonzero(hit & ~(np.append(False, hit[:-1] & edge)))
    stop = np.flatnonzero(hit & ~(np.append(hit[1:] & edge, False)))
    return list(zip(owner[start].tolist(), (at[start] - bound[owner[start]]).tolist(), (at[stop] - bound[owner[stop]] + LENGTH).tolist()))


def earlier(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each text the places of its strings that a text with a smaller document has too, by suffix order. A text is
    put in order once, whoever has it."""
    least_doc: dict[bytes, int] = {}
    for x, d in zip(texts, least.tolist()):
        if d < least_doc.get(x, d + 1):
            least_doc[x] = d
    own, low = list(least_doc), np.fromiter(least_doc.values(), np.int64, len(least_doc))
    joined = b"\0".join(own) + b"\0"
    bound = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])])
    owner = np.repeat(np.arange(len(own)), np.diff(bound))
    sa = np.array(suffix_array(joined), np.int64)
    sa = sa[bound[owner[sa] + 1] - 1 - sa >= LENGTH]  # strings that lie within one text
    data = np.frombuffer(joined, np.uint8)
    same = np.append(False, np.ones(len(sa) - 1, bool))
    for j in range(LENGTH):
        same[1:] &= data[sa[:-1] + j] == data[sa[1:] + j]
    first = np.flatnonzero(~same)
    lowest = np.zeros(len(joined), np.int64)
    lowest[sa] = np.repeat(np.minimum.reduceat(low[owner[sa]], first), np.diff(np.append(first, len(sa))))
    number = {p: int(x) for p, x in zip(own, bound)}
    return [np.flatnonzero(lowest[number[x] : number[x] + len(x) - LENGTH + 1] < d) for x, d in zip(texts, least.tolist())]


def resolve(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, text: pa.Array, mask: np.uint64, among: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, start, end) of ranges that a smaller document among these runs has too, and whether a row goes whole. Runs
    that are not equal are held against each other only where among says so."""
    which, own, least, one = distinct(text, doc)
    size = np.diff(np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]).astype(np.int64)
    whole = doc > least[which]
    row, start, end = [np.flatnonzero(whole)], [at[whole]], [at[whole] + size[which[whole]]]
    o = np.arange(len(own)) if among is None else np.unique(which[among])
    # different texts of an anchor, with different smallest documents
    o = o[np.argsort(anchor[one[o]], kind="stable")]
    first = starts(anchor[one[o]])
    several = np.minimum.reduceat(least[o], first) < np.maximum.reduceat(least[o], first) if len(o) else np.zeros(0, bool)
    o = o[np.repeat(several, np.diff(np.append(first, len(o))))]
    cuts: dict[int, list[np.ndarray]] = {}
    if len(o):
        texts = own.take(pa.array(o)).to_pylist()
        found = pieces(texts, least[o], mask)
        held, n = [], 0
        for k, (i, x, y) in enumerate(found):  # in order of anchors, which are never torn apart
            held.append(k)
            n += y - x
            if k + 1 == len(found) or n >= ORDER and anchor[one[o[found[k + 1][0]]]] != anchor[one[o[i]]]:
                of = np.array([o[found[k][0]] for k in held])
                for k, gone in zip(held, earlier([texts[found[k][0]][found[k][1] : found[k][2]] for k in held], least[of])):
                    if len(gone):
                        cuts.setdefault(int(o[found[k][0]]), []).append(gone + found[k][1])
                held, n = [], 0
    if cuts:
        for i in np.flatnonzero(~whole & np.isin(which, list(cuts))).tolist():  # of the smallest document itself
            for gone in cuts[int(which[i])]:
                _, a, z = merged(np.zeros(len(gone), int), at[i] + gone, at[i] + gone + LENGTH)
                row.append(np.full(len(a), i))
                start.append(a)
                end.append(z)
    return *map(np.concatenate, (row, start, end)), whole


def order(near: DataFrame, mask: np.uint64) -> DataFrame:
    """From NEAR rows with a part to rows (doc_id, key, cut) of what a smaller document has too."""

    def run(t: pa.Table) -> pa.Table:
        anchor, doc, key, at = (t.column(c).to_numpy() for c in ("anchor", "doc_id", "key", "at"))
        row, start, end, _ = resolve(anchor, doc, at, t.column("text").combine_chunks(), mask)
        release()
        cut = blobs(np.stack([start, end], 1).ravel().astype(np.int64), 2 * np.arange(len(row) + 1))
        return pa.table([pa.array(doc[row]), pa.array(key[row]), cut], ["doc_id", "key", "cut"])

    return near.groupBy("part").applyInArrow(run, "doc_id long, key long, cut binary")


def beside(rows: DataFrame, looks: DataFrame) -> DataFrame:
    """Rows doc_id, key, raw, sides, groups, many, dealt by ck and sorted by ck and doc_id: before the texts of each document
    that has a look (key, raw; the others null) its look (sides, groups, many; the others null)."""
    which = looks.select("doc_id", "ck")
    texts = rows.join(F.broadcast(which) if looks.count() <= FEW_IDS else which, "doc_id")
    columns = ["doc_id", "key", "raw", "sides", "groups", "many"]
    both = texts.unionByName(looks, allowMissingColumns=True).withColumn("text", F.col("raw").isNotNull())
    return both.repartition("ck").sortWithinPartitions("ck", "doc_id", "text").select(*columns)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep: tuple[str, ...] = (), hash_bits: int = 64, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and with keep_text also kept (the remaining
    bytes as text; characters that a cut went through are dropped) and spans (array of (start, end)); then df's columns
    named in keep, under their own names.

    A byte goes if a string of LENGTH bytes that covers it also starts in a row with a smaller doc_id. Null text is
    empty. Rows with a null doc_id are left as they are and remove nothing; rows that share a doc_id do not remove
    from each other. Ids must be integers. Further columns are ignored; an empty table gives an empty result.
    hash_bits and hot (bytes of runs from which on an anchor is split) change the work but never the result.
    """
    spark = df.sparkSession
    reach_workers(spark)
    mask = _U((1 << hash_bits) - 1)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), F.xxhash64(raw).alias("key"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    more = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("raw") >= LENGTH)).select("doc_id", "key", "raw")
    total = docs.agg(F.sum(F.octet_length("raw").cast("long"))).collect()[0][0] or 0
    buckets = max(BUCKETS, -(-total // MEET))

    met = meet(scan(rows.select("doc_id", "raw"), buckets, mask), buckets)
    looks = table(gather(met), "looks")
    often = table(looks.groupBy("ck").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("places")).filter("places > 1"), "often")
    deal = F.xxhash64("ck", F.pmod(F.xxhash64("doc_id"), F.coalesce("places", F.lit(1))))
    looks = looks.join(F.broadcast(often) if often.count() <= FEW_IDS else often, "ck", "left").withColumn("ck", deal).drop("places")
    near = table(close(beside(rows, looks), buckets, mask), "near")
    cuts, near = near.filter("cut IS NOT NULL").select("doc_id", "key", "cut"), near.filter("text IS NOT NULL")
    size = F.sum(F.octet_length("text").cast("long"))
    crowded = table(near.groupBy("anchor").agg(size.alias("n")).filter(F.col("n") > hot).select("anchor"), "crowded")
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= FEW_IDS else crowded
        single = table(split(near.join(crowded, "anchor", "left_semi").select(*near.columns), mask), "single")
        near = near.join(crowded, "anchor", "left_anti").select(*near.columns).unionByName(single.filter("text IS NOT NULL"))
        cuts = cuts.unionByName(single.filter("cut IS NOT NULL").select("doc_id", "key", "cut"))
    parts = max(16, -(-(near.agg(size).collect()[0][0] or 0) // PART))
    cuts = cuts.unionByName(order(near.drop("cut").withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts))), mask))
    cuts = table(cuts.groupBy("doc_id", "key").agg(F.collect_list("cut").alias("cuts")), "cuts")
    ids = cuts.select("doc_id", "key")
    few = ids.count() <= FEW_IDS
    rest = docs.join(F.broadcast(ids) if few else ids, ["doc_id", "key"], "left_anti")
    rest = rest.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"), *([F.col("raw").cast("string").alias("kept"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")] if keep_text else []), *more)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for b in batches:
            out = []
            for d, raw, found in zip(*(c.to_pylist() for c in b.columns[:3])):
                cut: list[list[int]] = []
                for x, y in np.unique(np.frombuffer(b"".join(found), np.int64).reshape(-1, 2), axis=0).tolist():
                    if cut and x <= cut[-1][1]:
                        cut[-1][1] = max(y, cut[-1][1])
                    else:
                        cut.append([x, y])
                edge = [0, *(x for s in cut for x in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edge[::2], edge[1::2]))
                more_of = (kept.decode("utf-8", "ignore"), [{"start": x, "end": y} for x, y in cut]) if keep_text else ()
                out.append((d, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), *more_of))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span)[: 7 if keep_text else 5]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)), *b.columns[3:]], [*names, *more])

    named = docs.join(F.broadcast(ids), ["doc_id", "key"], "left_semi") if few else docs  # only their texts are moved
    out = rest.unionByName(named.join(cuts, ["doc_id", "key"]).select("doc_id", "raw", "cuts", *more).mapInArrow(lean(apply), rest.schema))
    return out.toDF(*out.columns[: len(out.columns) - len(keep)], *keep)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
