"""Benchmark decontamination by q-gram filtering and banded alignment.

Benchmark items are cut into overlapping patterns. A pattern of m bytes within e edits of some text shares at least
m - q + 1 - e*q of its q-grams with it, and those lie on at most e + 1 neighbouring diagonals (place in the text less
place in the pattern). So hits are counted by pattern and diagonal band (bands of 2(e + 1) diagonals, one every
e + 1), bands under the bound are dropped (first over a whole stretch of an item, then by piece), and what is left is
aligned within its band.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import lean, reach_workers, read, table

Q = 8
#: Bytes of a piece, and bytes from one to the next: no more than its edits at the usual rate, so that a quote which
#: holds no whole piece still holds all but these edits of one.
PATTERN, STRIDE = 120, 12
#: Pieces that begin in so many bytes of an item are counted together first; a stretch and its last piece are under 1 << 12.
STRETCH = 960
#: Normalised items shorter than this are matched unchanged and as whole words only; edits would make them anything.
LEAST = 24
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of documents searched together.
CHUNK = 1 << 21
_C = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> bytes:
    """Lower case, white space runs as one space."""
    return b" ".join(text.lower().encode().split())


def places(size: int) -> list[tuple[int, int]]:
    """(start, bytes) of the pieces of an item of so many bytes: one every STRIDE, the last flush with the end; an item
    that is hardly longer or shorter than PATTERN also counts whole."""
    whole = [(0, size)] if LEAST <= size <= PATTERN * 4 // 3 else []
    last = size - PATTERN
    return whole + [(k, PATTERN) for k in (*range(0, last, STRIDE), last) if last > 0]


def patterns(item: bytes) -> list[bytes]:
    return [item[k : k + m] for k, m in places(len(item))]


def grams(data: bytes | np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from each place on, as numbers."""
    n = len(data) - Q + 1
    return np.ndarray((max(0, n),), "<u8", data, strides=(1,))


class Index:
    """Stretches of items with their grams, and the pieces that lie in them."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.item, texts, pieces = [], [], []
        self.text: list[bytes] = []
        short: dict[str, list] = {}
        for key, text in items:
            whole = normal(text or "")
            if 0 < len(whole) < LEAST:
                short.setdefault(f" {whole.decode('latin-1')} ", []).append(key)
            by_stretch: dict[int, list[tuple[int, int]]] = {}
            for k, m in places(len(whole)):
                by_stretch.setdefault(k // STRETCH, []).append((k, m))
            for some in by_stretch.values():
                begin, end = min(k for k, _ in some), max(k + m for k, m in some)
                pieces += [(len(texts), k - begin, m) for k, m in some]
                texts.append(whole[begin:end])
                self.item += [key] * len(some)
                self.text += [whole[k : k + m] for k, m in some]
        within, self.start, self.size = (np.array([x[i] for x in pieces], np.int64) for i in range(3))
        self.budget = (self.size * rate).astype(np.int64)
        self.bound = np.maximum(1, self.size - Q + 1 - self.budget * Q)
        self.first_piece = np.searchsorted(within, np.arange(len(texts) + 1))
        # of a stretch: its bands are wide enough for each of its pieces, its bound is the lowest
        self.step = np.maximum.reduceat(self.budget, self.first_piece[:-1]) + 1 if texts else within
        self.least = np.minimum.reduceat(self.bound, self.first_piece[:-1]) if texts else within
        codes = [grams(p) for p in texts]
        code = np.concatenate([*codes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.bits = np.uint64(64 - max(16, int(16 * len(self.codes) + 1).bit_length()))
        self.maybe = np.zeros(1 << int(64 - self.bits), bool)
        self.maybe[(self.codes * _C) >> self.bits] = True
        self.short = ahocorasick.Automaton() if short else None
        for word, keys in short.items():
            self.short.add_word(word, (len(word), keys))
        if short:
            self.short.make_automaton()

    def __bool__(self) -> bool:
        return bool(self.text or self.short)

    def hits(self, docs: list[bytes]):
        """(doc number, item, start, edits) of every verified region, one for each band or unchanged short item."""
        for i, d in enumerate(docs) if self.short else ():
            for end, (size, keys) in self.short.iter(f" {d.decode('latin-1')} "):
                yield from ((i, key, end - size + 1, 0) for key in keys)
        for i, p, start, edits in self.find(docs) if self.text else ():
            yield i, self.item[p], start, edits

    def find(self, docs: list[bytes]):
        """(doc number, pattern number, start, edits) of every verified region, one for each band."""
        gap = b"\0" * Q
        buf = gap.join(docs) + gap
        begin = np.cumsum([0, *(len(d) + Q for d in docs)])
        g = grams(buf)
        at = np.flatnonzero(self.maybe[(g * _C) >> self.bits])
        k = np.searchsorted(self.codes, g[at])
        ok = (k < len(self.codes)) & (self.codes[np.minimum(k, len(self.codes) - 1)] == g[at])
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        which = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, own, place = np.repeat(at, n), self.owner[which], self.place[which]
        band = (at - place + (1 << 13)) // self.step[own]  # never negative
        # a hit counts for the band that begins in its step and for the one before
        key = np.concatenate([(band << 24) | own, ((band - 1) << 24) | own])
        ordered = np.sort(key)
        edge = np.flatnonzero(np.diff(ordered, prepend=-1, append=-1))
        count, live = np.diff(edge), ordered[edge[:-1]]
        live = live[count >= self.least[live & 0xFFFFFF]]
        if not len(live):
            return
        # in bands that have enough for a piece somewhere, hits are counted by piece
        k = np.minimum(np.searchsorted(live, key), len(live) - 1)
        hit = np.flatnonzero(live[k] == key)
        code = np.sort((k[hit] << 12) | place[hit % len(place)])
        own, band = live & 0xFFFFFF, live >> 24
        n = self.first_piece[own + 1] - self.first_piece[own]
        piece = np.repeat(self.first_piece[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        k = np.repeat(np.arange(len(live)), n)
        low = (k << 12) + self.start[piece]
        count = np.searchsorted(code, low + self.size[piece] - Q, "right") - np.searchsorted(code, low)
        ok = np.flatnonzero(count >= self.bound[piece])
        found = []
        for p, b, step in zip(piece[ok].tolist(), band[k[ok]].tolist(), self.step[own[k[ok]]].tolist()):
            low = b * step - (1 << 13) + int(self.start[p])
            doc = int(np.searchsorted(begin, max(0, low + step) + int(self.size[p]) // 2, "right")) - 1
            if not 0 <= doc < len(docs):
                continue
            found.append((doc, p, low - int(begin[doc]), step))
        yield from self.verify(docs, found)

    def verify(self, docs: list[bytes], found: list[tuple[int, int, int, int]]):
        slow = []
        for doc, p, low, step in found:
            text = self.text[p]
            if (k := docs[doc].find(text, max(0, low), max(0, low + 2 * step + len(text)))) >= 0:
                yield doc, p, k, 0
            else:
                slow.append((doc, p, low, step))
        by_size: dict[tuple[int, int], list] = {}
        for x in slow:
            by_size.setdefault((len(self.text[x[1]]), x[3]), []).append(x)
        for (_, step), some in by_size.items():
            for k in range(0, len(some), 512):
                part = some[k : k + 512]
                e = int(self.budget[part[0][1]])
                for (doc, p, *_), (cost, start) in zip(part, banded([self.text[p] for _, p, *_ in part], [docs[d] for d, *_ in part], [x[2] for x in part], 2 * step, e)):
                    if cost <= e:
                        yield doc, p, start, cost


def banded(pats: list[bytes], texts: list[bytes], lows: list[int], width: int, e: int) -> list[tuple[int, int]]:
    """For patterns of one length: fewest edits that align the whole pattern with a part of its text on the diagonals
    from low - e to low + width + e, and about where that part starts; (e + 1, 0) if there are more than e. All pairs advance together, row by row."""
    m, w = len(pats[0]), width + 2 * e + 1
    a = np.frombuffer(b"".join(pats), np.uint8).reshape(len(pats), m)
    t = np.zeros((len(pats), m + w), np.uint8)
    off = np.zeros((len(pats), m + w), bool)
    for row, beyond, text, low in zip(t, off, texts, lows):
        k = np.arange(low - e, low - e + m + w)
        inside = (k >= 0) & (k < len(text))
        row[inside] = np.frombuffer(text, np.uint8)[k[inside]]
        beyond[:] = ~inside
    ramp, far = np.arange(w, dtype=np.int16), np.int16(1 << 14)
    d = np.zeros((len(pats), w), np.int16)
    back = np.broadcast_to(ramp, d.shape).copy()
    out, left = [(e + 1, 0)] * len(pats), np.arange(len(pats))
    for i in range(m):
        cost = d + ((t[:, i : i + w] != a[:, i : i + 1]) | off[:, i : i + w])
        skip = np.full_like(d, far)
        skip[:, :-1] = d[:, 1:] + 1
        src = back.copy()
        up = skip < cost
        src[:, :-1] = np.where(up[:, :-1], back[:, 1:], back[:, :-1])
        best = np.minimum(cost, skip)
        run = np.minimum.accumulate(best - ramp, axis=1) + ramp
        lead = np.maximum.accumulate(np.where(run == best, ramp, 0), axis=1)
        back = np.take_along_axis(src, lead.astype(np.intp), axis=1)
        d = run
        if i % 8 == 7:  # the fewest edits of a row never fall, so pairs beyond e are out
            on = d.min(axis=1) <= e
            if not on.all():
                t, off, a, d, back, left = t[on], off[on], a[on], d[on], back[on], left[on]
            if not len(left):
                return out
    end = d.argmin(axis=1)
    for n, row, k, b in zip(left.tolist(), d, end, back):
        out[n] = int(row[k]), max(0, lows[n] - e + int(b[k]))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, n_regions (verified bands), edits
    (fewest, in one pattern) and start (of the best, in bytes of the normalised text).

    At rate 0.1 a quote of PATTERN + STRIDE - 1 = 131 bytes holds a whole piece of its item wherever it starts, and an
    unchanged quote of 108 bytes is found too. Of items up to PATTERN bytes the whole is looked for.
    Items under LEAST bytes are found where they stand unchanged as whole words.
    Documents with no match give no row. Null or empty texts and items match nothing. Rows that repeat an id count
    together. Further columns are ignored; empty tables give an empty result.
    The benchmark goes to the executors in blocks of about BLOCK_BYTES of text, one after the other through the driver,
    and each block meets all documents.
    """
    reach_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).filter("item_text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("item_text"))).collect()[0][0] or 0
    n = -(-total // BLOCK_BYTES)
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start long, edits long"
    out = None

    def search(held: list[tuple]):
        def run(batches):
            index = Index(held, rate)
            for b in batches if index else ():
                ids, docs, size = [], [], 0
                last = b.num_rows - 1
                for i, (d, t) in enumerate(zip(b.column(0), b.column(1))):
                    ids.append(d)
                    docs.append(normal(t.as_py()))
                    size += len(docs[-1])
                    if size < CHUNK and i < last:
                        continue
                    got = list(index.hits(docs))
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[x[0]].as_py() for x in got], b.schema.field(0).type), pa.array([x[1] for x in got], item_kind), pa.array([x[2] for x in got], pa.int64()), pa.array([x[3] for x in got], pa.int64())], ["doc_id", "item_id", "start", "edits"])
                    ids, docs, size = [], [], 0

        return run

    for k in range(max(1, n)):
        held = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(max(1, n))) == k).collect()]
        part = rows.mapInArrow(lean(search(held)), schema)
        if n > 1:  # the driver lets go of a block before it takes the next
            part = table(part, "found")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("edits", "start"))
    return out.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_regions"), best.alias("b")).select("doc_id", "item_id", "n_regions", F.col("b.edits").alias("edits"), F.col("b.start").alias("start"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
