"""Byte-level BPE files: reading them, splitting text as their pre-tokenizer does, and two ways to merge.

``count_symbols`` merges with a heap over a linked list and only counts. ``encode_words`` merges a whole block of
distinct words at once through an index from each pair to all its places.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point the pattern's classes are written out.
WIDE = 0x250
#: Up to so many places of a pair are merged one by one, more at once.
FEW = 40
#: Texts beyond so many characters are split lazily, so that no list of all their words is made.
LONG = 1 << 20


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary: ids of bytes, the merges by rank (``left``, ``right``, ``new``), ``rank_of`` a pair, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        back = {c: b for b, c in chars.items()}
        self.byte_id = [vocab[chars[b]] for b in range(256)]
        self.byte_table = bytes(self.byte_id)  # the files number bytes below 256
        self.byte_ids = np.array(self.byte_id, np.int64)
        pairs = [tuple(p.split(" ") if isinstance(p, str) else p) for p in spec["model"]["merges"]]
        self.left, self.right, self.new = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]
        self.rank_of = {p: rank for rank, p in enumerate(zip(self.left, self.right))}
        keys = np.array(self.left, np.int64) << 32 | np.array(self.right, np.int64)
        # open addressing, so that many pairs are looked up at once
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):
            free = todo[self.slot_key[at[todo]] == -1]
            self.slot_key[at[free]] = keys[free]
            mine = free[self.slot_key[at[free]] == keys[free]]
            self.slot_rank[at[mine]] = mine
            todo = np.setdiff1d(todo, mine)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.id_bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.id_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.narrow, self.wide = re.compile(narrow_pattern()), re.compile(f"[^\0-\\u{WIDE - 1:04x}]")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        keys = np.where((a < 0) | (b < 0), -2, a << 32 | b)
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], -1)
        miss = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[miss]]
            same = found == keys[miss]
            out[miss[same]] = self.slot_rank[at[miss[same]]]
            miss = miss[~same & (found != -1)]
        return out

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: (piece, is special), empty pieces left out."""
        if not self.cut or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def split(self, piece: str):
        """The words of a piece. Text up to U+024F is split by an equal pattern for the faster engine."""
        words = self.words if self.wide.search(piece) else self.narrow
        return words.findall(piece) if len(piece) <= LONG else (m.group() for m in words.finditer(piece))


def narrow_pattern() -> str:
    """PATTERN for text up to U+024F, with its classes written out."""
    kind = lambda k: "".join(f"\\u{c:04x}" for c in range(WIDE) if unicodedata.category(chr(c))[0] == k)
    letter, number, space = kind("L"), kind("N"), "\\t-\\r \\u0085\\u00a0"
    return f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+| ?[{number}]+|[{space}]+(?![^{space}])|[{space}]+"


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One copy a Python worker, kept across its tasks."""
    return ByteBPE(path)


def count_symbols(bpe: ByteBPE, word: bytes) -> int:
    """Tokens of one word: its bytes less the merges made. The heap holds rank and place of adjacent pairs as one
    number; an entry whose place has changed meanwhile is passed over when it is popped."""
    n = len(word)
    if n < 2:
        return n
    word, get, shift = word.translate(bpe.byte_table), bpe.rank_of.get, n.bit_length()
    heap = [r << shift | i for i, r in enumerate(map(get, zip(word, word[1:]))) if r is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push, lefts, rights, news, low = heapq.heappop, heapq.heappush, bpe.left, bpe.right, bpe.new, (1 << shift) - 1
    sym, after, before = [*word, -1], list(range(1, n + 1)), list(range(-1, n))
    left = n
    while heap:
        x = pop(heap)
        i, rank = x & low, x >> shift
        if sym[i] != lefts[rank] or sym[j := after[i]] != rights[rank]:
            continue
        left -= 1
        sym[i] = new = news[rank]
        sym[j] = -2
        after[i] = k = after[j]
        before[k] = i
        if (r := get((new, sym[k]), -1)) >= 0:
            push(heap, r << shift | i)
        if i and (r := get((sym[h := before[i]], new), -1)) >= 0:
            push(heap, r << shift | h)
    return left


def encode_words(bpe: ByteBPE, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids, one after the other, and where each word's begin (with one bound more at the end).

    All words lie in one symbol array. ``places`` maps each active rank, that is each pair, to all its places; ranks
    are applied in ascending order, each to all its places at once, and the pairs that arise join their lists.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size)])
    n = int(start[-1])
    sym = np.empty(n + 1, np.int64)  # the last stands for "no neighbour"
    sym[:n], sym[n] = bpe.byte_ids[np.frombuffer(b"".join(words), np.uint8)], -1
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    some = size > 0
    after[start[1:][some] - 1], before[start[:-1][some]], after[n], before[n] = n, n, n, n
    rank = bpe.ranks(sym[:n], sym[after[:n]])
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0) :]
    cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    places: dict[int, list] = {int(rank[order[a]]): [order[a:b]] for a, b in zip(cuts, [*cuts[1:], len(order)])}
    active = list(places)
    heapq.heapify(active)
    syms, afters, befores, get = memoryview(sym), memoryview(after), memoryview(before), bpe.rank_of.get

    def join(q: int, where) -> None:
        if q in places:
            places[q].append(where)
        else:
            places[q] = [where]
            heapq.heappush(active, q)

    while active:
        r = heapq.heappop(active)
        lists = places.pop(r)
        at = np.sort(np.concatenate([np.atleast_1d(x) for x in lists if not isinstance(x, int)] + [np.array([x for x in lists if isinstance(x, int)], np.int64)]))
        a, b, new = bpe.left[r], bpe.right[r], bpe.new[r]
        if len(at) <= FEW:
            for i in at.tolist():
                if syms[i] != a or syms[j := afters[i]] != b:
                    continue
                syms[i], syms[j] = new, -2
                afters[i] = k = afters[j]
                befores[k] = i
                befores[n] = n
                if (q := get((new, syms[k]), -1)) >= 0:
                    join(q, i)
                if (q := get((syms[h := befores[i]], new), -1)) >= 0:
                    join(q, h)
            continue
        nxt = after[at]
        ok = (sym[at] == a) & (sym[nxt] == b)
        at, nxt = at[ok], nxt[ok]
        if a == b and len(at) > 1:  # in a run of equal symbols every second place merges
            keep, taken = [], -1
            for i, j in zip(at.tolist(), nxt.tolist()):
                if i != taken:
                    keep.append((i, j))
                    taken = j
            at, nxt = np.array(keep, np.int64).T
        if not len(at):
            continue
        sym[at], sym[nxt] = new, -2
        far, near = after[nxt], before[at]
        after[at] = far
        before[far] = at
        before[n] = n
        where, far = np.concatenate([at, near]), np.concatenate([far, at])
        got = bpe.ranks(sym[where], sym[far])
        hit = np.flatnonzero(got >= 0)
        order = hit[np.argsort(got[hit], kind="stable")]
        got, where = got[order], where[order]
        cuts = [*(np.flatnonzero(np.diff(got, prepend=-1))).tolist(), len(got)]
        for x, y in zip(cuts, cuts[1:]):
            join(int(got[x]), where[x:y])
    alive = sym[:n] >= 0
    return sym[:n][alive], np.concatenate([[0], np.cumsum(alive)])[start]
