"""Plain-Python statements of what the operators compute, for small inputs."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def repeats(rows, length=50):
    """rows of (doc_id, text): (n_bytes, n_removed, n_spans, kept) of each"""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            k = b[i : i + length]
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(rows, k, percent):
    """rows of (doc_id, text): doc_id -> (n_shingles, component_id)"""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(n)
    common = Counter()
    for held in index.values():
        common.update(itertools.combinations(held, 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((find(sets[a][0]), find(sets[b][0])))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def edits(pattern, text):
    """Fewest edits that align the pattern with some part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
