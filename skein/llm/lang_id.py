"""Language ID by a small convolutional network over bytes, trained here in numpy.

A window is BLOCK places of a text; filters of several widths look at the bytes from each place on (so up to three
bytes beyond the block), each filter's largest answer in the window goes through a ReLU into a softmax. As the input
is one byte of 256 at each place, a filter is a sum of table lookups; for prediction the tables of two neighbouring
places become one table over byte pairs. A text's answer is the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from skein.llm.common import lean, reach_workers, read

WIDTHS = (2, 3, 4)
FILTERS = 8
BLOCK = 256
AHEAD = max(WIDTHS) - 1
#: Bytes whose windows are worked on together.
CHUNK = 1 << 19


@dataclass
class Model:
    labels: list[str]
    taps: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    dense: np.ndarray  # (features, labels)
    bias: np.ndarray


def _features(taps: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """x: (windows, BLOCK + AHEAD) bytes. Largest answers, and at which place they are."""
    top, where = [], []
    for t in taps:
        y = sum(t[j][x[:, j : j + BLOCK]] for j in range(len(t)))
        at = y.argmax(axis=1)
        where.append(at)
        top.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0, :])
    return np.concatenate(top, axis=1), where


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model | None:
    """Adam on cross-entropy; every third window is cut short so that brief texts are known too. None without texts."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    x = np.zeros((len(texts), BLOCK + AHEAD), np.uint8)
    for row, t in zip(x, texts):
        row[: min(len(t), len(row))] = np.frombuffer(t[: len(row)], np.uint8)
    y = np.searchsorted(labels, langs)
    share = np.bincount(y, minlength=len(labels))
    weight = (len(y) / (len(labels) * share))[y].astype(np.float32)
    p = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    p += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            xb = x[at].copy()
            for i in range(0, len(at), 3):
                xb[i, rng.integers(8, 128) :] = 0
            top, where = _features(p[: len(WIDTHS)], xb)
            feat = np.maximum(top, 0)
            z = _softmax(feat @ p[-2] + p[-1])
            z[np.arange(len(at)), y[at]] -= 1
            z *= weight[at, None] / len(at)
            back = (z @ p[-2].T) * (top > 0)
            grad = [np.zeros_like(a) for a in p]
            grad[-2][:], grad[-1][:] = feat.T @ z, z.sum(axis=0)
            rows, cols = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
            for g, w, at_w, b in zip(grad, WIDTHS, where, np.split(back, len(WIDTHS), axis=1)):
                for j in range(w):
                    np.add.at(g[j], (xb[rows, at_w + j], np.broadcast_to(cols, at_w.shape)), b)
            step += 1
            for a, g, mm, vv in zip(p, grad, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Model(labels, p[: len(WIDTHS)], p[-2], p[-1])


class Predictor:
    def __init__(self, model: Model):
        self.m = model
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.tables = [[(j, pair(t[j], t[j + 1]) if j + 1 < len(t) else t[j]) for j in range(0, len(t), 2)] for t in model.taps]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text, (texts, labels)."""
        size = np.array([len(t) for t in texts])
        wins = np.maximum(1, -(-(size + AHEAD) // BLOCK))  # at least AHEAD zeros follow each text
        first = np.concatenate([[0], np.cumsum(wins)])
        buf = np.zeros(first[-1] * BLOCK + AHEAD + 1, np.uint8)
        for t, k in zip(texts, first):
            buf[k * BLOCK : k * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
        out = np.zeros((len(texts), len(self.m.labels)))
        owner = np.repeat(np.arange(len(texts)), wins)
        at = np.arange(first[-1]) - first[:-1][owner]
        real = np.clip(size[owner] - at * BLOCK, 1, BLOCK)
        last = np.zeros(first[-1], bool)
        last[first[1:] - 1] = True
        step = max(1, CHUNK // BLOCK)
        for k in range(0, int(first[-1]), step):
            n = min(step, int(first[-1]) - k)
            b = buf[k * BLOCK : (k + n) * BLOCK + AHEAD + 1]
            two = b[:-1].astype(np.intp) << 8 | b[1:]
            top = []
            for tables in self.tables:
                y = None
                for j, t in tables:
                    got = np.take(t, (two if len(t) == 65536 else b)[j : j + n * BLOCK], axis=0)
                    y = got if y is None else np.add(y, got, out=y)
                y = y.reshape(n, BLOCK, FILTERS)
                y[last[k : k + n], BLOCK - AHEAD :] = -np.inf  # these places look into the next text
                top.append(y.max(axis=1))
            z = _softmax(np.maximum(np.concatenate(top, axis=1), 0) @ self.m.dense + self.m.bias)
            np.add.at(out, owner[k : k + n], z * real[k : k + n, None])
        return out / np.add.reduceat(real, first[:-1])[:, None]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 3 == 1


def fit(df: DataFrame, n_sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on one window each of about n_sample labelled texts (the bound on what the driver gathers), dealt evenly
    to the languages; which texts and windows depends on hashes of the id alone."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(n_sample).collect()
    if not counts:
        return None
    quota = n_sample / len(counts)
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, quota / r["n"]))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.length("text") - BLOCK, F.lit(1)).cast("long")) + 1
    got = rows.filter(drawn < part).select("doc_id", "lang", F.substring("text", start.cast("int"), F.lit(BLOCK + AHEAD)).alias("w")).limit(2 * n_sample).collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["w"]))
    return train([r["w"].encode() for r in got], [r["lang"] for r in got])


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (mean probability of lang_pred over the whole text), with no shuffle; then df's
    columns named in keep, under their own names, whatever they hold.

    und and 0.0 where the text is null or has no letter, or where there is no model (no labelled rows). Ids may be
    null or repeat; each row gives one row. Further columns are ignored; an empty table gives an empty result.
    """
    reach_workers(df.sparkSession)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    docs = df.select(F.col(id_col).alias("doc_id"), F.when(letter, F.col(text_col).cast("binary")).alias("raw"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    schema = StructType([docs.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), *docs.schema[2:]])

    def run(batches):
        ask = Predictor(model) if model else None
        for b in batches:
            raw = b.column(1)
            lang, score = ["und"] * len(raw), np.zeros(len(raw))
            todo, size = [], 0
            known = [i for i, ok in enumerate(raw.is_valid().to_pylist()) if ok] if ask else []
            for i in known:
                todo.append((i, raw[i].as_py()))
                size += len(todo[-1][1])
                if size >= 4 * CHUNK or i == known[-1]:
                    p = ask([t for _, t in todo])
                    for (k, _), best, row in zip(todo, p.argmax(axis=1), p):
                        lang[k], score[k] = ask.m.labels[best], min(1.0, row[best])
                    todo, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *b.columns[2:]], schema.names)

    return docs.mapInArrow(lean(run), schema).toDF("doc_id", "lang_pred", "score", *keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.filter(~held_out("doc_id"))))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
