"""BPE encoding and decoding through an index from pairs to all their places in a block of words."""

from __future__ import annotations

import hashlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe
from skein.llm.common import lean, reach_workers, read

#: Words whose ids a worker keeps, and bytes in them; beyond, it forgets all and starts anew.
MEMO, MEMO_BYTES = 250_000, 4 << 20
#: Characters of text whose new words are merged together (a longer text is a block of its own).
BLOCK = 2_000_000


class Numbers(dict):
    """From a word to its number, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Codec:
    """Encodes and decodes whole texts; per word it keeps the ids (as decimal text) and the bytes that they decode to."""

    def __init__(self, path: str):
        self.bpe = bpe.load(path)
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.raw, self.held = Numbers(), [], [], 0
        for s, i in self.bpe.special.items():
            self.number[s]
            self.ids.append(str(i))
            self.raw.append(self.bpe.id_bytes[i])

    def learn(self) -> None:
        """Ids and decoded bytes of the words that have a number only."""
        new = [w.encode() for w in islice(self.number, len(self.ids), None)]
        self.held += sum(map(len, new))
        got, bound = bpe.encode_words(self.bpe, new)
        got, bound, of = got.tolist(), bound.tolist(), self.bpe.id_bytes
        texts = list(map(str, got))
        parts = list(map(of.__getitem__, got))
        self.ids += [",".join(texts[a:b]) for a, b in zip(bound, bound[1:])]
        self.raw += [b"".join(parts[a:b]) for a, b in zip(bound, bound[1:])]

    def block(self, texts: list[str]):
        """For each text its ids, as decimals with commas, and what they decode to."""
        if len(self.ids) > MEMO or self.held > MEMO_BYTES:
            self.forget()
        at, docs = self.number.__getitem__, []
        for t in texts:
            words = array("i")
            for piece, special in self.bpe.pieces(t):
                words.extend([at(piece)] if special else map(at, self.bpe.split(piece)))
            docs.append(words)
        self.learn()
        ids, raw = self.ids.__getitem__, self.raw.__getitem__
        for words in docs:
            yield ",".join(map(ids, words)), b"".join(map(raw, words))


_CODECS: dict[str, Codec] = {}


def blocks(texts: list[str], most: int = BLOCK):
    """The texts in runs of about so many characters (a longer text is a run of its own)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(df: DataFrame, vocabulary: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", keep_decoded: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text), and
    with keep_ids also token_ids (array), with keep_decoded (if not given: as keep_ids) decoded (string). There is no
    shuffle, and a worker holds the results of one block of text at a time.

    Null text is encoded as empty. Ids may be null or repeat; each row gives one row. Further columns are ignored; an
    empty table gives an empty result. Whole texts are encoded.
    """
    reach_workers(df.sparkSession)
    keep_decoded = keep_ids if keep_decoded is None else keep_decoded
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * keep_ids, *["decoded"] * keep_decoded]

    def run(batches):
        codec = _CODECS.get(vocabulary) or _CODECS.setdefault(vocabulary, Codec(vocabulary))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            at = 0
            for some in blocks(b.column(1).to_pylist()):
                n, ids, back, lists, texts = [], [], [], [], []
                for numbers, raw in codec.block(some):
                    n.append(numbers.count(",") + 1 if numbers else 0)
                    ids.append(sha(numbers.encode()))
                    back.append(sha(decoded := raw.decode("utf-8", "replace").encode()))
                    if keep_ids:
                        lists.append(np.fromstring(numbers, np.int32, sep=","))
                    if keep_decoded:
                        texts.append(decoded.decode())
                more = [pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), np.concatenate(lists))] if keep_ids else []
                more += [pa.array(texts, pa.string())] if keep_decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), *more], names)
                at += len(some)
        codec.forget()  # this worker stays for other stages

    return docs.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids + ", decoded string" * keep_decoded)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
