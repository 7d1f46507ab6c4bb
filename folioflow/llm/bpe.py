"""Byte-level BPE encoding of a corpus by a pair occurrence index.

Texts are cut into words by array operations over code points, distinct words
are found by a rolling hash, and the words that a partition has not met yet are
merged together: a map leads from each active pair to all its positions in the
batch, active ranks are applied in ascending order, and the lists of the pairs
beside each merge are updated.  The vocabulary file is read by the driver from
a path parameter and broadcast; its size is that of the public vocabulary.

Defined results: an empty text and a null text both have the empty list.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import code_points, run_hashes, slices

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Code points handled at once; bounds the arrays of a worker to some 100 MB.
CHARS = 1_000_000
#: The vocabulary is broadcast only below this size.
MAX_VOCABULARY_BYTES = 64 << 20

_CLASSES: np.ndarray | None = None
_LETTER, _NUMBER, _SPACE = 1, 2, 3
#: The code points of the property White_Space.
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        t = np.zeros(0x110000, np.uint8)
        cat = unicodedata.category
        for c in range(0x110000):
            k = cat(chr(c))[0]
            if k == "L":
                t[c] = _LETTER
            elif k == "N":
                t[c] = _NUMBER
        t[list(_WHITE)] = _SPACE
        _CLASSES = t
    return _CLASSES


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges of a byte-level BPE as numbers: pair of ids -> rank, rank -> (a, b, new id)."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        ids = model["vocab"]
        self.byte_id = [0] * 256
        for shown, b in byte_alphabet().items():
            self.byte_id[b] = ids[shown]
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((ids[a], ids[b], ids[a + b]))
            self.rank[ids[a] << 32 | ids[b]] = r
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        ranks = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]
        self._bytes = np.array(self.byte_id, np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        joined = b"".join(words)
        n = len(joined)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not n:
            return np.zeros(0, np.int64), sizes
        first = self._bytes[np.frombuffer(joined, np.uint8)]
        ends = np.cumsum(sizes)
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        # the index: rank of the pair -> positions of the pair's left symbol
        key = first[:-1] << 32 | first[1:]
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        rank = np.where((self._keys[at] == key) & ~last[:-1], self._ranks[at], -1)
        where = np.flatnonzero(rank >= 0)
        where = where[np.argsort(rank[where], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[where])) + 1
        index: dict[int, list[int]] = {int(rank[p[0]]): p.tolist() for p in np.split(where, cuts) if len(p)}
        active = list(index)
        heapq.heapify(active)
        symbol = first.tolist()
        right = np.where(last, -1, np.arange(1, n + 1)).tolist()
        left = np.concatenate([[-1], np.where(last[:-1], -1, np.arange(n - 1))]).tolist()
        ranks, merges = self.rank, self.merges
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            a, b, new = merges[r]
            places.sort()
            for p in places:
                q = right[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -1
                after, before = right[q], left[p]
                right[p] = after
                if after >= 0:
                    left[after] = p
                    k = ranks.get(new << 32 | symbol[after])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heapq.heappush(active, k)
                if before >= 0:
                    k = ranks.get(symbol[before] << 32 | new)
                    if k is not None:
                        if k in index:
                            index[k].append(before)
                        else:
                            index[k] = [before]
                            heapq.heappush(active, k)
        done = np.array(symbol, np.int64)
        alive = done >= 0
        counts = np.zeros(len(words), np.int64)
        some = sizes > 0
        counts[some] = np.add.reduceat(alive.astype(np.int64), (ends - sizes)[some])
        return done[alive], counts


def words_of(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the words into which the public pattern cuts each text.

    ``doc_starts`` holds the start of each non-empty text in ``cp``.
    """
    n = len(cp)
    cls = _classes()[cp]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    begins = np.concatenate([[True], cls[1:] != cls[:-1]]) | first
    start = begins.copy()
    # white space before other text: its last sign stands alone or, if a blank, joins the word
    ws = cls == _SPACE
    before = np.flatnonzero(ws[:-1] & ~ws[1:] & ~first[1:])
    start[before] = True
    start[before + 1] = cp[before] != 32
    # contractions, where a word begins with an apostrophe
    q = np.flatnonzero((cp == 39) & start)
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    c1 = cp[q + 1]
    short = np.isin(c1, [ord(c) for c in "stmd"])
    c2 = np.where(q + 2 < n, cp[np.minimum(q + 2, n - 1)], 0)
    c2 = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n - 1)], c2, 0)
    long = ~short & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
    for pick, size in ((short, 2), (long, 3)):
        p = q[pick]
        start[p + 1] = False
        e = p + size
        start[e[e < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches of texts, remembering the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offset = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, text: str) -> None:
        ids, sizes = self.v.encode_words([text[b:e].encode("utf-8", "surrogatepass") for b, e in zip(begin.tolist(), end.tolist())])
        n = len(self.size)
        self.known.update(zip(hashes.tolist(), range(n, n + len(sizes))))
        self.offset = np.concatenate([self.offset, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the number of ids of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = np.zeros(len(texts), np.int64)
        if not lengths.sum():
            return np.zeros(0, np.int32), counts
        if len(self.size) > 2_000_000:
            self.forget()
        text = "".join(texts)
        cp = code_points(text)
        doc_end = np.cumsum(lengths)
        some = lengths > 0
        starts = words_of(cp, (doc_end - lengths)[some])
        ends = np.append(starts[1:], len(cp))
        codes, unique = pd.factorize(run_hashes(cp, starts, ends))
        at = np.zeros(len(unique), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        known = self.known
        word = np.fromiter((known.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        fresh = np.flatnonzero(word < 0)
        if len(fresh):
            word[fresh] = len(self.size) + np.arange(len(fresh))
            self._learn(unique[fresh], starts[at[fresh]], ends[at[fresh]], text)
        word = word[codes]
        size = self.size[word]
        total = np.cumsum(size)
        flat = self.ids[np.repeat(self.offset[word] - (total - size), size) + np.arange(int(total[-1]))]
        counts[some] = np.add.reduceat(size, np.searchsorted(starts, (doc_end - lengths)[some]))
        return flat, counts


def load_vocabulary(path: str) -> str:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary larger than {MAX_VOCABULARY_BYTES} bytes: {path}")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(df: DataFrame, key: str, text: str, path: str, counts_only: bool) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, " + ("n_tokens int" if counts_only else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = Encoder(Vocabulary(shared.value))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for b, e in slices([len(t) for t in texts], CHARS):
                ids, counts = encoder.encode(texts[b:e])
                keys = batch.column(0).slice(b, e - b)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int32))], ["k", "n"]).rename_columns([key, "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, lists], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias(text if text != key else "text")).mapInArrow(run, out)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens."""
    return _encoded(df, key, text, path or f"{TOKENIZER_DIR}/byte_bpe_50k.json", False)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every row."""
    return _encoded(df, key, text, path or f"{TOKENIZER_DIR}/byte_bpe_50k.json", True)
