"""Filling windows of fixed capacity with related documents.

Documents are spread over shards of bounded volume.  In each shard a BM25
inverted index is built; the largest unused document becomes the seed of a
window, the index returns its unused neighbours, which fill the window greedily
in order of score as far as they fit, and the rest of the room goes to the
largest unused pieces that fit.  A document is split only if it alone exceeds
the capacity: its full pieces are windows of their own, its remainder is packed
like any other document.

Defined results: null and empty texts have no tokens and lie in the first
window of their shard; every document comes out once (or once per piece).
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.bpe import CHARS, TOKENIZER_DIR, Encoder, Vocabulary, load_vocabulary
from folioflow.llm.common import slices

CAPACITY = 2048
#: Characters per shard: bounds a task's memory whatever the corpus's size.
SHARD_CHARS = 6_000_000
K1, B = 1.2, 0.75
_TERM = re.compile(r"[^\W\d_]{3,}")


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, texts: list[str]):
        terms: dict[str, int] = {}
        doc, term, tf = [], [], []
        length = np.zeros(len(texts))
        for i, t in enumerate(texts):
            c = Counter(_TERM.findall(t.lower()))
            length[i] = sum(c.values())
            for w, n in c.items():
                term.append(terms.setdefault(w, len(terms)))
                tf.append(n)
            doc.append(np.full(len(c), i, np.int32))
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int32)
        term_, tf_ = np.array(term, np.int64), np.array(tf, np.float64)
        df = np.bincount(term_, minlength=len(terms))
        idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9)) if len(texts) else length
        weight = idf[term_] * tf_ * (K1 + 1) / (tf_ + norm[self.doc])
        # by document for the query, by term for the lists
        self.of_doc = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.term = term_
        order = np.argsort(term_, kind="stable")
        self.list_doc, self.list_weight = self.doc[order], weight[order]
        self.of_term = np.searchsorted(term_[order], np.arange(len(terms) + 1))
        self.useful = (idf > 0.7) & (df > 1)

    def neighbours(self, i: int, n: int) -> np.ndarray:
        """All documents that share a telling term with document ``i``, best first."""
        t = self.term[self.of_doc[i] : self.of_doc[i + 1]]
        t = t[self.useful[t]]
        if not len(t):
            return np.zeros(0, np.int64)
        b, e = self.of_term[t], self.of_term[t + 1]
        size = e - b
        at = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.list_doc[at], self.list_weight[at], n)
        hit = np.flatnonzero(score)
        return hit[np.lexsort((hit, -score[hit]))]


def pack(ids: list, texts: list[str], sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(window, item, piece, first token, end token) of all pieces of a shard."""
    n = len(ids)
    out: list[tuple[int, int, int, int, int]] = []
    window = 0
    rest = np.zeros(n, np.int64)
    for i, s in enumerate(sizes.tolist()):
        full = s // capacity if s > capacity else 0
        for p in range(full):
            out.append((window, i, p + 1, p * capacity, (p + 1) * capacity))
            window += 1
        rest[i] = s - full * capacity
    items = [i for i in range(n) if rest[i] > 0]
    index = Index(texts)
    free = sorted((int(rest[i]), i) for i in items)
    used = np.zeros(n, bool)
    first = window

    def place(i: int) -> None:
        s = int(sizes[i])
        base = s - int(rest[i])
        out.append((window, i, base // capacity + 1, base, s))
        used[i] = True
        free.pop(bisect.bisect_left(free, (int(rest[i]), i)))

    while free:
        room, seed = capacity, free[-1][1]
        room -= int(rest[seed])
        place(seed)
        if free and free[0][0] <= room:
            near = index.neighbours(seed, n)
            near = near[(~used[near]) & (rest[near] > 0) & (rest[near] <= room)]
            # neighbours that leave less than a small document's room beside them first
            for i in near.tolist():
                gap = room - int(rest[i])
                if gap >= 0 and (gap <= capacity // 50 or (free and gap >= free[0][0] + capacity // 8)):
                    place(i)
                    room = gap
                    if not free or free[0][0] > room:
                        break
        while free and free[0][0] <= room:
            at = bisect.bisect_right(free, (room, n)) - 1
            i = free[at][1]
            room -= int(rest[i])
            place(i)
        window += 1
    empty = [i for i in range(n) if sizes[i] == 0]
    if empty and window == first == 0:
        window = 1
    out += [(0, i, 1, 0, 0) for i in empty]
    return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, shared: Broadcast) -> Encoder:
    """The vocabulary is read once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(Vocabulary(shared.value))
    return _ENCODERS[path]


def containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(container, key, piece, begin_tok, end_tok) of every document; sizes in tokens of the public tokenizer."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    path = path or f"{TOKENIZER_DIR}/byte_bpe_50k.json"
    shared = spark.sparkContext.broadcast(load_vocabulary(path))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    volume = rows.agg(F.sum(F.length("_text")).alias("c"), F.count("*").alias("n")).first()
    shards = max(1, -(-max(volume["c"] or 0, 200 * (volume["n"] or 0)) // SHARD_CHARS))

    def run(whole: pd.DataFrame) -> pd.DataFrame:
        whole = whole.sort_values(key)
        texts = whole["_text"].tolist()
        e = _encoder(path, shared)
        sizes = np.concatenate([e.encode(texts[x:y])[1] for x, y in slices([len(t) for t in texts], CHARS)])
        ids = whole[key].tolist()
        placed = pack(ids, texts, sizes, capacity)
        shard = int(whole["_shard"].iloc[0])
        return pd.DataFrame({
            "container": [f"{shard:06d}-{w:06d}" for w, *_ in placed], key: pd.array([ids[i] for _, i, *_ in placed], whole[key].dtype),
            "piece": [p for _, _, p, _, _ in placed], "begin_tok": [x for *_, x, _ in placed], "end_tok": [x for *_, x in placed],
        })

    # a partition for each shard: the number given keeps shards from being gathered in one task
    sharded = rows.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards))).repartition(int(shards), "_shard")
    return sharded.groupBy("_shard").applyInPandas(run, f"container string, {key} {kind}, piece int, begin_tok int, end_tok int")
