"""Long exact spans that records share.

Each text is cut into content-defined units: the positions whose hash of ``K``
signs is the smallest of ``W`` neighbours.  A run of ``K + W - 1`` equal signs,
``least`` at most, has the same cuts wherever it lies, so spans that begin or
end inside a line are met too, which line or paragraph units would miss.  Unit
digests are grouped globally; around a unit that lies in two records, the whole
field of windows of ``least`` signs that hold it is digested (one digest where
the field itself recurs, one per window where it does not), and digests that
lie in two records mark shared positions.  Offsets are code points of the
original text.

Groups are only ever combined by minimum and maximum of the record's id, so a
passage in a third of all records is no hot spot.  Null texts and texts shorter
than ``least`` share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from folioflow.llm.common import code_points, mix64, powers, slices

LEAST = 200
K = 100
W = LEAST - K + 1
CHARS = 1_000_000
#: Units with up to so many different surroundings are compared inside a partition.
MANY_FIELDS = 2000


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over each window of ``w`` neighbours, from running values of blocks."""
    n = len(x)
    rows = np.concatenate([x, np.full((-n) % w, fill, x.dtype)]).reshape(-1, w)
    left = op.accumulate(rows, axis=1).ravel()
    right = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


class Batch:
    """Texts laid end to end, with prefix sums from which any run's hash follows."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.begin = self.end - size
        cp = code_points("".join(texts))
        self.n = n = len(cp)
        self.h = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(cp.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.h[1:])
        self.inv = powers(n + 1, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.h[end] - self.h[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, position in the batch and hash of every cut.

        A position is cut if its hash is the least of a window of W positions
        that holds it.  Windows over the end of a text can only add cuts.
        """
        m = self.n - K + 1
        if m < W:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, np.uint64)
        h = self.of(np.arange(m), np.arange(m) + K)
        low = _sliding(h, W, np.minimum, 2**64 - 1)
        edge = np.zeros(W - 1, np.uint64)
        high = _sliding(np.concatenate([edge, low, edge]), W, np.maximum, 0)
        at = np.flatnonzero(high == h)
        text = np.searchsorted(self.end, at, "right")
        whole = at + K <= self.end[text]
        return text[whole], at[whole], h[at[whole]]


def _cut_table(docs: DataFrame, key: str, kind: str) -> DataFrame:
    """(s, u, doc, pos): unit hash, digest of the field around it, record and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for b, e in slices([len(t) for t in texts], CHARS):
                x = Batch(texts[b:e])
                t, at, s = x.cuts()
                low = np.maximum(at + K - LEAST, x.begin[t])
                u = mix64(x.of(low, np.minimum(at + LEAST, x.end[t])) + (at - low).astype(np.uint64))
                keys = batch.column(0).slice(b, e - b).take(pa.array(t))
                pos = pa.array((at - x.begin[t]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(u.view(np.int64)), keys, pos], ["s", "u", "doc", "pos"])

    return docs.mapInArrow(run, f"s bigint, u bigint, doc {kind}, pos int")


def _window_table(asked: DataFrame, kind: str) -> DataFrame:
    """(s, doc, low, dmin, dmax, ws): digests of the windows of ``LEAST`` signs from ``low`` on around each asked position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "doc", "low", "dmin", "dmax", "ws"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for b, e in slices([len(t) for t in texts], CHARS):
                part = batch.slice(b, e - b)
                x = Batch(texts[b:e])
                pos = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + x.begin
                low = np.maximum(pos + K - LEAST, x.begin)
                n = np.minimum(pos, x.end - LEAST) - low + 1
                ends = np.cumsum(n)
                start = np.repeat(low - (ends - n), n) + np.arange(int(ends[-1]))
                w = x.of(start, start + LEAST)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(w.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(5), part.column(0), pa.array((low - x.begin).astype(np.int32)), part.column(3), part.column(4), lists], names)

    return asked.mapInArrow(run, f"s bigint, doc {kind}, low int, dmin {kind}, dmax {kind}, ws array<bigint>")


def _same_windows(windows: DataFrame, kind: str) -> DataFrame:
    """(doc, begin_at, end_at, later) of runs of windows that two records hold, found inside partitions by ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        lists = t.column("ws").combine_chunks()
        w = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        # ids as ranks, so that any type of key is compared alike
        ids = pa.concat_arrays([t.column(c).combine_chunks() for c in ("doc", "dmin", "dmax")]).to_numpy(zero_copy_only=False)
        rank = np.unique(ids, return_inverse=True)[1]
        doc, low_id, high_id = np.split(rank, 3)
        order = np.argsort(w, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(w[order]) != 0]))
        least = np.minimum.reduceat(low_id[row[order]], first)
        most = np.maximum.reduceat(high_id[row[order]], first)
        group = np.cumsum(np.concatenate([[0], (np.diff(w[order]) != 0).astype(np.int64)]))
        state = np.zeros(len(w), np.int8)
        later = least[group] < doc[row[order]]
        state[order] = np.where(least[group] < most[group], np.where(later, 2, 1), 0)
        # a field that recurs is found as a whole, but parts of it may be earlier elsewhere
        state[(low_id != high_id)[row] & (state != 2)] = 0
        change = np.concatenate([[True], (state[1:] != state[:-1]) | (row[1:] != row[:-1])])
        begin = np.flatnonzero(change)
        end = np.append(begin[1:], len(w)) - 1
        keep = state[begin] > 0
        begin, end = begin[keep], end[keep]
        offset = np.cumsum(size) - size
        low = t.column("low").to_numpy()
        r = row[begin]
        yield pa.RecordBatch.from_arrays(
            [t.column("doc").combine_chunks().take(pa.array(r)), pa.array((low[r] + begin - offset[r]).astype(np.int32)), pa.array((low[r] + end - offset[r] + LEAST).astype(np.int32)), pa.array(state[begin] == 2)],
            ["doc", "begin_at", "end_at", "later"],
        )

    return windows.repartition("s").mapInArrow(run, f"doc {kind}, begin_at int, end_at int, later boolean")


def shared(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``begin_at``, ``end_at``, ``later``: shared stretches, not merged yet.

    ``later`` tells that a record with a smaller key holds the stretch too.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.where(F.col(key).isNotNull() & (F.length(text) >= LEAST)).select(F.col(key).alias("doc"), F.col(text).alias("_text"))
    seeds = _cut_table(docs, key, kind)
    both = seeds.groupBy("s").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("s")
    rows = seeds.join(both, "s").persist(StorageLevel.DISK_ONLY)
    fields = rows.groupBy("s", "u").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("dmax"))
    fields = fields.select("s", "u", F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos"), F.col("first.doc").alias("dmin"), "dmax").persist(StorageLevel.DISK_ONLY)
    # fields that recur as a whole
    whole = rows.join(fields.where("dmin < dmax").select("s", "u", "dmin"), ["s", "u"]).select(
        "doc", F.greatest(F.col("pos") + K - LEAST, F.lit(0)).alias("begin_at"), (F.col("pos") + LEAST).alias("end_at"), (F.col("dmin") < F.col("doc")).alias("later")
    )
    # around the others, window by window; one record stands for all with the same field
    edges = fields.groupBy("s").agg(F.max(F.col("dmin") == F.col("dmax")).alias("edge"), F.count("*").alias("n")).where("edge OR n > 1").select("s", "n")
    # of a field in one record all places are asked for, of one in several records those of the first
    places = rows.join(fields.select("s", "u", F.col("doc").alias("fdoc"), "dmin", "dmax"), ["s", "u"]).where("dmin = dmax OR doc = fdoc")
    ask = places.join(edges, "s").select("s", "doc", "pos", "dmin", "dmax", "n").persist(StorageLevel.DISK_ONLY)
    few = docs.join(ask.where(F.col("n") <= MANY_FIELDS), "doc").select("doc", "_text", "pos", "dmin", "dmax", "s")
    parts = _same_windows(_window_table(few, kind), kind)
    # a unit with very many different fields is no group of one task: its windows are grouped one by one
    if not ask.where(F.col("n") > MANY_FIELDS).isEmpty():
        many = docs.join(ask.where(F.col("n") > MANY_FIELDS), "doc").select("doc", "_text", "pos", "dmin", "dmax", "s")
        windows = _window_table(many, kind).persist(StorageLevel.DISK_ONLY)
        hit = windows.select(F.explode("ws").alias("w"), "dmin", "dmax").groupBy("w").agg(F.min("dmin").alias("a"), F.max("dmax").alias("b")).where("a < b")
        own = windows.select("doc", "low", (F.col("dmin") == F.col("dmax")).alias("single"), F.posexplode("ws").alias("i", "w")).select("w", "doc", "single", (F.col("low") + F.col("i")).alias("start"))
        parts = parts.unionByName(own.join(hit, "w").where("single OR a < doc").select("doc", F.col("start").alias("begin_at"), (F.col("start") + LEAST).alias("end_at"), (F.col("a") < F.col("doc")).alias("later")))
    ends = docs.select("doc", F.length("_text").alias("n"))
    found = whole.join(ends, "doc").select("doc", "begin_at", F.least("end_at", "n").alias("end_at"), "later").unionByName(parts)
    return found.select(F.col("doc").alias(key), "begin_at", "end_at", "later")


def merge(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping or touching stretches of each record as one row."""
    w = Window.partitionBy(key).orderBy("begin_at", "end_at")
    before = F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("begin_at") > before), 1).otherwise(0)
    runs = spans.select(key, "begin_at", "end_at").distinct().withColumn("_new", new)
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("begin_at").alias("begin_at"), F.max("end_at").alias("end_at")).select(key, F.col("begin_at").cast("int"), F.col("end_at").cast("int"))
