"""Near-equal records by a byte-position inverted index with count filtering.

A record's set of word shingles is coded as a row of bytes, one per position:
a byte of the smallest value that the position's hash takes on the set.
Two records agree in a position with a probability equal to the Jaccard
similarity of their sets (plus 1/256).  The inverted index leads from a run of
neighbouring positions and its bytes to the records; a single byte would list
a 256th of all records, so the run is as long as keeps the lists short.  The
runs that a pair shares are tallied and pairs that reach the minimum number of
matches are kept; where a byte row is shorter than the set it stands for, all
its shared bytes are tallied as well; kept pairs are verified on their exact
sets.

The minimum is guaranteed with a stated probability: with ``runs`` runs of
``run`` bytes a pair at similarity s shares each run with probability s**run,
so a pair at the threshold is missed with probability
P(Binomial(runs, threshold**run) < least); :func:`miss` gives the figure.

Each text is read into its set once.  Records with equal sets form a class that
is indexed once, so a text copied to a third of all rows costs one entry.  Null
texts and texts of fewer tokens than a shingle has pair with nothing.  Keys that
repeat count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from folioflow.llm.common import mix64, slices
from folioflow.session import checkpoint

_TOKEN = re.compile(r"[^\W_]+")
CHARS = 1_000_000
#: Lists of the index up to this length are joined in their partition.
LONG_LIST = 400
#: Pairs that met are counted, and the ids of up to so many (16 MB at most) are broadcast.
MAX_BROADCAST_PAIRS = 2_000_000
#: Digests of classes of several rows are broadcast up to so many (some 40 MB at most).
MAX_BROADCAST_CLASSES = 500_000


def miss(threshold: float, run: int, runs: int, least: int) -> float:
    """Probability that a pair at the threshold does not reach ``least`` shared runs."""
    p = threshold**run
    return sum(math.comb(runs, i) * p**i * (1 - p) ** (runs - i) for i in range(least))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, text after text, and their numbers."""
    lists = [tokens(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    codes, words = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
    value = pd.util.hash_array(words.astype(object), categorize=False).astype(np.uint64)[codes]
    doc = np.repeat(np.arange(len(lists)), counts)
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mix64(h * np.uint64(3) + value[i : i + n])
    whole = doc[:n] == doc[size - 1 :]
    h, doc = h[whole], doc[:n][whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(texts)).astype(np.int64)


def byte_rows(h: np.ndarray, counts: np.ndarray, positions: int) -> np.ndarray:
    """One row of ``positions`` bytes for each text with a shingle."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 2**31, positions, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    h = (h >> np.uint64(32)).astype(np.uint32)
    some = counts[counts > 0]
    starts = np.cumsum(some) - some
    low = np.empty((positions, len(some)), np.uint32)
    room = np.empty_like(h)
    for j in range(positions):
        np.multiply(h, factors[j], out=room)
        np.minimum.reduceat(room, starts, out=low[j])
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T.copy()


def _signed(df: DataFrame, key: str, text: str, size: int, positions: int) -> DataFrame:
    """``key``, digest of the shingle set and the byte row; texts without shingles are left out.

    For 0 ``positions`` the set itself stands for its byte row, which is then made after equal
    sets are grouped: sets of short texts take less room than their byte rows.
    """
    kind = df.schema[key].dataType.simpleString()
    form = "sig binary" if positions else "sig array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for b, e in slices([len(t) for t in texts], CHARS):
                h, counts = shingle_hashes(texts[b:e], size)
                rows = np.flatnonzero(counts)
                if not len(rows):
                    continue
                starts = (np.cumsum(counts) - counts)[rows]
                d1 = np.add.reduceat(mix64(h), starts)
                d2 = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sig = pa.array([r.tobytes() for r in byte_rows(h, counts, positions)], pa.binary()) if positions else _lists(h, counts[rows])
                keys = batch.column(0).slice(b, e - b).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([keys, pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sig], [key, "d1", "d2", "sig"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text")).where(F.col(key).isNotNull() & F.col("_text").isNotNull())
    return rows.mapInArrow(run, f"{key} {kind}, d1 bigint, d2 bigint, {form}")


def _lists(h: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(h.view(np.int64)))


def _postings(classes: DataFrame, run_length: int, runs: int) -> DataFrame:
    """(k, id): the index entries of each class, one for each run of byte positions."""
    late = classes.schema["sig"].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 2048):
                part = batch.slice(b, 2048)
                n = part.num_rows
                if late:
                    sets = part.column(1)
                    sig = byte_rows(sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), runs * run_length)
                else:
                    sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, runs * run_length)
                k = np.zeros((n, runs), np.uint64)
                for i in range(run_length):
                    k = mix64(k) + sig[:, i::run_length] if i >= 7 else (k << np.uint64(8)) | sig[:, i::run_length]
                k = mix64(k + (np.arange(runs, dtype=np.uint64) << np.uint64(57)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(runs, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), runs)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(ids)], ["k", "id"])

    return classes.select("id", "sig").mapInArrow(run, "k bigint, id int")


def _met(entries: DataFrame, least: int) -> DataFrame:
    """Pairs of ids (a < b) that share at least ``least`` keys.

    Entries arrive sorted by key and only the list of one key is held, up to
    ``LONG_LIST``; the entries of a longer list are handed on one by one to a
    join, which is split where it is skewed.
    """
    names = ["a", "b", "k"]

    def handed_on(k: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.nulls(len(i), pa.int32()), pa.array(k)], names)

    def pairs_of(k: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, len(k)))
        for n in np.unique(size[size > 1]).tolist():
            at = begin[size == n]
            if n > LONG_LIST:
                for b in at.tolist():
                    yield handed_on(k[b : b + n], i[b : b + n])
                continue
            x, y = np.triu_indices(n, 1)
            step = max(1, 500_000 // len(x))
            for c in range(0, len(at), step):
                rows = i[at[c : c + step, None] + np.arange(n)[None, :]]
                u, v = rows[:, x].ravel(), rows[:, y].ravel()
                keep = u != v
                u, v = np.minimum(u, v)[keep], np.maximum(u, v)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_i = np.zeros(0, np.int64), np.zeros(0, np.int32)
        long: int | None = None
        for batch in batches:
            k, i = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if long is not None:
                n = int(np.searchsorted(k, long, "right"))
                if n:
                    yield handed_on(k[:n], i[:n])
                k, i = k[n:], i[n:]
            if not len(k):
                continue
            long = None
            k, i = np.concatenate([held_k, k]), np.concatenate([held_i, i])
            last = int(np.searchsorted(k, k[-1], "left"))
            yield from pairs_of(k[:last], i[:last]) if last else ()
            held_k, held_i = k[last:], i[last:]
            if len(held_k) > LONG_LIST:
                yield handed_on(held_k, held_i)
                long = int(held_k[0])
                held_k, held_i = held_k[:0], held_i[:0]
        if len(held_k):
            yield from pairs_of(held_k, held_i)

    lists = entries.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a int, b int, k bigint").persist(StorageLevel.DISK_ONLY)
    long = lists.where("k IS NOT NULL").select("k", "a")
    pairs_of_long = long.join(long.select("k", F.col("a").alias("b")), "k").where("a < b").select("a", "b")
    pairs_met = lists.where("k IS NULL").select("a", "b").unionByName(pairs_of_long)
    met = checkpoint(pairs_met.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("a", "b"))
    lists.unpersist()
    return met


def least_matches(threshold: float, positions: int, sigmas: float = 4.5) -> int:
    """Positions in which a pair at the threshold agrees, but for a chance of 0.000004."""
    p = threshold + (1 - threshold) / 256
    return int(positions * p - sigmas * math.sqrt(positions * p * (1 - p)))


def _tallied(met: DataFrame, rows: DataFrame, threshold: float, positions: int) -> DataFrame:
    """Pairs whose byte rows agree in the least number of positions or more."""
    rows = rows.join(_some(met), "id", "left_semi")
    both = met.join(rows.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(rows.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    least = least_matches(threshold, positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, positions) for i in (2, 3))
            keep = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a int, b int").distinct()


def _short(key: Column) -> Column:
    """32 bits for a key: entries stay short, and keys that share them are told apart on verifying."""
    return F.shiftright(F.xxhash64(key.cast("string")), 32).cast("int")


def _some(met: DataFrame) -> DataFrame:
    """The ids of the pairs that met, broadcast where their number allows it."""
    ids = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    return F.broadcast(ids) if met.count() <= MAX_BROADCAST_PAIRS else ids


def _sets_of_texts(rows: DataFrame, size: int) -> DataFrame:
    """(id, key, set) of texts (id, key, text)."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for b, e in slices([len(t) for t in texts], CHARS):
                h, counts = shingle_hashes(texts[b:e], size)
                part = batch.slice(b, e - b)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(h, counts)], ["id", "key", "set"])

    return rows.select("id", "key", "text").mapInArrow(run, f"id int, key {kind}, set array<bigint>")


class Near(NamedTuple):
    """``keys``: all keys with a set; ``copies`` (key, ``class``): the members of classes of several rows, each other
    key being its own class; ``links`` (``a``, ``b``) between class representatives."""

    keys: DataFrame
    copies: DataFrame
    links: DataFrame


def near(df: DataFrame, key: str, text: str, size: int, threshold: float, run: int, runs: int, least: int, late: bool = False) -> Near:
    """Classes of equal sets and verified links between them.

    ``late``: for texts whose set is shorter than a byte row; the set is kept and its byte row made when the index is.
    """
    # tables used twice are written to the shared folder, which also keeps the plans short
    signed = checkpoint(_signed(df, key, text, size, 0 if late else run * runs))
    several = checkpoint(signed.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(key).alias("class")).where("n > 1").drop("n"))
    few = several.count() <= MAX_BROADCAST_CLASSES
    digests = F.broadcast(several) if few else several
    single = signed.join(digests.select("d1", "d2"), ["d1", "d2"], "left_anti").select(F.col(key).alias("class"), "sig")
    first = signed.join(digests, ["d1", "d2"]).groupBy("class").agg(F.any_value("sig").alias("sig"))
    grouped = single.unionByName(first).withColumn("id", _short(F.col("class")))
    if not few:
        grouped = checkpoint(grouped)
    copies = signed.select(key, "d1", "d2").join(digests, ["d1", "d2"]).select(key, "class").distinct()

    met = _met(_postings(grouped, run, runs), least)
    if late:
        sets = grouped.join(_some(met), "id", "left_semi").select("id", F.col("class").alias("key"), F.col("sig").alias("set"))
    else:
        met = checkpoint(_tallied(met, grouped.select("id", "sig"), threshold, run * runs))
        # the records that met are few beside all records: where their number allows it, the texts of the others aren't shuffled
        texts = df.select(_short(F.col(key)).alias("id"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
        sets = _sets_of_texts(texts.join(_some(met), "id", "left_semi").dropDuplicates(["key"]), size)
    sets = checkpoint(sets)
    left = sets.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("set").alias("sb"))
    both = met.join(left, "a").join(right, "b").where("ka <> kb")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = shared / (F.size("sa") + F.size("sb") - shared) >= threshold - 1e-12
    links = checkpoint(both.where(alike).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct())
    return Near(signed.select(key), copies, links)


def _set(text: str, size: int) -> set:
    t = tokens(text)
    return set(t) if size == 1 else set(zip(*(t[i:] for i in range(size))))


def _jaccard(x: str, y: str, size: int) -> float:
    a, b = _set(x, size), _set(y, size)
    return len(a & b) / len(a | b) if a and b else 0.0


def pairs(found: Near, key: str) -> DataFrame:
    """All near-equal pairs of keys: links spread over their classes, and pairs inside classes."""
    a = found.copies.select(F.col(key).alias("x"), F.col("class").alias("a"))
    b = found.copies.select(F.col(key).alias("y"), F.col("class").alias("b"))
    across = found.links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    inside = a.join(b.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def summary(found: Near, key: str) -> DataFrame:
    """One row per key: its class of equal sets, the class's size and its number of links."""
    members = found.keys.distinct().join(found.copies, key, "left").select(key, F.coalesce("class", key).alias("class"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    ends = found.links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(found.links.select(F.col("b").alias("class"), F.col("a").alias("other")))
    far = ends.join(sizes.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("far"))
    per = sizes.join(far, "class", "left").select("class", "copies", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).cast("bigint").alias("n_links"))
    return members.join(per, "class").select(key, F.col("class").alias("class_id"), "copies", "n_links")
