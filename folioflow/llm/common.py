"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per ``key``: the one with the last ``at`` (ties: any, the rows are equal).

    Rows with a null key are kept out.  Aggregation by key, so a key repeated
    many times is combined before the shuffle.
    """
    cols = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(f"`{c}`") for c in cols])
    order = F.coalesce(F.col(at).cast("timestamp"), F.lit("1900-01-01").cast("timestamp"))
    out = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(packed, order).alias("_r"))
    )
    return out.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in cols])


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` where repeated rows are equal in the columns at hand."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows whose summed length stays near ``limit``."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash, for uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    p = np.full(n, _INV if inverse else _BASE, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``, equal for equal runs wherever they lie."""
    n = len(values)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * powers(n), out=h[1:])
    inv = powers(n + 1, inverse=True)
    out = (h[ends] - h[starts]) * inv[starts]
    return mix64(out + (ends - starts).astype(np.uint64))


def row_number(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
