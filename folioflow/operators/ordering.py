"""Order inside documents of any size.

Windows over a whole document put it into one task, and one document may hold a
tenth of all rows.  Here a document is cut into buckets: rows are looked at
inside their bucket, what a bucket says about those after it is a single row,
and only these rows are brought together per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a bucket.
SPAN = 4096
ORDER = ("pos", "block_id")


def _bucket(by: str) -> Column:
    return F.floor(F.col(by) / SPAN).cast("bigint")


def _carried(df: DataFrame, keys: list[str], inside: Column, over: Column) -> DataFrame:
    """(keys, _bucket, _carry): ``over`` all earlier buckets of what ``inside`` makes of each.

    ``df`` is read a second time for it; combined before the shuffle, a bucket is one row.
    """
    per = df.groupBy(*keys, "_bucket").agg(inside.alias("_of"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), over.over(w).alias("_carry"))


def _with(df: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    on = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(carry, on, "left").drop("_kb", *[f"_k{i}" for i in range(len(keys))])


def cumulative(df: DataFrame, name: str, amount: Column, keys: tuple[str, ...] = ("paper_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """``name``: the running sum of ``amount`` along each document, the row itself included."""
    ks = list(keys)
    df = df.withColumn("_amount", amount.cast("bigint")).withColumn("_bucket", _bucket(order[0]))
    w = Window.partitionBy(*ks, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(df.withColumn("_own", F.sum("_amount").over(w)), ks, _carried(df, ks, F.sum("_amount"), F.sum("_of")))
    return out.withColumn(name, F.col("_own") + F.coalesce("_carry", F.lit(0))).drop("_amount", "_bucket", "_own", "_carry")


def carried_last(df: DataFrame, name: str, value: Column, keys: tuple[str, ...] = ("paper_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """``name``: the last ``value`` that isn't null along each document, the row itself included."""
    ks = list(keys)
    df = df.withColumn("_value", value).withColumn("_bucket", _bucket(order[0]))
    w = Window.partitionBy(*ks, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    out = _with(df.withColumn("_own", F.last("_value", True).over(w)), ks, _carried(df, ks, last, F.last("_of", True)))
    return out.withColumn(name, F.coalesce("_own", "_carry")).drop("_value", "_bucket", "_own", "_carry")


def indexed(df: DataFrame, keys: tuple[str, ...] = ("paper_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """``rn``: the row's number in its document, from 1."""
    return cumulative(df, "rn", F.lit(1), keys, order)


def beside(df: DataFrame, columns: dict[str, Column], reach: int = 1) -> DataFrame:
    """Columns of rows before and after, for tables with ``rn``; each bucket also sees the rows near its edges.

    The columns are given over the window ``w`` that :func:`nearby` gives.
    """
    b, at = F.floor(F.col("rn") / SPAN), F.pmod(F.col("rn"), F.lit(SPAN))
    homes = F.array_compact(F.array(b, F.when(at < reach, b - 1), F.when(at >= SPAN - reach, b + 1)))
    seen = df.withColumn("_home", b).withColumn("_bucket", F.explode(homes))
    return seen.withColumns(columns).where("_home = _bucket").drop("_home", "_bucket")


def nearby():
    return Window.partitionBy("paper_id", "_bucket").orderBy("rn")
