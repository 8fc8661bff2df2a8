"""Running values of keys that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Ranges that rows are dealt to.
PARTS = 64


def running(rows: DataFrame, key: Sequence[str], order: Sequence, value: Column, out: str, how: str = "sum", parts: int = PARTS) -> DataFrame:
    """``rows`` with the sum or max of ``value`` over the rows of their key up to themselves, in ``order``.

    Rows are dealt to ranges by key and order, so a large key is several ranges, and moved by what the ranges before hold of
    their key. A range begins within one key at most, so there are no more such values than ranges.
    """
    table = written(rows.withColumn("_v", value).repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()), "running")
    fold = {"sum": F.sum, "max": F.max}[how]
    sums = table.groupBy(*[F.col(k).alias(f"_{k}") for k in key], F.col("_part").alias("_at")).agg(fold("_v").alias("_before"))
    earlier = Window.partitionBy(*[f"_{k}" for k in key]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", fold("_before").over(earlier)).where("_before is not null")
    own = fold("_v").over(Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = table.withColumn("_own", own).join(F.broadcast(sums), [F.col("_part") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]], "left")
    total = F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before") if how == "sum" else F.greatest("_own", "_before")
    return joined.withColumn(out, total).select(*rows.columns, out)


def numbered_within(rows: DataFrame, key: Sequence[str], order: Sequence, out: str, parts: int = PARTS) -> DataFrame:
    """``rows`` with their place (from 1, a long) among those of their key."""
    return running(rows, key, order, F.lit(1).cast("long"), out, "sum", parts)
