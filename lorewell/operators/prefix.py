"""Running totals that do not collect a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], run: Column, order: list[str], **totals: Column) -> DataFrame:
    """Adds running sums of ``totals`` within ``group`` by (run, order), this row included.

    ``run`` cuts a group into consecutive stretches and must not decrease with the order. Each stretch is
    summed by itself; only one row per stretch meets in the group's own window, so a group that holds a
    third of all rows is spread over its stretches.
    """
    staged = df.withColumn("__run", run)
    for name, value in totals.items():
        staged = staged.withColumn(f"__{name}", value)
    parts = staged.groupBy(*group, "__run").agg(*[F.sum(f"__{n}").alias(f"__{n}_part") for n in totals])
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "__run", *[F.coalesce(F.sum(f"__{n}_part").over(before), F.lit(0)).alias(f"__{n}_before") for n in totals])
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in (*group, "__run")]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    joined = staged.alias("a").join(parts.alias("b"), cond).select("a.*", *[F.col(f"b.__{n}_before") for n in totals])
    inside = Window.partitionBy(*group, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *[(F.col(f"__{n}_before") + F.sum(f"__{n}").over(inside)).alias(n) for n in totals])
