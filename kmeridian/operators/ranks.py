"""Cumulative sums, ranks and Benjamini-Hochberg values of groups of any size.

Rows are range-partitioned by group and order; each partition works on its own part of a group, and a table of one row for
each partition and group carries what comes before or after. A large group is shared by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmeridian.session import saved, shuffle_width


def _laid(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows range-partitioned, saved with `_g` (the group; null keys are equal) and `_pid`."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    laid = rows.withColumn("_g", group).repartitionByRange(shuffle_width(rows.sparkSession), "_g", *order).withColumn("_pid", F.spark_partition_id())
    return saved(laid)


def _over(parts: DataFrame, column: Column, before: bool) -> Column:
    """column over the parts of a group before (or after) each."""
    w = Window.partitionBy("_g").orderBy(F.col("_pid") if before else F.col("_pid").desc())
    return column.over(w.rowsBetween(Window.unboundedPreceding, -1))


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """rows with the inclusive running sum of value within each group, in order."""
    laid = _laid(rows, keys, order)
    parts = laid.groupBy("_pid", "_g").agg(F.sum(value).alias("_s"))
    parts = parts.withColumn("_b", F.coalesce(_over(parts, F.sum("_s"), True), F.lit(0))).drop("_s")
    own = F.sum(value).over(Window.partitionBy("_pid", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn("_own", own).join(parts, ["_pid", "_g"]).withColumn(into, F.col("_b") + F.col("_own")).drop("_pid", "_g", "_b", "_own")


def q_values(tests: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """tests with Benjamini-Hochberg q-values of the finite p-values of each group; others keep NaN. A test's q is the least
    of min(1, p * tests / rank) over the ranks from its own on."""
    open_ = F.col(p).isNull() | F.isnan(p)
    rest = tests.where(open_).withColumn("q", F.lit(float("nan")))
    laid = _laid(tests.where(~open_), keys, [p])
    within = Window.partitionBy("_pid", "_g").orderBy(p)
    counts = laid.groupBy("_pid", "_g").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_b": F.coalesce(_over(counts, F.sum("_n"), True), F.lit(0)), "_m": F.sum("_n").over(Window.partitionBy("_g"))})
    ranked = laid.withColumn("_r", F.row_number().over(within)).join(counts, ["_pid", "_g"]).withColumn("_r", F.col("_r") + F.col("_b"))
    ranked = ranked.withColumn("_v", F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_r")))
    least = ranked.groupBy("_pid", "_g").agg(F.min("_v").alias("_least"))
    later = least.withColumn("_later", _over(least, F.min("_least"), False)).drop("_least")
    onward = F.min("_v").over(Window.partitionBy("_pid", "_g").orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("_own", onward).join(later, ["_pid", "_g"]).withColumn("q", F.least("_own", F.coalesce("_later", F.lit(1.0))))
    return out.select(*(F.col(f"`{c}`") for c in tests.columns), "q").unionByName(rest)
