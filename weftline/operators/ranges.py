"""Joins by range that only count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sql import split_points

#: Different values and ends that one task puts in order.
ORDERED = 200_000
#: The order of rows of equal value: an end that excludes it, the value itself, an end that includes it.
LOW, VALUE, HIGH = range(3)


def count_between(left: DataFrame, right: DataFrame, low: str, high: str, value: str, name: str = "n") -> DataFrame:
    """The rows of ``left`` that have rows of ``right`` with ``low <= value <= high``, and how many.

    No pair is made: the rows up to an end are counted by a running sum over the different values, in even intervals
    that are put in order apart from each other.  NULLs match nothing; NaN is the greatest value, as in Spark's SQL.
    """
    values = right.select(F.col(value).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    ends = left.select(F.explode(F.array(*[F.struct(F.col(c).alias("_v"), F.lit(k).alias("_k")) for c, k in ((low, LOW), (high, HIGH))])).alias("_e"))
    rows = values.withColumn("_k", F.lit(VALUE)).unionByName(ends.select("_e.*").where("_v is not null").distinct().withColumn("_c", F.lit(0).cast("long")))
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, rows.count() // ORDERED + 1)
    points = split_points(rows, "_v", parts)
    bucket: Column = F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p < F.col("_v"))) if points else F.lit(0)
    rows = rows.withColumn("_b", bucket)
    totals = rows.groupBy("_b").agg(F.sum("_c").alias("_t"))  # a row an interval
    before = totals.withColumn("_t", F.sum("_t").over(Window.orderBy("_b")) - F.col("_t"))
    inside = F.sum("_c").over(Window.partitionBy("_b").orderBy("_v", "_k").rowsBetween(Window.unboundedPreceding, 0))
    ranks = rows.withColumn("_r", inside).where(F.col("_k") != VALUE).join(F.broadcast(before), "_b").select("_k", "_v", (F.col("_r") + F.col("_t")).alias("_r"))
    below, upto = (ranks.where(F.col("_k") == k).select(F.col("_v").alias(f"_v{k}"), F.col("_r").alias(f"_r{k}")) for k in (LOW, HIGH))
    counted = left.join(below, F.col(low) == F.col(f"_v{LOW}")).join(upto, F.col(high) == F.col(f"_v{HIGH}"))
    return counted.where(F.col(f"_r{HIGH}") > F.col(f"_r{LOW}")).select(*left.columns, (F.col(f"_r{HIGH}") - F.col(f"_r{LOW}")).alias(name))
