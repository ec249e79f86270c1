"""Places and running totals over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written


def running_total(rows: DataFrame, value: Column, *order: str, name: str = "before") -> DataFrame:
    """rows with the sum of value over all rows that come before, by columns that tell all rows apart.

    Sampled splitters deal the rows out in ranges; totals of the ranges, a row each, are added up, and each range counts
    on from there. An empty table gives no rows.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_value", value).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    # Written, so that a range stays what its total was counted of.
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))  # a row a range
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(F.broadcast(start), "_range")
    return out.withColumn(name, F.col("_start") + F.col("_own")).select(*rows.columns, name)


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their places from 0, by columns that tell all rows apart."""
    return running_total(rows, F.lit(1).cast("long"), *order, name=name)
