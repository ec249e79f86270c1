"""Positions and ranges: gaps, neighbourhoods, clips, nearest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_ranges(have: DataFrame, key: str, index: str, first: int, last: int) -> DataFrame:
    """Per key the ranges (start, end) of first..last that have no row; from the gaps between neighbours, so nothing is expanded."""
    inside = have.where(F.col(index).between(first, last)).select(key, F.col(index).cast("long").alias("i")).distinct()
    ends = have.select(key).distinct().select(key, F.explode(F.array(F.lit(first - 1).cast("long"), F.lit(last + 1).cast("long"))).alias("i"))
    line = Window.partitionBy(key).orderBy("i")
    gaps = inside.union(ends).withColumn("after", F.lead("i").over(line)).where("after - i > 1")
    return gaps.select(key, (F.col("i") + 1).alias("start"), (F.col("after") - 1).alias("end"))


def near(rows: DataFrame, key: str, index: str, visible: str, reach: int = 200) -> DataFrame:
    """Rows within reach of a row whose flag is set."""
    around = Window.partitionBy(key).orderBy(index).rangeBetween(-reach, reach)
    return rows.withColumn("_near", F.max(F.col(visible).cast("int")).over(around)).where("_near = 1").drop("_near")


def clipped(sections: DataFrame, start: int, end: int) -> DataFrame:
    """Sections that overlap a range, cut to it."""
    return sections.where((F.col("start") < end) & (F.col("end") > start)).withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})


def nearest(rows: DataFrame, key: str, index: str, value: str, to: float) -> DataFrame:
    """Per key the index whose value is nearest; of equal distances the first."""
    return rows.groupBy(key).agg(F.min_by(index, F.struct(F.abs(F.col(value) - to), F.col(index))).alias(index))
