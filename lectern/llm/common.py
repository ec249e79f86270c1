"""Shared helpers: durable intermediate tables in the folder that all machines share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import new_folder

#: A-Z and what they become; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a reader of it.

    It cuts the lineage, survives the loss of executors, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def drop_durable(df: DataFrame) -> None:
    """Removes the files of a table that durable() wrote and that nothing reads any more."""
    path = getattr(df, "_lectern_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession, wait: bool = False) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; wait: before it returns.

    The plan that was last run is still referred to for a moment, so only a second collection finds its shuffles.
    """
    for _ in range(2 if wait else 1):
        gc.collect()
        spark._jvm.System.gc()
        if wait:
            time.sleep(0.3)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def one_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows (row, *key) with equal keys, nulls alike, the one of the least row; row is a struct.

    Columns that have no order (maps) don't count in the comparison.
    """
    kind = rows.schema["row"].dataType
    ordered = [f"row.`{f.name}`" for f in kind.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    least = F.min("row") if len(ordered) == len(kind.fields) else F.min_by("row", F.struct(*ordered) if ordered else F.lit(0))
    return rows.groupBy(*key).agg(least.alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deals rows out by a hash of the columns."""
    return df.repartition(partitions(df.sparkSession), *cols)


def doubles(values: list[float]) -> Column:
    """A literal array of numbers, parsed at once."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in values)})")


def strings(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.split(F.lit("\x00".join(values)), "\x00", -1)


def share(*cols: str | Column, seed: int) -> Column:
    """A number from 0 to 1 by a hash of the columns: rows below a bound are a sample that doesn't depend on partitions."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
