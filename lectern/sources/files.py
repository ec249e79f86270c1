"""File sources and sinks: the catalog's CSV, JSON documents, paged scans."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tag_separator

#: Fields of a catalog row, by position.
CATALOG = ["id", "title", "author", "printing_place", "printing_year", "pages", "tags"]


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headerless catalog: rows of under 7 fields or with a blank title are left out, further fields are ignored."""
    schema = ", ".join(f"{n} string" for n in [*CATALOG, "_other"])
    raw = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_other").schema(schema).csv(path, header=False)
    # _other holds a record with another number of fields; the separators outside of quotes tell more from fewer.
    bare = F.regexp_replace("_other", r'"(?:[^"]|"")*"', "")
    enough = F.col("_other").isNull() | (F.regexp_count(bare, F.lit(",")) + 1 >= len(CATALOG))
    whole = raw.where(enough & (F.coalesce(F.trim("title"), F.lit("")) != "")).select(*CATALOG)
    return whole.withColumn("tags", tag_separator(F.coalesce("tags", F.lit(""))))


def write_catalog_csv(catalog: DataFrame, path: str) -> None:
    """Rows by position without a header; quotes inside of values are doubled."""
    catalog.select(*CATALOG).write.mode("overwrite").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path, header=False)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files that hold one document or array each, or (lines) one document a line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def camel(name: str) -> str:
    return re.sub(r"_+([a-z0-9])", lambda m: m[1].upper(), name)


def as_json(df: DataFrame) -> Column:
    """A row as JSON text with camel-case names."""
    return F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns]), {"ignoreNullFields": "false"})


def batches(df: DataFrame, index: str, size: int = 200) -> Iterator[list[Row]]:
    """Rows by ranges of an ordered index, one batch after the other; the driver holds two partitions at most."""
    held: list[Row] = []
    for row in df.orderBy(index).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def page(index: Column, size: int = 200) -> Column:
    """The batch that a row belongs to: ranges of so many indices."""
    return F.floor(index / size).cast("long")


def clear(table: DataFrame) -> DataFrame:
    """A keyed store without its rows."""
    return table.limit(0)


def remove_all(table: DataFrame, which: Column) -> DataFrame:
    """Without the rows that fit; a row of which that can't be told stays."""
    return table.where(~F.coalesce(which, F.lit(False)))


def first_match(table: DataFrame, which: Column, *order: str) -> DataFrame:
    """The first row that fits, or none."""
    return table.where(which).orderBy(*order).limit(1)


def put(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A keyed store after an upsert: rows replace those of the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.dropDuplicates([key]))
