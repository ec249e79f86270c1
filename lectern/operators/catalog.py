"""Catalog with usage: joins with the history, ranking, capped keyed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import popularity

#: Rows of the default view and entries of the history: the features' limits.
VIEW, HISTORY, RECENT, FILES = 50, 100, 10, 10


def by_locale(title: str) -> Column:
    """What titles are sorted by: small letters before capital ones, accented ones beside the plain."""
    return F.collate(title, "UNICODE")


def ranked(catalog: DataFrame, history: DataFrame, now: Column, most: int = VIEW) -> DataFrame:
    """The most popular catalog rows that have a history: by score, then by title in the order of a locale, and id."""
    used = catalog.join(history, "id").withColumn("score", popularity(F.col("access_count"), F.col("last_accessed"), F.col("first_accessed"), now))
    return used.select("id", "title", "author", "access_count", "score").orderBy(F.desc("score"), by_locale("title"), "id").limit(most)


def with_usage(catalog: DataFrame, history: DataFrame) -> DataFrame:
    """All catalog rows; those without a history have a count of 0."""
    return catalog.join(history.select("id", "access_count", "last_accessed"), "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)).cast("long"))


def history_of(events: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Counter, first and last use per key."""
    return events.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("access_count"), F.max(at).alias("last_accessed"), F.min(at).alias("first_accessed"))


def newest(history: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The entries used last; of equal times the smaller id stays."""
    return history.orderBy(F.desc("last_accessed"), "id").limit(keep)


def recent_values(events: DataFrame, value: str, at: str, most: int = RECENT) -> DataFrame:
    """Distinct values, the last used first."""
    return events.groupBy(value).agg(F.max(at).alias("used")).orderBy(F.desc("used"), value).limit(most)


def overridden(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """base with the values of changes where there are any."""
    own = changes.select(key, F.col(value).alias("_own")).dropDuplicates([key])
    return base.join(own, key, "left").withColumn(value, F.coalesce("_own", value)).drop("_own")


def merge_history(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds a batch's counters to a history."""
    both = history.unionByName(batch)
    return both.groupBy("id").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"), F.min("first_accessed").alias("first_accessed"))


def lowest_free(ids: DataFrame, id: str = "id") -> DataFrame:
    """The least positive integer that isn't an id."""
    one = ids.sparkSession.range(1).select(F.lit(1).cast("long").alias("x"))
    after = ids.select((F.col(id) + 1).cast("long").alias("x")).where("x > 0").union(one)
    return after.join(ids.select(F.col(id).cast("long").alias("x")), "x", "left_anti").agg(F.min("x").alias("free"))


def distinct_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """One row for each name, letters of either case alike: the first by order."""
    place = Window.partitionBy(F.lower(name)).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(place)).where("_k = 1").drop("_k")
