"""Trees kept as (id, parent_id) rows: paths, nesting and reports, by a recursive query independent of row order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written


def paths(nodes: DataFrame, label: str = "title", include_self: bool = True, order: str = "order_index", only_parents: str | None = None) -> DataFrame:
    """(id, depth, path, sort_path): labels from the root joined by ` > `, and a key that sorts depth first.

    A root has parent null or 0. Nodes whose parent is missing don't appear (see orphans). With only_parents, the
    recursion goes below a node only where that flag is true. A cycle has no root, so it doesn't appear either. The
    nodes are written once, as each level joins them again.
    """
    spark, name = nodes.sparkSession, f"nodes_{uuid.uuid4().hex}"
    flag = only_parents or "true"
    rank = F.lpad((F.coalesce(F.col(order), F.lit(0)) if order else F.lit(0)).cast("string"), 10, "0")
    kept = nodes.select("id", "parent_id", F.coalesce(label, F.lit("")).alias("label"), F.concat(rank, F.lit(":"), F.lpad(F.col("id").cast("string"), 19, "0")).alias("key"), F.expr(flag).alias("open"))
    written(kept, "nodes").createOrReplaceTempView(name)
    own = "label" if include_self else "''"
    grown = "concat(t.path, ' > ', n.label)" if include_self else "CASE WHEN t.path = '' THEN t.label ELSE concat(t.path, ' > ', t.label) END"
    out = spark.sql(
        f"""WITH RECURSIVE t AS (
              SELECT id, 0 AS depth, {own} AS path, label, key AS sort_path, open FROM {name} WHERE coalesce(parent_id, 0) = 0
              UNION ALL
              SELECT n.id, t.depth + 1, {grown}, n.label, concat(t.sort_path, '/', n.key), n.open FROM t JOIN {name} n ON n.parent_id = t.id WHERE t.open)
            SELECT id, depth, path, sort_path FROM t"""
    )
    spark.catalog.dropTempView(name)
    return out


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent doesn't exist."""
    ids = nodes.select(F.col("id").alias("parent_id")).distinct()
    return nodes.where("coalesce(parent_id, 0) <> 0").join(ids, "parent_id", "left_anti")


def children(parents: DataFrame, items: DataFrame, key: str, order: str = "order_index") -> DataFrame:
    """parents with an ordered array of their items; those without any keep an empty one."""
    kind = items.select(F.struct(F.col(order), F.col("id"), "title").alias("x")).schema["x"].dataType
    held = items.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("id"), "title"))).alias("items"))
    return parents.join(held, "id", "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{kind.simpleString()}>")))


def tri_state(flags: DataFrame, key: str, flag: str) -> DataFrame:
    """True if all children are, false if none is, else null; a child of null gives null."""
    known = F.count(flag) == F.count("*")
    return flags.groupBy(key).agg(F.when(known & F.every(flag), True).when(known & ~F.some(flag), False).alias("state"))
