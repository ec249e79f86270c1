"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_durable, durable


def apart(aggregated: DataFrame, key: str) -> DataFrame:
    """Hides from the planner that a side of a join was aggregated by the join's key, a whole number.

    Else the aggregation and the join are one stage, whose hot keys adaptive execution can't split. So this side gets a
    shuffle of its own: adaptive execution splits a skewed partition of the other side, or broadcasts this one if it is small.
    """
    return aggregated.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge (a, b), the smallest node that it reaches.

    Loops, null ends and repeated edges are ignored. Each round is two aggregations and two joins over the edges; the
    edges of a node with very many are pre-aggregated before the shuffle and split by the join (see apart). Rounds grow
    with the logarithm of the longest chain. A table of no edges gives no rows; it is an error if most_rounds rounds
    don't suffice.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = durable(now.where("u > v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == mark[1] and mark[4] == 0:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low, "u"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = durable(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        drop_durable(now)
        now, before = after, mark
        mark = _mark(now)
        if mark[:4] == before[:4]:
            break
    else:
        if mark[0] != mark[1] or mark[4]:
            raise RuntimeError(f"components are not whole after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(e: DataFrame) -> tuple:
    """Edges, children, two sums by which a table is told from another, and how many children are parents too."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"), (F.xxhash64("u", "v") % 1_000_003).alias("h"), (F.hash("v", "u") % 1_000_003).alias("k"))
    ends = ends.union(e.select("v", F.lit(0), F.lit(1), F.lit(0).cast("long"), F.lit(0)))
    nodes = ends.groupBy("x").agg(F.sum("child").alias("n"), F.max("parent").alias("parent"), F.sum("h").alias("h"), F.sum("k").alias("k"))
    some = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    a = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), some(F.col("n") > 0).alias("u"), F.sum("h").alias("h"), F.sum("k").alias("k"), some((F.col("n") > 0) & (F.col("parent") > 0)).alias("both")).first()
    return a.n, a.u, a.h, a.k, a.both
