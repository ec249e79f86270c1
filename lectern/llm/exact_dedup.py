"""Exact dedup by content sort.

Sampled splitters deal the rows out in ranges of (first bytes of the normalised text, its SHA-256, id), so equal texts
are neighbours and a large group of copies is cut by id over several ranges. Each range is sorted externally, and a
streaming pass compares neighbouring whole texts and marks runs. Runs that go on across a border of ranges are joined by
a table with the two outer runs of each range, whose size is bounded by the number of ranges; there, and only there, texts
count as equal by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import durable, lower_ascii, one_of_each, partitions

#: Characters of the text that a splitter holds; beyond them the digest decides.
LEAD = 64

_RUNS = "id long, part int, sha string, size long, last_id long, stays boolean, edge int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted. edge: 1 the range's first run, 2 its last one, 3 both, 0 others.

    What is kept in memory of a range is its ids and one entry a run; the texts stream through.
    """
    part = TaskContext.get().partitionId()
    ids: list[pa.Array] = []
    starts: list[int] = []
    shas: list[str] = []
    before, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = before is None or text[0].as_py() != before
        before = text[-1].as_py()
        at = np.flatnonzero(new)
        starts.extend((at + rows).tolist())
        shas.extend(batch.column("sha").take(pa.array(at)).to_pylist())
        ids.append(batch.column("id"))
        rows += batch.num_rows
    if not rows:
        return
    all_ids = pa.concat_arrays(ids)
    first = np.array(starts)
    size = np.diff(np.append(first, rows))
    last = first + size - 1
    run = np.repeat(np.arange(len(first)), size)
    edge = np.zeros(len(first), np.int32)
    edge[0] += 1
    edge[-1] += 2
    last_ids, sha = all_ids.take(pa.array(last)), pa.array(shas, pa.string())
    for i in range(0, rows, 100_000):
        j = min(rows, i + 100_000)
        r = run[i:j]
        yield pa.RecordBatch.from_arrays(
            [all_ids.slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), sha.take(pa.array(r)), pa.array(size[r]), last_ids.take(pa.array(r)), pa.array(last[r] == np.arange(i, j)), pa.array(edge[r])],
            names=["id", "part", "sha", "size", "last_id", "stays", "edge"],
        )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. Of a group the row with
    the smallest or the largest id stays (keep). A row that repeats an id and a text counts as another copy, and exactly
    one of the rows stays; a row without an id stays only in a group without ids. An empty table gives no rows; other
    columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    order = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    norm = docs.select(F.col(id).cast("long").alias("id"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    norm = norm.withColumns({"sha": F.sha2("text", 256), "lead": F.substring("text", 1, LEAD)})
    dealt = norm.repartitionByRange(partitions(docs.sparkSession), "lead", "sha", order).sortWithinPartitions("lead", "sha", "text", order)
    runs = durable(dealt.select("id", "text", "sha").mapInArrow(_runs, _RUNS), "runs")

    # The outer runs of the ranges, at most two rows a range: equal neighbours of different ranges are one group.
    outer = runs.where("edge > 0").groupBy("part", "edge", "sha").agg(F.first("size").alias("size"), F.max_by("last_id", F.struct("stays", "part")).alias("last_id"))
    line = Window.orderBy("part", "edge")
    outer = outer.withColumn("new", F.coalesce((F.lag("sha").over(line) != F.col("sha")).cast("int"), F.lit(1))).withColumn("group", F.sum("new").over(line))
    whole = Window.partitionBy("group")
    outer = outer.select("part", "edge", F.sum("size").over(whole).alias("all_size"), F.max_by("last_id", F.struct("part", "edge")).over(whole).alias("all_last"), (F.max("part").over(whole) == F.col("part")).alias("ends"))
    joined = runs.join(F.broadcast(outer), ["part", "edge"], "left")
    return joined.select(
        F.col("id").alias(id),
        F.when(F.col("all_size").isNull(), F.col("last_id")).otherwise(F.col("all_last")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("stays") & F.coalesce("ends", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_unique(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps: one of each group of equal texts.

    Of rows alike in id and text it is the least one by its other columns. Decisions come back by id and digest, so a
    large group of copies is spread by its ids.
    """
    best = exact_dedup(docs, id, text, keep).where("kept").select(F.col(id).alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).cast("long").alias("id"), F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256).alias("sha"))
    chosen = rows.alias("r").join(best.alias("b"), F.col("r.id").eqNullSafe(F.col("b.id")) & (F.col("r.sha") == F.col("b.sha")), "left_semi")
    return one_of_each(chosen, "id", "sha").select("row.*")
