"""Usage history from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.catalog import HISTORY, history_of, merge_history, newest
from lectern.operators.search import matches


def counters(events: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Keyed state as a streaming aggregation: counter, first and last use."""
    return history_of(events.withColumn(at, F.col(at).cast("timestamp")), key, at)


def collected(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is, as a table under path.

    Each micro-batch is written to a folder of its number, so one that is run again replaces itself; in complete mode the
    last batch holds all rows.
    """
    spark = stream.sparkSession
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/batch={k}" for k in wanted])


def searched(lines: DataFrame, query: str) -> DataFrame:
    """Matches in lines as they come in: each micro-batch is searched when it arrives, as matches() does a table."""
    return matches(lines, query)


def first_lines(lines: DataFrame, at: str, *key: str) -> DataFrame:
    """Streamed lines without those that came before, within the watermark of a day."""
    return lines.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 day").dropDuplicatesWithinWatermark(list(key))


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Bursts of events with less than a gap between them."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 day")
    return timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_history(events: DataFrame, path: str, checkpoint: str, keep: int = HISTORY, key: str = "user_id", at: str = "ts") -> StreamingQuery:
    """Merges each micro-batch into a stored history of the newest keys.

    The cap is over all keys, so it is taken per batch. Each batch writes a version named by its number and reads the one
    before, so a batch that is run again gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = history_of(batch, key, at)
        if number:
            own = merge_history(batch.sparkSession.read.parquet(f"{path}/{number - 1}"), own)
        newest(own, keep).write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
