"""Structured Streaming over events: time windows with watermarks, sessions, running state, and change rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..sources.tables import scratch


def _timed(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    """events with the watermark.  Watermarks take instants alone: times without a zone are read as UTC, whatever the session's zone."""
    if not late:
        return events
    if events.schema[ts].dataType == TimestampNTZType():
        events = events.withColumn(ts, F.expr(f"timestamp_micros(CAST(1000000 * CAST(CAST(`{ts}` - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) AS BIGINT))"))
    return events.withWatermark(ts, late)


def _as_before(result: DataFrame, events: DataFrame, ts: str, *names: str) -> DataFrame:
    """result with the times of the columns names as events has them: without a zone again, if _timed gave them one."""
    if events.schema[ts].dataType != TimestampNTZType():
        return result
    zoned = [n for n in names if result.schema[n].dataType != TimestampNTZType()]
    return result.withColumns({n: F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + unix_micros(`{n}`) * INTERVAL '0.000001' SECOND") for n in zoned})


def tumbling(events: DataFrame, every: str = "1 hour", late: str | None = None, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """start, event_type, n and total of each window; batch or stream.  late: the watermark."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    out = _timed(events, ts, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    return _as_before(out, events, ts, "start")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, ts: str = "ts") -> DataFrame:
    out = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    return _as_before(out, events, ts, "start", "end")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet files of a folder, or a single file, which Spark's streams take by a pattern alone: [e]vents.parquet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not re.search(r"[{}\[\]*?\\]", path) and target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        path = re.sub(r"([^/])([^/]*)$", r"[\1]\2", path)
    return spark.readStream.schema(schema).parquet(path)


def run_to_end(result: DataFrame, path: str, checkpoint: str | None = None, mode: str = "complete"):
    """Take all that a stream has now, and leave the result as Parquet at path: whole (complete), or what each batch finished (append)."""

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint or scratch(result.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def subscribe(changes: DataFrame, table: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each new batch of one table's change rows (table, kind, data) to handle, once the batch is complete."""
    return changes.filter(F.col("table") == table).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_changes(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
