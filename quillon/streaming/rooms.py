"""Rooms over streams: a room is a topic of an event stream; unlike live clients, streams can be replayed.

Events are rows (room, event, ts, args as JSON). Emitting appends; joining reads the stream of a room. Timed state per room uses
watermarks, so that late events are bounded and state is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "room string, event string, ts timestamp, args string"


def emit(df: DataFrame, path: str, room: str, event: str, *args: str) -> None:
    """Appends one event per row of df; args name its columns."""
    row = df.select(F.lit(room).alias("room"), F.lit(event).alias("event"), F.current_timestamp().alias("ts"), F.to_json(F.struct(*args)).alias("args"))
    row.write.mode("append").parquet(path)


def join(spark: SparkSession, path: str, room: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of a room (or of all)."""
    reader = spark.readStream.schema(EVENTS)
    stream = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
    return stream if room is None else stream.where(F.col("room") == room)


def replay(spark: SparkSession, path: str, room: str | None = None) -> DataFrame:
    """The same events as a batch."""
    df = spark.read.schema(EVENTS).parquet(path)
    return df if room is None else df.where(F.col("room") == room)


def windowed(events: DataFrame, *, every: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("room", "event"), ts: str = "ts") -> DataFrame:
    """Events per window and key, for streams and batches."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour", keys: tuple[str, ...] = ("room",), ts: str = "ts") -> DataFrame:
    """Bursts of events: a session ends after `gap` without one."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def listen(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Calls on_batch for each micro-batch; with available_now what is there is handled and the query ends (a timed task)."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
