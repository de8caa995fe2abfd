"""Continuous intake of recognised documents, and throughput over windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.response import process
from docloom.sources.documents import FROZEN

INTAKE = "request_id string, ts timestamp, hint string, payloads array<string>, " + FROZEN.split(", ", 1)[1]


def read_intake(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON lines, a document each; the trigger's file limit bounds what is in work at a time."""
    return spark.readStream.schema(INTAKE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once_each(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests that repeat an id within the delay are dropped; the state is bounded by it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def responses(stream: DataFrame, **options) -> DataFrame:
    """The batch computation on a stream: it has no state."""
    numbered = F.transform("lines", lambda o, i: F.struct(i.alias("line_no"), o["text"].alias("text"), o["x"].alias("x"), o["y"].alias("y"), o["w"].alias("w"), o["h"].alias("h"), o["confidence"].alias("confidence")))
    return process(stream.select(F.col("request_id").alias("doc_id"), "hint", "payloads", numbered.alias("lines")), **options)


def start(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def window_counts(events: DataFrame, length: str = "5 minutes", by: str = "event_type", time: str = "ts", delay: str | None = None) -> DataFrame:
    """(window_start, by, n, total) of tumbling windows; with a delay, for streams: late rows beyond it are dropped."""
    rows = events.withWatermark(time, delay) if delay else events
    counted = rows.groupBy(F.window(time, length), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sliding_counts(events: DataFrame, length: str, step: str, time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", time: str = "ts") -> DataFrame:
    """(by, session_start, session_end, n): runs of events with no gap as long as `gap`; the two sides of a card that arrive one after the other are one session."""
    found = events.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return found.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_available(spark: SparkSession, source: Callable[[], DataFrame], out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote. With mode complete, every trigger's result replaces the one before."""
    stream = source()
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
