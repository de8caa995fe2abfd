"""Throughput and the share of unknown documents of a running stream, and a sink that a restart does not repeat."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The name that observed numbers go by in a query's progress.
NAME = "intake"


def observed(responses: DataFrame, name: str = NAME, **more: Column) -> DataFrame:
    """The same rows; each micro-batch's progress tells how many there were, how many of an unknown type, and how many with errors.

    The numbers are gathered while the rows pass: no second job, no state.
    """
    unknown = F.count_if(F.coalesce(F.col("doc_type") == "unknown", F.lit(True))).alias("unknown")
    failed = F.count_if(F.coalesce(F.size("errors") > 0, F.lit(False))).alias("failed")
    return responses.observe(name, F.count(F.lit(1)).alias("rows"), unknown, failed, *(c.alias(k) for k, c in more.items()))


def throughput(query: StreamingQuery, name: str = NAME) -> list[dict]:
    """For each batch that the query remembers: batch_id, rows, unknown, failed (and what else was observed), unknown_rate, rows_per_second, late_rows.

    late_rows are those that the batch's state operators dropped for the watermark. Batches without
    rows have a rate of None.
    """
    out = []
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        if row is None:
            continue
        found = row.asDict()
        seconds = progress.durationMs.get("triggerExecution", 0) / 1_000
        late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        rate = {"unknown_rate": found["unknown"] / found["rows"] if found.get("rows") else None, "rows_per_second": found["rows"] / seconds if seconds else None}
        out.append({"batch_id": progress.batchId, **found, **rate, "late_rows": late})
    return out


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query's state operators have dropped for being later than the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch has a folder of its own, named by its id, which a repeated batch replaces.

    A batch whose rows were written but not yet committed when the query died is written again, with
    the same rows, in the same place; readers of `path` see every row once, with its batch_id.
    """

    def put(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(str(PurePosixPath(path) / f"batch_id={batch_id}") if "://" not in path else f"{path}/batch_id={batch_id}")

    return put


def start_once(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, put: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a stream into the folders of `write_batch`."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(put or write_batch(path))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
