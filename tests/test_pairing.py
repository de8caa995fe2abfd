"""Streams with state: two sides of a card, late rows, metrics, and a restart in the middle."""

import datetime
import json

import pytest

from docloom.streaming import intake, metrics
from docloom.streaming.pairing import paired_sides

START = datetime.datetime(2024, 1, 1)
ROCKS = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(ROCKS, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(ROCKS)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps({"card_id": c, "side": s, "request_id": r, "ts": (START + datetime.timedelta(seconds=at)).isoformat(), "payload": f"p-{r}"}) for c, s, r, at in rows)
    (folder / f"{name}.json").write_text(text)


def test_sides_meet_wait_and_go_alone(rocks, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    stream = rocks.readStream.schema("card_id string, side string, request_id string, ts timestamp, payload string").option("maxFilesPerTrigger", 1).json(str(source))
    queries = []

    def run():
        query = paired_sides(stream, wait="30 seconds", delay="1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        queries.append(query)
        return {(r["card_id"], r["front_id"], r["back_id"], r["paired"], (r["ts"] - START).total_seconds()) for r in rocks.read.parquet(out).collect()}

    put(source, "a", [("c1", "front", "r1", 0), ("c1", "back", "r2", 5), ("c2", "front", "r3", 1), ("c2", "front", "r4", 2), ("c3", "back", "r5", 3), ("c4", "top", "r6", 4), (None, "front", "r7", 4), ("c7", "front", "r20", 0), ("c7", "back", "r21", 31)])
    first = {("c1", "r1", "r2", True, 5.0), ("c7", "r20", None, False, 0.0)}
    assert run() == first  # a repeated side waits as one; sides 31 seconds apart are no pair
    put(source, "b", [("c3", "front", "r8", 20), ("c5", "front", "r9", 200)])  # across batches and a restart
    second = first | {("c3", "r8", "r5", True, 20.0)}
    found = run()
    assert found >= second
    put(source, "c", [("c6", "front", "r10", 10), ("c8", "front", "r11", 201)])  # c6 is later than the watermark, at 140
    put(source, "d", [("c8", "back", "r12", 202), ("c9", "back", "r13", 400)])
    found = run()
    assert found - second == {("c2", "r3", None, False, 1.0), ("c5", "r9", None, False, 200.0), ("c8", "r11", "r12", True, 202.0), ("c7", None, "r21", False, 31.0)}
    assert sum(map(metrics.late_rows, queries)) == 1


def request(name, text, at=0):
    line = {"text": text, "x": 0.0, "y": 0.0, "w": 10.0, "h": 5.0, "confidence": 0.9}
    return json.dumps({"request_id": name, "ts": (START + datetime.timedelta(seconds=at)).isoformat(), "hint": "", "payloads": [], "lines": [line]})


def test_a_restart_in_the_middle_writes_every_row_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for i in range(4):
        (source / f"{i}.json").write_text("\n".join([request(f"a{i}", "PASSPORT"), request(f"b{i}", "nothing known")]))
    stream = metrics.observed(intake.responses(intake.read_intake(spark, str(source), files_per_trigger=1)))
    write, seen = metrics.write_batch(out), []

    def dies(rows, batch_id):
        seen.append(batch_id)
        write(rows, batch_id)
        if len(seen) == 2:
            raise RuntimeError("died after the rows were written and before the batch was committed")

    with pytest.raises(Exception, match="died after"):
        metrics.start_once(stream, out, state, True, put=dies).awaitTermination()
    query = metrics.start_once(stream, out, state, True, put=dies)
    query.awaitTermination()
    assert seen == [0, 1, 1, 2, 3]
    rows = spark.read.parquet(out).select("doc_id", "doc_type", "batch_id").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(f"{x}{i}" for x in "ab" for i in range(4)) and {r["batch_id"] for r in rows} == {0, 1, 2, 3}
    told = metrics.throughput(query)
    assert [(t["batch_id"], t["rows"], t["unknown"], t["unknown_rate"]) for t in told] == [(i, 2, 1, 0.5) for i in (1, 2, 3)]
    assert all(t["rows_per_second"] > 0 and t["late_rows"] == 0 for t in told)


def test_late_rows_of_windows_are_counted(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def events(name, *seconds):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"ts": (START + datetime.timedelta(seconds=s)).isoformat(), "event_type": "a", "value": 1.0}) for s in seconds))

    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(source))
    counted = intake.window_counts(stream, "1 minute", delay="30 seconds")
    events("a", 0, 10, 200)
    query = counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    events("b", 20, 30, 210)
    events("c", 900)
    later = counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    later.awaitTermination()
    assert metrics.late_rows(query) == 0 and metrics.late_rows(later) == 1  # one row for its window and type: partial counts are dropped
    assert {((r["window_start"] - START).total_seconds(), r["n"]) for r in spark.read.parquet(out).collect()} == {(0.0, 2), (180.0, 2)}
