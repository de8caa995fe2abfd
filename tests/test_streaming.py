import json

from docloom.streaming import intake


def test_intake(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    row = {"request_id": "r1", "ts": "2024-01-01T00:00:00", "hint": "", "payloads": [], "lines": [{"text": "PASSPORT", "x": 0.0, "y": 0.0, "w": 10.0, "h": 5.0, "confidence": 0.9}]}
    (source / "a.json").write_text("\n".join(map(json.dumps, [row, row, {**row, "request_id": "r2", "lines": []}])))
    stream = intake.responses(intake.once_each(intake.read_intake(spark, str(source))))
    intake.start(stream, str(out), str(state), available_now=True).awaitTermination()
    got = {r["doc_id"]: r["doc_type"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {"r1": "passport_vn", "r2": "unknown"}


def test_windows(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS event_type, 1L AS user_id, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:04:59', 'a', 1L, 2.0D UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'a', 1L, 3.0D")
    assert sorted(r["n"] for r in intake.window_counts(events).collect()) == [1, 2]
    assert sorted(r["n"] for r in intake.sessions(events).collect()) == [1, 2]
