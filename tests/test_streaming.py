"""The event stream: validation, exactly-once append, replay, running counts."""

import json

import pytest

from tracewell.streaming import ingest


def event(session, n, **more):
    return {"schema_name": "e", "event_id": f"{session}:{n}", "session_id": session, "sequence": n, "event_time": "2025-01-01T00:00:00Z", "event_type": "t", "payload": "{}"} | more


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def test_ingest_is_exactly_once(spark, tmp_path):
    src, log, cp, bad = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp"), str(tmp_path / "bad")
    run = lambda: ingest.ingest(ingest.read_events(spark, str(src)), log, cp, bad).awaitTermination()
    write(src, "1.json", [event("a", 1), event("a", 2), event("a", 2), event("b", 1, event_id="b:9"), event("", 1), event("c", 1, event_time="yesterday")])
    run()
    assert sorted(r.event_id for r in ingest.replay(spark, log).collect()) == ["a:1", "a:2"]
    write(src, "2.json", [event("a", 1), event("a", 2, payload='{"other":1}'), event("a", 3)])
    run()
    assert sorted(r.event_id for r in ingest.replay(spark, log).collect()) == ["a:1", "a:2", "a:3"]
    states = {(r.event_id, r.state) for r in spark.read.parquet(bad).collect()}
    assert ("a:2", "conflict") in states and ("b:9", "invalid") in states
    run()  # nothing new
    assert ingest.replay(spark, log).count() == 3


def test_running_counts(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [event("a", 1), event("a", 2, event_type="u")])
    write(src, "2.json", [event("b", 1)])
    got = ingest.drain(ingest.running_counts(ingest.read_events(spark, str(src), 1), ["event_type"]), str(tmp_path / "cp"), "complete", str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [("t", 2), ("u", 1)]


def test_a_lost_checkpoint_loses_no_events(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")
    ids = lambda: sorted(r.event_id for r in ingest.replay(spark, log).collect())
    write(src, "1.json", [event("a", 1), event("a", 2)])
    ingest.ingest(ingest.read_events(spark, str(src)), log, str(tmp_path / "cp1")).awaitTermination()
    (src / "1.json").unlink()
    write(src, "2.json", [event("a", 2), event("b", 1)])
    ingest.ingest(ingest.read_events(spark, str(src)), log, str(tmp_path / "cp2")).awaitTermination()  # batch numbers begin anew
    assert ids() == ["a:1", "a:2", "b:1"]


def test_a_log_that_cannot_be_read_ends_the_batch(spark, tmp_path):
    src, log = tmp_path / "in", tmp_path / "log"
    write(src, "1.json", [event("a", 1)])
    log.mkdir()
    (log / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ingest.ingest(ingest.read_events(spark, str(src)), str(log), str(tmp_path / "cp")).awaitTermination()
    assert [p.name for p in log.iterdir()] == ["part.parquet"]


def test_counts_of_each_event_once(spark, tmp_path):
    from pyspark.sql import functions as F

    src = tmp_path / "in"
    write(src, "1.json", [event("a", 1), event("a", 1), event("a", 2, event_type="u")])
    write(src, "2.json", [event("a", 1), event("b", 1), event("b", 2, event_type="u")])
    e = ingest.read_events(spark, str(src), 1).withColumn("at", F.to_timestamp("event_time"))
    once = ingest.once_within(e, "at", ["session_id", "sequence"])
    got = ingest.drain(ingest.running_counts(once, ["event_type"]), str(tmp_path / "cp"), "update", str(tmp_path / "out"), ["event_type"])
    assert sorted(tuple(r) for r in got.collect()) == [("t", 2), ("u", 2)]
