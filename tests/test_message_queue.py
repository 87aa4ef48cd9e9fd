from __future__ import annotations

import json

import pytest

from tallylens.streaming import live
from tallylens.streaming import message_queue as mq

EVENT = "event_id long, kind string"


def put(spark, folder, ids, files=1):
    mq.enqueue(spark.createDataFrame([(i, f"k{i % 3}") for i in ids], EVENT).coalesce(files), folder)


def batches(spark, sink):
    return {r["batch_id"]: sorted(r["ids"]) for r in spark.sql(
        f"SELECT batch_id, collect_list(event_id) AS ids FROM parquet.`{sink}` GROUP BY batch_id").collect()}


def start(spark, folder, tmp_path, n, sink="out"):
    events = mq.queued_events(spark, folder, str(tmp_path / "cp" / "queue"), EVENT, n)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path / sink}/batch_id={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        processingTime="0 seconds").start()


def test_batches_of_n_rows_across_files_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "queue")
    put(spark, folder, range(0, 25), 3)
    put(spark, folder, [])
    put(spark, folder, range(25, 60), 2)
    done = mq.drained(start(spark, folder, tmp_path, 16))
    assert [p["numInputRows"] for p in done] == [16, 16, 16, 12]
    assert [mq.read_up_to(p) for p in done] == [16, 32, 48, 60]
    assert [mq.queue_length(spark, folder, mq.read_up_to(p)) for p in done] == [44, 28, 12, 0]
    # a second run goes on behind the last message, and the bound still holds
    put(spark, folder, range(60, 100), 4)
    again = mq.drained(start(spark, folder, tmp_path, 16))
    assert [p["numInputRows"] for p in again] == [16, 16, 8]
    found = batches(spark, tmp_path / "out")
    assert sorted(i for ids in found.values() for i in ids) == list(range(100))
    assert max(map(len, found.values())) == 16
    # a third has nothing to do
    assert mq.drained(start(spark, folder, tmp_path, 16)) == []


def test_reader_gives_an_end_that_was_not_logged_once_more(spark, tmp_path):
    folder, state = str(tmp_path / "queue"), str(tmp_path / "state")
    put(spark, folder, range(30))
    first = mq.QueueReader(folder, state, 10)
    ends = [first.latestOffset(), first.latestOffset()]
    assert [e["read"] for e in ends] == [10, 20]
    # a file that a crash cut short does not count
    (tmp_path / "state" / f"{30:020d}").write_text('{"file": "app')
    second = mq.QueueReader(folder, state, 10)
    assert second.latestOffset() == ends[1]
    assert [second.latestOffset()["read"] for _ in range(2)] == [30, 30]
    assert len(list((tmp_path / "state").iterdir())) == 2
    tasks = second.partitions(ends[0], ends[1])
    rows = [r for t in tasks for b in second.read(t) for r in b.to_pylist()]
    assert [r["position"] for r in rows] == list(range(10, 20))
    assert sorted(json.loads(r["value"])["event_id"] for r in rows) == list(range(10, 20))
    assert second.partitions(ends[1], ends[1]) == []


def test_slices_share_small_files_and_split_large_ones(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "queue")
    put(spark, folder, range(7), 3)
    put(spark, folder, range(7, 40), 1)
    monkeypatch.setattr(mq, "SLICE_ROWS", 10)
    reader = mq.QueueReader(folder, str(tmp_path / "state"), None)
    tasks = reader.partitions(mq.START, reader.latestOffset())
    assert [sum(b - a for _, a, b, _ in t.parts) for t in tasks] == [10, 10, 10, 10]
    rows = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert [r["position"] for r in rows] == list(range(40))
    assert sorted(json.loads(r["value"])["event_id"] for r in rows) == list(range(40))


def test_unfinished_appends_are_not_seen_and_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "queue")
    put(spark, folder, range(5))
    put(spark, folder, range(5, 9))
    (tmp_path / "queue" / "append=000000000001" / "_SUCCESS").unlink()
    assert mq.QueueReader(folder, str(tmp_path / "state"), None).latestOffset()["read"] == 5
    assert mq.queue_length(spark, folder) == 5
    put(spark, folder, range(5, 12))
    assert mq.queue_length(spark, folder) == 12


def test_empty_queue(spark, tmp_path):
    folder = str(tmp_path / "queue")
    assert mq.queue_length(spark, folder) == 0
    assert mq.drained(start(spark, folder, tmp_path, 5)) == []
    with pytest.raises(ValueError):
        mq.queued_messages(spark, folder, str(tmp_path / "s"), 0)


def test_messages_that_are_no_record_keep_their_position(spark, tmp_path):
    folder, sink = str(tmp_path / "queue"), str(tmp_path / "live")
    texts = ['{"event_id": 1, "kind": "a"}', "broken", None, '{"event_id": 2, "kind": "b"}']
    mq.enqueue(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), folder, "text")
    events = mq.queued_events(spark, folder, str(tmp_path / "cp" / "queue"), EVENT, 3)
    mq.drained(live.start_live(events, sink, str(tmp_path / "cp"), analyse=False, every="0 seconds"))
    assert sorted(r["event_id"] for r in live.stored(spark, sink, "table").collect()) == [1, 2]
    rejected = live.stored(spark, sink, "rejected").collect()
    assert {(r["record"], r["origin"]) for r in rejected} == {("broken", "message 1"), (None, "message 2")}
