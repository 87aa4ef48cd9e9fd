from __future__ import annotations

import json

import pytest
from pyspark.errors import StreamingQueryException

from tallylens.operators.clean import clean
from tallylens.streaming import live


def order_event(i: int) -> dict:
    return {
        "order_id": f"LIVE{i:08d}", "customer_id": f"C{i % 9:05d}", "product_id": "P0001",
        "order_date": "2024-05-01T10:00:00.123456", "quantity": i % 5 + 1, "unit_price": 10.5, "total_amount": None if i % 4 == 0 else 21.0,
        "status": ["Completed", "PENDING", " cancelled "][i % 3], "payment_method": "UPI", "region": "North", "source": "live_stream",
        "ingested_at": "2024-05-01T10:00:01"}


def write_events(folder, batches):
    folder.mkdir()
    for number, ids in enumerate(batches):
        (folder / f"part-{number}.json").write_text("\n".join(json.dumps(order_event(i)) for i in ids))


def test_batches_equal_batch_processing(spark, tmp_path):
    write_events(tmp_path / "in", [range(0, 40), [*range(40, 80), 40, 41], range(80, 100)])
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    events = live.file_events(spark, str(tmp_path / "in"), files_per_batch=1)
    query = live.start_live(events, sink, checkpoint, once=True)
    query.awaitTermination()
    assert live.backlog(query)["rows"] is not None
    table = live.stored(spark, sink, "table")
    whole = clean(spark.read.schema(events.schema).json(str(tmp_path / "in")))
    assert table.select("batch_id").distinct().count() == 3
    assert sorted(map(str, table.drop("batch_id").collect())) == sorted(map(str, whole.collect()))
    assert table.where("total_amount IS NULL").count() == 0
    contexts = live.stored(spark, sink, "context").collect()
    assert {c["domain"] for c in contexts} == {"ecommerce"} and {c["source_type"] for c in contexts} == {"live_stream"}
    assert sum(c["row_count"] for c in contexts) == 100
    assert sum(r["duplicate_rows"] for r in live.stored(spark, sink, "quality").collect()) == 2
    assert live.stored(spark, sink, "findings").where("stat_type = 'summary'").count() == 3

    # running again finds nothing new and changes nothing
    live.start_live(live.file_events(spark, str(tmp_path / "in"), files_per_batch=1), sink, checkpoint, once=True).awaitTermination()
    assert live.stored(spark, sink, "table").count() == 100


def test_empty_batch_is_skipped(spark):
    assert live.describe_batch(spark.createDataFrame([], live.schemas.ORDER_EVENT)) is None


def test_events_from_text(spark):
    texts = [json.dumps(order_event(1)), "broken", "```json\n" + json.dumps(order_event(2)) + "\n```"]
    rows = live.events_from_text(spark.createDataFrame([(t,) for t in texts], "value string"), "value").collect()
    assert sorted(r["order_id"] for r in rows) == ["LIVE00000001", "LIVE00000002"]


def test_messages_that_are_no_record_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bad = ["broken", "{broken}", json.dumps(order_event(3) | {"quantity": "many"})]
    (tmp_path / "in" / "m.txt").write_text("\n".join([json.dumps(order_event(1)), *bad]))
    sink = str(tmp_path / "out")
    events = live.messages_from_text(spark.readStream.text(str(tmp_path / "in")), "value")
    live.start_live(events, sink, str(tmp_path / "cp"), analyse=False, once=True).awaitTermination()
    assert [r["order_id"] for r in live.stored(spark, sink, "table").collect()] == ["LIVE00000001"]
    assert sorted(r["record"] for r in live.stored(spark, sink, "rejected").collect()) == sorted(bad)
    assert live.stored(spark, sink, "context").head()["warnings"] == ["Rejected records: 3"]


def test_broken_lines_of_files_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.json").write_text(json.dumps(order_event(1)) + "\n{broken\n")
    sink = str(tmp_path / "out")
    events = live.file_events(spark, str(tmp_path / "in"), keep_rejected=True)
    live.start_live(events, sink, str(tmp_path / "cp"), analyse=False, once=True).awaitTermination()
    assert live.stored(spark, sink, "table").count() == 1
    assert live.stored(spark, sink, "rejected").head()["record"].strip() == "{broken"
    failing = live.start_live(
        live.file_events(spark, str(tmp_path / "in")), str(tmp_path / "no"), str(tmp_path / "cp2"), analyse=False, once=True)
    with pytest.raises(StreamingQueryException):
        failing.awaitTermination()
