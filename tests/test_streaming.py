from __future__ import annotations

import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyman.operators import changes, events, legacy, rates
from tallyman.sources import backfill, feeds, lake, model, relational
from tallyman.streaming import dual_write, intake
from tallyman.streaming import feeds as stream_feeds
from tallyman.streaming import lake as stream_lake

AT = dt.datetime(2024, 5, 1, 12)


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")



def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture(scope="module")
def feed_dir(spark, sf_dir, tmp_path_factory):
    """The change feed as files, every record of one sequence number in its own files."""
    root = tmp_path_factory.mktemp("feed")
    encoded = feeds.encode_changes(model.changes(spark, sf_dir))
    encoded.repartition(6).write.mode("append").json(str(root / "all"))
    return str(root / "all")


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_streamed_events_equal_batch_events(spark, feed_dir, tmp_path):
    stream = feeds.stream_changes(spark, feed_dir, files=2)
    drain(stream_feeds.archive_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), interval=None))
    archived = feeds.read_archive(spark, str(tmp_path / "out"))
    batch = changes.derive_events(feeds.read_changes(spark, feed_dir))
    columns = ["event_id", "source", "detail_type", "time", "detail"]
    assert same(archived.select(columns), batch.select(columns))
    # A second run finds nothing new.
    again = feeds.stream_changes(spark, feed_dir, files=2)
    drain(stream_feeds.archive_events(again, str(tmp_path / "out"), str(tmp_path / "cp"), interval=None))
    assert feeds.read_archive(spark, str(tmp_path / "out")).count() == batch.count()


def test_stream_dedup_and_routes(spark, feed_dir, tmp_path):
    stream = stream_feeds.deduplicated(feeds.stream_changes(spark, feed_dir))
    drain(stream_feeds.route_events(changes.derive_events(stream), str(tmp_path / "out"), str(tmp_path / "cp"), interval=None))
    routed = spark.read.json(str(tmp_path / "out"))
    batch = events.route(changes.derive_events(changes.deduplicated(feeds.read_changes(spark, feed_dir))))
    count = lambda df: {r.rule: r["count"] for r in df.groupBy("rule").count().collect()}
    assert count(routed) == count(batch) and len(count(batch)) == 4


def test_lake_delivery_round_trip_with_quarantine(spark, sf_dir, tmp_path):
    records = model.raw_events(spark, sf_dir).select("record_id", "data")
    records.repartition(3).write.json(str(tmp_path / "in"))
    stream = lambda: stream_lake.stream_records(spark, str(tmp_path / "in"), files=2)
    drain(stream_lake.deliver(stream(), str(tmp_path / "lake"), str(tmp_path / "cp1"), now(), interval=None))
    drain(stream_lake.quarantine(stream(), str(tmp_path / "bad"), str(tmp_path / "cp2"), now(), interval=None))
    table = lake.read_lake(spark, str(tmp_path / "lake"))
    batch = events.with_partitions(events.lake_rows(events.flatten_events(records, now())), now())
    keys = ["event_type", "order_id", "total", "item_count", "year", "month", "day"]
    assert same(table.select(keys), batch.select(keys))
    assert table.where("event_timestamp is null").select("_malformed").distinct().count() > 0
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert bad.count() == records.count() - batch.count() and {r.attempt for r in bad.collect()} == {1}
    # Repair the broken base64 records, leave the rest; the rest uses up its attempts.
    base64_text = F.base64(F.encode(F.lit(json.dumps({"order_id": "fixed"})), "UTF-8"))
    fix = lambda df: df.withColumn("data", F.when(F.col("error_type") == "bad_base64", base64_text).otherwise(F.col("data")))
    kept = bad.select("record_id", "data", "error_type", "date", "timestamp", "attempt")
    rows, still, dead = stream_lake.redrive(kept, fix, now())
    assert rows.count() == kept.where("error_type = 'bad_base64'").count()
    assert {r.attempt for r in still.collect()} == {2} and dead.count() == 0
    _, _, dead = stream_lake.redrive(still.withColumn("attempt", F.lit(3)), fix, now())
    assert dead.count() == still.count()


def test_both_sinks_from_one_pass(spark, sf_dir, tmp_path, monkeypatch):
    records = model.raw_events(spark, sf_dir).select("record_id", "data").limit(400).cache()
    parsed = []
    real = stream_lake.flatten_events
    monkeypatch.setattr(stream_lake, "flatten_events", lambda *a, **k: parsed.append(1) or real(*a, **k))
    job = stream_lake.Delivery(spark, str(tmp_path / "out"), now())
    with monkeypatch.context() as patch:
        patch.setattr(job, "_quarantine", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            job.write_batch(records, 0)
    job.write_batch(records, 0)  # the batch runs again
    assert len(parsed) == 2
    batch = events.with_partitions(events.lake_rows(real(records, now())), now())
    keys = ["event_type", "order_id", "total", "item_count", "year", "month", "day"]
    assert same(job.lake().select(keys), batch.select(keys))
    bad = events.quarantined(real(records, now()), now())
    assert same(job.failed().select("record_id", "error_type"), bad.select("record_id", "error_type"))
    assert {r.attempt for r in job.failed().collect()} == {1} and job.failed().count() + batch.count() == 400
    # As a stream, with numbers of its own.
    records.repartition(2).write.json(str(tmp_path / "in"))
    streamed = stream_lake.Delivery(spark, str(tmp_path / "streamed"), now())
    drain(streamed.start(stream_lake.stream_records(spark, str(tmp_path / "in"), files=1), str(tmp_path / "cp"), interval=None))
    assert same(streamed.lake().select(keys), batch.select(keys)) and streamed.failed().count() == bad.count()


def test_batch_lake_write_prunes_partitions(spark, sf_dir, tmp_path):
    records = model.raw_events(spark, sf_dir)
    rows = events.with_partitions(events.lake_rows(events.flatten_events(records, now())), now()).where("year = '1997'")
    lake.write_lake(rows, str(tmp_path / "lake"))
    table = lake.read_lake(spark, str(tmp_path / "lake")).where("month = '03'")
    assert "PartitionFilters: [isnotnull(month" in table._jdf.queryExecution().executedPlan().toString()
    assert table.count() == rows.where("month = '03'").count() > 0
    failed = events.quarantined(events.flatten_events(records, now()), now())
    lake.write_quarantine(failed, str(tmp_path / "errors"))
    assert spark.read.json(str(tmp_path / "errors")).groupBy("error_type").count().count() == 2


def test_dual_write_over_batches_flag_and_restart(spark, sf_dir, feed_dir, tmp_path):
    orders, items = model.legacy_orders(spark, sf_dir), model.legacy_items(spark, sf_dir)
    job = dual_write.DualWrite(spark, str(tmp_path / "tables"))
    job.initialize(orders, items)
    drain(job.start(feeds.stream_changes(spark, feed_dir, files=2), str(tmp_path / "cp"), interval=None))
    feed = feeds.read_changes(spark, feed_dir)
    want_orders, want_items = legacy.upsert_orders(orders, feed), legacy.upsert_items(items, feed)
    got_orders, got_items = job.state()
    assert same(want_orders, got_orders.drop("last_seq")) and same(want_items, got_items)
    assert job.compact() == 1
    # Records that arrive again after the compaction are older than what the snapshot holds.
    job.write_batch(feed.where("seq <= 2"), 99)
    got_orders, got_items = dual_write.DualWrite(spark, str(tmp_path / "tables")).state()
    assert same(want_orders, got_orders.drop("last_seq")) and same(want_items, got_items)

    def unreadable():
        raise OSError("flag store is down")

    for flag in (lambda: False, unreadable):
        off = dual_write.DualWrite(spark, str(tmp_path / "off"), flag)
        off.initialize(orders, items)
        off.write_batch(feed, 0)
        assert same(orders, off.state()[0].drop("last_seq"))


def test_intake_across_batches(spark, tmp_path):
    item = {"sku": "A", "name": "a", "quantity": 1, "unit_price": 2.5}
    body = {"customer_id": "C", "store_id": "S", "county_id": "K", "items": [item],
            "shipping_address": {"street": "s", "city": "c", "state": "TX", "zip": "12345"}}

    def batch(rows):
        data = [(r, AT + dt.timedelta(minutes=m), k, b) for r, m, k, b in rows]
        return spark.createDataFrame(data, feeds.REQUEST_ROW)

    job = intake.Intake(spark, str(tmp_path))
    good = json.dumps(body)
    job.write_batch(batch([("r1", 1, "key-00000001", good), ("r2", 2, "key-00000001", good), ("r3", 2, "key-00000002", "{")]), 0)
    later = batch([("r4", 3, "key-00000001", good), ("r5", 3, "key-00000003", good)])
    job.write_batch(later, 1)
    job.write_batch(later, 1)  # the batch runs again
    assert sorted(r.request_id for r in job.orders().collect()) == ["r1", "r5"]
    assert [r.request_id for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == ["r3"]


def test_intake_with_a_fresh_checkpoint_keeps_earlier_orders(spark, tmp_path):
    body = {"customer_id": "C", "store_id": "S", "county_id": "K",
            "items": [{"sku": "A", "name": "a", "quantity": 1, "unit_price": 2.5}],
            "shipping_address": {"street": "s", "city": "c", "state": "TX", "zip": "12345"}}
    job = intake.Intake(spark, str(tmp_path / "out"))
    for n, keys in enumerate((("key-00000001", "key-00000002"), ("key-00000002", "key-00000003"))):
        rows = [(f"r{n}{k}", AT + dt.timedelta(minutes=n), k, json.dumps(body)) for k in keys]
        spark.createDataFrame(rows, feeds.REQUEST_ROW).write.json(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(feeds.REQUEST_ROW).json(str(tmp_path / f"in{n}"))
        drain(job.start(stream, str(tmp_path / f"cp{n}"), interval=None))
    assert sorted(r.idempotency_key for r in job.orders().collect()) == [f"key-0000000{k}" for k in (1, 2, 3)]


def test_a_batch_logged_during_compaction_is_kept(spark, sf_dir, feed_dir, tmp_path):
    orders, items = model.legacy_orders(spark, sf_dir), model.legacy_items(spark, sf_dir)
    job = dual_write.DualWrite(spark, str(tmp_path / "tables"))
    job.initialize(orders, items)
    feed = feeds.read_changes(spark, feed_dir)
    job.write_batch(feed.where("seq <= 2"), 0)
    version = job.version
    assert job.compact() == 1
    job.version = lambda: 0  # the batch saw the old version
    job.write_batch(feed.where("seq > 2"), 1)
    job.version = version
    got_orders, got_items = job.state()
    assert same(legacy.upsert_orders(orders, feed), got_orders.drop("last_seq"))
    assert same(legacy.upsert_items(items, feed), got_items)


def test_redrive_keeps_repeated_and_null_record_ids(spark):
    good = base64.b64encode(b'{"order_id": "x", "total": "NaN"}').decode()
    rows = [("a", "*", "bad_base64", "d", AT, 1), ("a", "*", "bad_base64", "d", AT, 2), (None, "*", "bad_base64", "d", AT, 1),
            (None, good, "bad_base64", "d", AT, 1)]
    failed = spark.createDataFrame(rows, "record_id string, data string, error_type string, date string, timestamp timestamp, attempt int")
    fixed, still, dead = stream_lake.redrive(failed, lambda df: df, now())
    assert sorted(((r.record_id or ""), r.attempt) for r in still.collect()) == [("", 2), ("a", 2), ("a", 3)]
    assert [r.total for r in fixed.collect()] == [None] and dead.count() == 0


def test_a_failing_batch_is_retried_whole(spark, tmp_path):
    spark.createDataFrame([("r1", "*"), ("r2", "*")], stream_lake.RECORD).write.json(str(tmp_path / "in"))
    start = lambda path: stream_lake.quarantine(
        stream_lake.stream_records(spark, str(tmp_path / "in")), path, str(tmp_path / "cp"), now(), interval=None)
    blocked = tmp_path / "blocked"
    blocked.write_text("a file where the folder should be")
    with pytest.raises(Exception):
        drain(start(str(blocked)))
    drain(start(str(tmp_path / "out")))
    assert {r.record_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"r1", "r2"}


def test_rate_alarm_stream(spark, tmp_path):
    rows = [("k", AT + dt.timedelta(seconds=20 * n)) for n in range(12)] + [("calm", AT), ("k", AT + dt.timedelta(hours=1))]
    hits = spark.createDataFrame(rows, "key string, ts timestamp")
    hits.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").json(str(tmp_path / "in"))
    query = stream_feeds.rate_alarms(stream, limit=10).writeStream.outputMode("append").format("memory").queryName("alarms") \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(query)
    got = {tuple(r) for r in spark.sql("select * from alarms").collect()}
    want = {tuple(r) for r in rates.rate_violations(hits, 10).collect()}
    assert got == want and len(want) > 0


def test_backfill_runs_resumes_and_is_idempotent(spark, sf_dir, tmp_path):
    orders, items = model.legacy_orders(spark, sf_dir), model.legacy_items(spark, sf_dir)
    orders.write.parquet(str(tmp_path / "o"))
    items.write.parquet(str(tmp_path / "i"))
    orders, items = relational.read_parquet(spark, str(tmp_path / "o"), str(tmp_path / "i"))
    job = backfill.Backfill(spark, str(tmp_path / "out"), orders, items, ranges=5)
    assert job.run("STATUS") == {"status": "NOT_STARTED", "processed_in_this_run": 0, "total_processed": 0,
                                 "last_processed_id": None, "has_more": False}
    first = job.run("START", max_ranges=2)
    assert first["status"] == "IN_PROGRESS" and first["has_more"] and 0 < first["processed_in_this_run"]
    broken = backfill.Backfill(spark, str(tmp_path / "out"), orders.drop("shipping_zip"), items, ranges=5)
    with pytest.raises(Exception):
        broken.run()
    assert job.run("STATUS")["status"] == "FAILED"
    second = backfill.Backfill(spark, str(tmp_path / "out"), orders, items, ranges=5).run()
    want = legacy.nest_orders(orders, items)
    assert second["total_processed"] == want.count() and not second["has_more"]
    assert same(want, job.documents().drop("range"))
    done = job.run()
    assert done["status"] == "COMPLETED" and done["processed_in_this_run"] == 0
    assert same(want, job.documents().drop("range"))
    # Orders that arrive later with larger ids are copied too.
    more = orders.limit(3).withColumn("order_id", F.concat(F.lit("Z"), "order_id"))
    grown = backfill.Backfill(spark, str(tmp_path / "out"), orders.unionByName(more), items, ranges=5)
    assert grown.run()["processed_in_this_run"] == 3 and grown.run()["status"] == "COMPLETED"
    assert job.documents().count() == want.count() + 3
    with pytest.raises(ValueError):
        job.run("RESET")


def test_messages_round_trip_and_jdbc_ranges(spark, sf_dir, tmp_path):
    sent = model.messages(spark, sf_dir)
    sent.write.json(str(tmp_path / "m"))
    assert same(sent, feeds.read_messages(spark, str(tmp_path / "m")))
    query = feeds.stream_messages(spark, str(tmp_path / "m")).writeStream.format("memory").queryName("queue") \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(query)
    assert spark.table("queue").count() == sent.count()
    assert relational.id_ranges(["m", "c"]) == [
        "order_id <= 'c'", "order_id > 'c' and order_id <= 'm'", "order_id > 'm'"]


def test_files_of_the_lake_follow_its_days(spark, tmp_path):
    """A shuffle partition that holds many days and is split must not write a file for each of its days from every task."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 80).cast("int"))
    rows = spark.range(0, 16000, 1, 16).select(
        F.sha2(F.col("id").cast("string"), 256).alias("order_id"), F.date_format(day, "yyyy").alias("year"),
        F.date_format(day, "MM").alias("month"), F.date_format(day, "dd").alias("day"),
    )
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        lake.write_lake(rows, f"{tmp_path}/lake")
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(list((tmp_path / "lake").glob("*/*/*/*.json.gz"))) < 2 * 80
    assert spark.read.json(f"{tmp_path}/lake").count() == 16000
