"""Reports kept up to date batch by batch, against the same reports over everything."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyman.operators import analytics, events
from tallyman.operators import changes as change_ops
from tallyman.sources import feeds, model
from tallyman.streaming import reports


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def feed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "changes")
    feeds.encode_changes(model.changes(spark, sf_dir)).repartition(3).write.json(path)
    return path


def newest_orders(changes):
    """Orders as the whole feed leaves them."""
    told = changes.where("new_image IS NOT NULL OR op = 'REMOVE'")
    last = change_ops.latest_per_key(told).where("op != 'REMOVE'")
    return last.select("new_image.*").withColumn("item_count", F.size("items"))


def check_sales(kept, orders, as_of):
    for period in ("hour", "day", "month"):
        assert same(kept.sales(period).drop("items"), analytics.sales_by_period(orders, period))
    assert same(kept.rollup(), analytics.sales_rollup(orders))
    by_status = orders.groupBy("status", F.date_trunc("day", "order_ts").alias("period")).agg(F.count("*").alias("orders"))
    assert same(kept.sales("day", ("status",)).select(by_status.columns), by_status)
    for hours in (24, 24 * 300):
        assert same(kept.county_activity(as_of, hours), analytics.county_activity(orders, as_of, hours))


def test_sales_follow_the_feed(spark, sf_dir, feed, tmp_path):
    changes = feeds.read_changes(spark, feed)
    as_of = F.lit("2001-07-20 10:30:15").cast("timestamp")
    kept = reports.SalesReports(spark, str(tmp_path / "sales"), buckets=4, fan=2)
    # Newer changes come before older ones, repeated deliveries in batches of their own.
    batches = [changes.where("seq = 3"), changes.where("seq >= 3"), changes.where("seq = 1"), changes.where("seq < 3")]
    for number, batch in enumerate(batches):
        kept.write_batch(batch, number)
    check_sales(kept, newest_orders(changes), as_of)
    version = kept.store.state()["version"]
    kept.write_batch(batches[0], 0)  # taken before
    assert kept.store.state()["version"] == version
    cells = kept.cells.read().count()
    kept.write_batch(changes, len(batches))  # says nothing new
    assert kept.cells.read().count() <= cells
    check_sales(kept, newest_orders(changes), as_of)
    # Tiers are merged: a bucket of five batches has fewer folders than batches.
    assert max(len(runs) for runs in kept.store.state()["tables"]["orders"]["runs"].values()) < 4


def test_a_batch_that_fails_before_its_commit_runs_again(spark, feed, tmp_path, monkeypatch):
    changes = feeds.read_changes(spark, feed).where("seq <= 3")
    kept = reports.SalesReports(spark, str(tmp_path), buckets=2)
    kept.write_batch(changes.where("seq = 1"), 0)
    with monkeypatch.context() as patch:
        patch.setattr(kept.store, "commit", lambda change: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.write_batch(changes.where("seq > 1"), 1)
    seen = newest_orders(changes.where("seq = 1"))
    assert same(kept.rollup(), analytics.sales_rollup(seen))
    kept.write_batch(changes.where("seq > 1"), 1)
    assert same(kept.rollup(), analytics.sales_rollup(newest_orders(changes)))


def test_empty_batches_and_removed_orders(spark, feed, tmp_path):
    changes = feeds.read_changes(spark, feed)
    kept = reports.SalesReports(spark, str(tmp_path), buckets=2)
    kept.write_batch(changes.limit(0), 0)
    assert kept.sales().count() == 0 and kept.rollup().count() == 0
    gone = changes.where("op = 'REMOVE'").select("order_id")
    kept.write_batch(changes.where("op = 'REMOVE'"), 1)
    kept.write_batch(changes.join(gone, "order_id", "left_semi").where("op != 'REMOVE'"), 2)  # late
    assert gone.count() > 0 and kept.sales().count() == 0


def test_sales_of_a_stream(spark, feed, tmp_path):
    kept = reports.SalesReports(spark, str(tmp_path / "sales"), buckets=2)
    for _ in range(2):  # the second run finds nothing new
        query = kept.start(feeds.stream_changes(spark, feed, files=2), str(tmp_path / "cp"), interval=None)
        query.awaitTermination(120)
        assert query.exception() is None
        assert same(kept.rollup(), analytics.sales_rollup(newest_orders(feeds.read_changes(spark, feed))))


def test_lake_reports_follow_the_lake(spark, sf_dir, tmp_path):
    as_of = model.latest_order_time(spark, sf_dir)
    flat = events.flatten_events(model.raw_events(spark, sf_dir), as_of)
    path = str(tmp_path / "rows")
    events.with_partitions(events.lake_rows(flat), as_of).write.parquet(path)
    rows = spark.read.parquet(path)
    kept = reports.LakeReports(spark, str(tmp_path / "reports"), buckets=2, fan=2)
    for number, batch in enumerate((rows.where("year >= '1998'"), rows.where("year < '1995'"), rows.where("year BETWEEN '1995' AND '1997'"))):
        kept.write_batch(batch, number)
        kept.write_batch(batch, number)
    assert same(kept.events_by_type(), analytics.lake_events_by_type(rows))
    assert same(kept.current_status(), analytics.lake_current_status(rows))
    assert kept.events_by_type().agg(F.sum("events")).first()[0] == rows.count()


def test_facts_of_images_that_hold_counts_for_items(spark, sf_dir):
    changes = model.changes(spark, sf_dir).where("orderkey < 300")
    new = F.col("new_image")
    light = changes.withColumn("new_image", new.withField("item_count", F.size(new["items"])).dropFields("items"))
    assert same(reports.order_facts(light), reports.order_facts(changes))
