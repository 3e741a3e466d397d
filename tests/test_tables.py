"""Bucketed tables, their commits, and the jobs that build on them when something fails."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyman.operators import legacy, mutations
from tallyman.session import put_file, read_file
from tallyman.sources import backfill, feeds, model, tables
from tallyman.streaming import dual_write, intake

AT = dt.datetime(2024, 5, 1, 12)


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rows(spark, low, high, note="x"):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(note).alias("note"))


def test_a_file_is_put_once(spark, tmp_path):
    path = str(tmp_path / "a" / "b.json")
    assert put_file(spark, path, "one") and not put_file(spark, path, "two")
    assert read_file(spark, path) == "one"
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b.json"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    table = tables.BucketedTable(store, "t", ["key"], buckets=50)
    store.commit(table.rewrite(list(range(50)), rows(spark, 0, 1000)))
    before = store.state()
    changed = rows(spark, 0, 10, "y")
    touched = table.touched(changed)
    assert 0 < len(touched) <= 10
    new = table.read(touched).join(changed.select("key"), "key", "left_anti").unionByName(changed)
    change = table.rewrite(touched, new)
    # Data is written, the manifest is not: nothing has changed.
    assert table.read().where("note = 'y'").count() == 0
    store.commit(change)
    after = store.state()
    runs = lambda s: {b: r[0]["folder"] for b, r in s["tables"]["t"]["runs"].items()}
    moved = {int(b) for b in runs(after) if runs(after)[b] != runs(before)[b]}
    assert moved == set(touched)
    files = {f.split("/")[-2] for f in table.read(touched).inputFiles()}
    assert len(files) <= len(touched)
    assert table.read().count() == 1000 and table.read().where("note = 'y'").count() == 10


def test_a_commit_based_on_an_older_bucket_fails(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    table = tables.BucketedTable(store, "t", ["key"], buckets=4)
    store.commit(table.rewrite([0, 1, 2, 3], rows(spark, 0, 40)))
    one, other = table.rewrite([0, 1, 2, 3], rows(spark, 0, 50)), table.rewrite([0, 1, 2, 3], rows(spark, 0, 60))
    store.commit(one)
    with pytest.raises(tables.ConflictError):
        store.commit(other)
    assert table.read().count() == 50
    with pytest.raises(ValueError):
        table.rewrite([0], rows(spark, 0, 50))


def test_mutations_of_a_table_touch_the_buckets_of_their_keys(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    table = tables.BucketedTable(store, "t", ["order_id"], buckets=32)
    order = lambda low, high, status, at: spark.range(low, high).select(
        F.concat(F.lit("o"), "id").alias("order_id"), F.lit(status).alias("status"), F.lit(at).alias("arrival"))
    stored = order(0, 300, "PENDING", 0)
    store.commit(table.rewrite(list(range(32)), stored))
    runs = lambda: {b: r for b, r in store.state()["tables"]["t"]["runs"].items()}
    put, new = order(0, 3, "SHIPPED", 1).unionByName(order(1, 3, "FAILED", 2)), order(298, 303, "CONFIRMED", 1)
    for rows, merge, whole in (
        (put, lambda t, r: mutations.bulk_put(t, r, ["order_id"], "arrival"), mutations.bulk_put(stored, put, ["order_id"], "arrival")),
        (new, lambda t, r: mutations.insert_if_absent(t, r, ["order_id"], "arrival").table, None),
    ):
        before, touched = runs(), table.touched(rows)
        store.commit(table.update(rows, merge))
        assert {int(b) for b, r in runs().items() if before.get(b) != r} == set(touched) and len(touched) <= 5
        if whole is not None:
            assert same(table.read(), whole)
    assert same(table.read(), mutations.insert_if_absent(mutations.bulk_put(stored, put, ["order_id"], "arrival"), new, ["order_id"], "arrival").table)
    # A commit between reading and writing is noticed.
    late = table.update(put, lambda t, r: mutations.bulk_put(t, r, ["order_id"], "arrival"))
    store.commit(table.update(put, lambda t, r: mutations.bulk_put(t, r, ["order_id"], "arrival")))
    with pytest.raises(tables.ConflictError):
        store.commit(late)


def test_commits_that_meet_are_applied_one_after_the_other(spark, tmp_path):
    store, other = tables.Store(spark, str(tmp_path)), tables.Store(spark, str(tmp_path))
    seen = []

    def change(state):
        if not seen:  # another writer is first
            other.commit(lambda s: s["notes"].__setitem__("other", 1))
        seen.append(state["version"])
        state["notes"]["mine"] = 1

    assert store.commit(change)["notes"] == {"other": 1, "mine": 1} and seen == [0, 1]
    for _ in range(25):
        store.commit(lambda s: None)
    assert len(store._versions()) == tables.KEPT and store.state()["version"] == 27


def test_lookup_opens_only_folders_that_may_hold_a_key(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    table = tables.BucketedTable(store, "t", ["key"], buckets=4, filters=True, fan=3)
    batches = 14
    for n in range(batches):
        store.commit(table.append(rows(spark, n * 30, n * 30 + 30)))
        table.merge()
        runs = store.state()["tables"]["t"]["runs"]
        # Two folders a tier at most stay, so their number follows the logarithm of the batches.
        assert max(map(len, runs.values())) <= 2 * 3
    assert table.read().count() == 30 * batches
    asked = rows(spark, 0, 30 * batches + 200).unionByName(rows(spark, 0, 5))
    assert same(table.lookup(asked), table.read().select("key"))
    runs = sum(map(len, store.state()["tables"]["t"]["runs"].values()))
    known, unknown = rows(spark, 33, 34), rows(spark, 5000, 5020)
    assert len(table.runs_with(known)) <= 2 and len(table.runs_with(unknown)) <= runs // 4
    assert table.lookup(unknown).count() == 0 and table.lookup(known).count() == 1
    nulls = spark.createDataFrame([(None,), ("k1",)], "key string")
    assert [r.key for r in table.lookup(nulls).collect()] == ["k1"]


def test_an_empty_table(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    table = tables.BucketedTable(store, "t", ["key"], buckets=4, filters=True)
    with pytest.raises(ValueError):
        table.read()
    assert table.lookup(rows(spark, 0, 3)).count() == 0
    store.commit(table.append(rows(spark, 0, 0)))
    assert table.read().count() == 0 and table.lookup(rows(spark, 0, 3)).count() == 0


# ---- backfill ----


@pytest.fixture(scope="module")
def flat(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("flat")
    for name, df in (("o", model.legacy_orders(spark, sf_dir).limit(120)), ("i", model.legacy_items(spark, sf_dir))):
        df.write.parquet(str(root / name))
    return spark.read.parquet(str(root / "o")), spark.read.parquet(str(root / "i"))


@pytest.mark.parametrize("where", ["before the write", "after the write", "before the commit"])
@pytest.mark.parametrize("at", [1, 3])
def test_backfill_after_a_failure(spark, flat, tmp_path, monkeypatch, where, at):
    """Range 1 is in the middle, range 3 the one of orders that arrived later."""
    orders, items = flat
    early, late = orders.where("order_id < 'Z'"), orders.limit(5).withColumn("order_id", F.concat(F.lit("Z"), "order_id"))
    backfill.Backfill(spark, str(tmp_path), early, items, ranges=3).bounds()
    everything = early.unionByName(late)
    job = backfill.Backfill(spark, str(tmp_path), everything, items, ranges=3)
    calls = []

    def failing(real, name):
        def run(*args, **kwargs):
            if name == "_copy_range" or args or kwargs.get("folder"):
                calls.append(name)
            if len(calls) == at + 1:
                calls.append("failed")
                raise OSError("lost")
            return real(*args, **kwargs)

        return run

    if where == "before the write":
        monkeypatch.setattr(job, "_copy_range", failing(job._copy_range, "_copy_range"))
    elif where == "after the write":
        monkeypatch.setattr(job, "_save", failing(job._save, "_save"))
    else:
        real, seen = job.store.commit, []

        def commit(change):
            state = real(change) if len(seen) != at + 1 else None  # the start, then one a range
            seen.append(1)
            if state is None:
                raise OSError("lost")
            return state

        monkeypatch.setattr(job.store, "commit", commit)
    with pytest.raises(OSError, match="lost"):
        job.run()
    status = backfill.Backfill(spark, str(tmp_path), everything, items).run("STATUS")
    assert status["status"] == "FAILED" and status["has_more"]
    assert job.documents().count() == status["total_processed"]
    done = backfill.Backfill(spark, str(tmp_path), everything, items, ranges=3).run()
    want = legacy.nest_orders(everything, items)
    assert (done["status"], done["has_more"], done["total_processed"]) == ("COMPLETED", False, want.count())
    assert same(want, job.documents())


def test_backfill_of_nothing(spark, flat, tmp_path):
    orders, items = flat
    job = backfill.Backfill(spark, str(tmp_path), orders.limit(0), items)
    assert job.documents().count() == 0
    assert job.run() == {"status": "COMPLETED", "processed_in_this_run": 0, "total_processed": 0, "last_processed_id": None, "has_more": False}


# ---- dual write and intake ----


def test_compaction_rewrites_touched_buckets_and_fails_whole(spark, flat, sf_dir, tmp_path, monkeypatch):
    orders, items = flat
    feed = model.changes(spark, sf_dir).where("seq <= 4")
    one = feed.select(F.coalesce("new_image.order_id", "old_image.order_id").alias("id")).orderBy("id").first().id
    mine = feed.where((F.col("new_image.order_id") == one) | (F.col("old_image.order_id") == one)).cache()
    job = dual_write.DualWrite(spark, str(tmp_path), buckets=16)
    job.initialize(orders, items)
    job.write_batch(mine, 0)
    job.write_batch(mine, 0)  # delivered again
    before = job.store.state()
    assert len(before["lists"]["log"]) == 1
    with monkeypatch.context() as patch:
        patch.setattr(job.store, "commit", lambda change: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            job.compact()
    assert job.store.state() == before
    assert job.compact() == 1 and job.compact() == 1
    after = job.store.state()
    for name in ("orders", "items"):
        runs = [s["tables"][name]["runs"] for s in (before, after)]
        assert sum(runs[0].get(b) != r for b, r in runs[1].items()) == 1
    got_orders, got_items = job.state()
    assert same(legacy.upsert_orders(orders, mine), got_orders.drop("last_seq"))
    assert same(legacy.upsert_items(items, mine), got_items)


def test_intake_over_many_batches(spark, tmp_path, monkeypatch):
    body = json.dumps({"customer_id": "C", "store_id": "S", "county_id": "K", "items": [{"sku": "A", "name": "a", "quantity": 1, "unit_price": 2.5}],
                       "shipping_address": {"street": "s", "city": "c", "state": "TX", "zip": "12345"}})

    def batch(n):
        keys = [f"key-{n:08d}", f"key-{n + 1000:08d}", f"key-{max(0, n - 5):08d}"]
        return spark.createDataFrame([(f"r{n}-{k}", AT + dt.timedelta(minutes=n), k, body) for k in keys], feeds.REQUEST_ROW)

    job = intake.Intake(spark, str(tmp_path), buckets=2, fan=3)
    opened = []
    real = job.table.runs_with
    monkeypatch.setattr(job.table, "runs_with", lambda *a: opened.append(real(*a)) or opened[-1])
    for n in range(8):
        job.write_batch(batch(n), n)
    assert sorted(r.idempotency_key for r in job.orders().collect()) == sorted(f"key-{n + m:08d}" for n in range(8) for m in (0, 1000))
    runs = job.store.state()["tables"]["orders"]["runs"]
    assert max(map(len, runs.values())) <= 2 * 3
    assert max(map(len, opened)) <= 3
    # A failure behind the commit of the orders: the batch that runs again takes nothing twice.
    monkeypatch.setattr(job.table, "merge", lambda: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        job.write_batch(batch(8), 8)
    intake.Intake(spark, str(tmp_path), buckets=2, fan=3).write_batch(batch(8), 8)
    assert job.orders().count() == 18


def test_many_keys_open_their_buckets_without_filters(spark, tmp_path, monkeypatch):
    table = tables.BucketedTable(tables.Store(spark, str(tmp_path)), "t", ["key"], buckets=2, filters=True)
    for n in range(2):
        table.store.commit(table.append(rows(spark, n * 100, n * 100 + 100)))
    monkeypatch.setattr(tables, "FILTERED_KEYS", 20)
    asked = rows(spark, 50, 150).unionByName(rows(spark, 5000, 5100)).unionByName(rows(spark, 60, 61))
    few = rows(spark, 33, 34)
    few_runs = table.runs_with(few)
    monkeypatch.setattr(table, "_bits", lambda *a: pytest.fail("filters were read"))
    assert same(table.lookup(asked), rows(spark, 50, 150).select("key"))
    assert same(table.fetch(asked), rows(spark, 50, 150).select(table.read().columns))
    assert len(few_runs) == 1 and set(few_runs) < set(table.runs_with(asked))
