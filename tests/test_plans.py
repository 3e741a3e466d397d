"""The shape of physical plans, and hot keys."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyman.operators import access, inventory
from tallyman.plans.queries import ORACLE, QUERIES
from tallyman.sources import model
from tools.check_queries import compare, connect

# These run a job while they are built; their plans are checked through the operators they use.
EAGER = {"lake_write", "lake_scan_day", "reservation_fcfs", "inventory_after_reserve", "requests_idempotent",
         "orders_from_requests", "sales_incremental", "lake_status_incremental",
         "reservation_over_time", "inventory_held_over_time"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_listing_takes_the_top_before_reading_lines(spark, sf_dir):
    text = plan(QUERIES["store_orders"](spark, sf_dir))
    assert text.count("TakeOrderedAndProject") >= 2
    assert "LeftSemi" in text


def test_top_per_group_prunes_before_the_shuffle(spark, sf_dir):
    text = plan(access.top_per_group(model.order_heads(spark, sf_dir), "county_id", 3, tie="orderkey"))
    assert text.count("WindowGroupLimit") == 2


def test_time_range_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["county_last_24h"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_order_queries_scan_lines_once(spark, sf_dir):
    for name in ("sales_by_day", "order_totals", "notifications_build", "orders_by_ids", "orders_by_composite_key"):
        assert plan(QUERIES[name](spark, sf_dir)).count("lineitem.parquet") == 1, name


def test_running_totals_and_previous_images_take_one_shuffle(spark, sf_dir):
    for name in ("inventory_cumulative_demand", "cdc_old_from_lag"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("Exchange ") == 1 and "lineitem" not in text, name


@pytest.mark.parametrize("name", ["legacy_apply_changes", "legacy_upsert_orders", "legacy_soft_delete"])
def test_flat_orders_nest_no_items(spark, sf_dir, name):
    assert "collect_list" not in plan(QUERIES[name](spark, sf_dir))


def test_change_filter_builds_no_items(spark, sf_dir):
    for name in ("cdc_op_filter", "cdc_dedup"):
        assert "collect_list" not in plan(QUERIES[name](spark, sf_dir)), name


def test_a_look_up_of_nearly_all_orders_restricts_heads_only(spark, sf_dir):
    assert plan(QUERIES["orders_by_composite_key"](spark, sf_dir)).count("LeftSemi") == 1


def test_status_queries_do_not_read_lines(spark, sf_dir):
    for name in ("orders_cancel", "payment_apply", "messages_eligible"):
        assert "lineitem" not in plan(QUERIES[name](spark, sf_dir))


def test_an_order_with_very_many_lines_stays_one_order(spark, sf_dir, tmp_path):
    for name in ("orders", "customer", "nation", "part"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = model.table(spark, sf_dir, "lineitem")
    hot = spark.range(140).crossJoin(spark.range(4).select(F.col("id").alias("n"))).select(
        F.lit(7).cast("bigint").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(2.0).alias("l_quantity"))
    few = lines.where("l_orderkey <> 7").select("l_orderkey", "l_partkey", "l_quantity")
    few.unionByName(hot).write.parquet(str(tmp_path / "lineitem.parquet"))
    documents = model.orders(spark, str(tmp_path)).cache()
    big, = documents.where("orderkey = 7").collect()
    assert len(big["items"]) == 140 and {i.quantity for i in big["items"]} == {8}
    assert documents.count() == model.order_heads(spark, str(tmp_path)).count()
    folder = str(tmp_path)
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    for name in ("sales_by_month", "sales_rollup", "orders_by_id_projection", "order_totals", "backfill_page", "orders_by_ids"):
        same, note = compare(QUERIES[name](spark, folder), con, ORACLE[name])
        assert same, (name, note)
    # The listing path agrees, and still honours its limit.
    heads = access.store_orders(model.order_heads(spark, str(tmp_path)), "STORE-007", limit=100, tie="orderkey")
    listed = access.newest_first(model.documents(spark, str(tmp_path), heads, few=True), 100)
    want = access.store_orders(documents, "STORE-007", limit=100)
    assert [r.order_id for r in listed.collect()] == [r.order_id for r in want.collect()]


def test_cumulative_demand_follows_time_before_id(spark):
    # Later orders have smaller ids within the same minute, and ids that differ early.
    lines = spark.range(200).select(
        F.lit("S#a").alias("store_sku"), F.format_string("%06d%024d", 999 - F.col("id"), F.col("id")).alias("order_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, cast(id div 2 as int))")).alias("order_ts"),
        (F.col("id") % 7 + 1).cast("int").alias("quantity"))
    window = Window.partitionBy("store_sku").orderBy("order_ts", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    want = lines.withColumn("cumulative", F.sum("quantity").over(window))
    got = inventory.cumulative_demand(lines).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cumulative_demand_on_one_hot_stock_row(spark):
    lines = spark.range(3000).select(
        F.lit("S#hot").alias("store_sku"), F.concat(F.lit("o"), F.lpad(F.col("id").cast("string"), 29, "0")).alias("order_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, cast(id % 900 as int))")).alias("order_ts"),
        F.lit(1).alias("quantity"))
    last = inventory.cumulative_demand(lines).agg(F.max("cumulative"), F.count_distinct("cumulative")).first()
    assert tuple(last) == (3000, 3000)
