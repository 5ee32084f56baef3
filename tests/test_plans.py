"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.catalog.queries import all_queries
from ledgerlane.plans import insights as I
from ledgerlane.plans import models as M
from ledgerlane.plans import runs
from ledgerlane.operators.lookup import measured
from ledgerlane.quality import report as Q
from ledgerlane.quality import violations as V
from ledgerlane.quality.bindings import standard_rules
from ledgerlane.sources import keyed, sinks
from ledgerlane.sources.readers import read_parquet
from tests.conftest import SF_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, raw_by_profile, tmp_path_factory):
    """Raw tables as parquet, the way a run finds them."""
    folder = tmp_path_factory.mktemp("stored")
    for name, df in raw_by_profile["messy"].items():
        df.write.parquet(f"{folder}/{name}")
    return {
        S.ORDERS: read_parquet(spark, f"{folder}/{S.ORDERS}", S.RAW_ORDERS),
        S.ORDER_EVENTS: read_parquet(
            spark, f"{folder}/{S.ORDER_EVENTS}", S.RAW_ORDER_EVENTS
        ),
    }


# The others only read back what they have written, or hold ten collected rows.
PLANNED = [
    n
    for n in all_queries()
    if not n.startswith(("csv_", "table_", "catalog_", "fct_orders_preview", "analysis_", "readiness_", "fct_orders_re", "insight_03_rerun"))
]


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cross_product(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_top_customers_is_a_bounded_heap(stored):
    facts = M.build_models(stored)["fct_orders"]
    assert "TakeOrderedAndProject" in plan(I.top_customers(facts))


def test_questions_about_orders_alone_do_not_touch_the_events(stored):
    models = M.build_models(stored)
    for df in (
        I.status_kpis(models["fct_orders"]),
        I.average_order_value(models["fct_orders"]),
        I.top_customers(models["fct_orders"]),
        I.daily_revenue(models["fct_daily_revenue"]),
    ):
        text = plan(df)
        assert "Join" not in text and "event_type" not in text


def test_columns_and_filters_reach_the_scan(stored):
    models = M.build_models(stored)
    text = plan(I.average_order_value(models["fct_orders"]))
    assert "ReadSchema: struct<order_amount:double,order_status:string>" in text
    assert "EqualTo(order_status,completed)" in text
    text = plan(I.revenue_gap(models["fct_orders"]))
    assert "event_id" not in text and "customer_id" not in text


def test_orders_and_events_shuffle_once_each_for_the_facts(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        models = M.build_models(stored)
        text = plan(I.revenue_gap(models["fct_orders"]))
        assert text.count("Exchange hashpartitioning(order_id") == 2
        # Per-key counts of both tables meet in the partitioning they already have.
        rules = [r for r in standard_rules() if isinstance(r.check, Q.RELATION_CHECKS)]
        assert plan(Q._relation_shares(stored, rules)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_samples_are_limited_in_two_levels_before_each_shuffle(stored):
    text = plan(Q.failed_samples(stored))
    # Per task, per group of tasks, and once more on either side of the last shuffle.
    assert text.count("WindowGroupLimit") == 4
    last, first = text.index("Exchange hashpartitioning(rule_id"), text.index("Exchange hashpartitioning(rule_id", text.index("task_group"))
    assert last < text.index("task_group") < first
    assert text.rindex("WindowGroupLimit") > first


def test_sample_keys_send_one_key_per_bucket_and_few_others(stored):
    found = V.find(stored, standard_rules())
    df = Q.keys_of(found)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    told_apart = next(i for i, line in enumerate(lines) if "Aggregate [rule_id" in line and "cells" in line and "min(" not in line)
    # Keys are told apart only below the filter against the n-th least of all buckets.
    assert any("<= end" in line for line in lines[told_apart:])
    assert "min(cells" in text


def test_a_quality_run_scans_each_table_three_times(stored, monkeypatch):
    """Once for the keys, once for order times or repeated keys, once for the rows."""
    written = []
    monkeypatch.setattr(V, "write_files", lambda df, path: (written.append(plan(df)), sinks.write_files(df, path)))
    report, samples = Q.run_quality_checks(stored)
    assert len(written) == 5
    for name in (S.ORDERS, S.ORDER_EVENTS):
        assert sum(text.count(f"/{name}]") for text in written) == 3
    # The other scans read stored keys.
    assert sum(text.count("FileScan") for text in written) == 6 + 5
    for df in (report, samples):
        assert f"/{S.ORDERS}]" not in plan(df) and f"/{S.ORDER_EVENTS}]" not in plan(df)


def test_row_rules_of_a_table_share_one_scan_without_a_row_shuffle(stored):
    rules = [r for r in standard_rules() if r.table_name == S.ORDERS]
    text = plan(Q._scan_shares(stored, S.ORDERS, rules))
    assert text.count("FileScan") == 1
    assert "hashpartitioning" not in text


def test_events_meet_one_row_of_order_times_per_key(stored):
    from ledgerlane.operators.sequence import conflict_counts

    text = plan(conflict_counts(stored[S.ORDERS], stored[S.ORDER_EVENTS]))
    assert text.count("FileScan") == 2 and text.count("Join") == 1 and "Window" not in text
    # Only events before their key's latest order are searched for their place.
    assert any("Join" in line and "moment" in line and "< latest" in line for line in text.splitlines())


def test_hot_keys_do_not_read_a_side_twice(spark, stored):
    tables = measured(stored, S.KEY_COLUMNS, hot_rows=3)
    plain, hot = (plan(M.build_models(t)["fct_orders"]) for t in (stored, tables))
    assert tables.hot["order_id"] and hot.count("FileScan") == plain.count("FileScan") == 2


def test_bucketed_tables_join_without_a_shuffle(spark, stored):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    warehouse = sinks.Warehouse(spark, "bucketed")
    runs.store_keyed(warehouse, stored, 4, hot_rows=3)
    orders, events = (keyed.read_keyed(warehouse, f"keyed_{n}") for n in (S.ORDERS, S.ORDER_EVENTS))
    facts = M.keyed_facts(orders, events)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(facts.ordinary)
        assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text
        rule = next(r for r in standard_rules() if r.rule_id == "R009")
        text = plan(rule.violations({S.ORDERS: orders.ordinary, S.ORDER_EVENTS: events.ordinary}))
        assert "Join" in text and "Exchange" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert orders.hot.count() > 0 and orders.whole().count() == stored[S.ORDERS].count()
    assert facts.whole().exceptAll(M.build_models(stored)["fct_orders"]).isEmpty()
    # Without hot keys there is one table.
    runs.store_keyed(warehouse, stored, 4)
    assert keyed.read_keyed(warehouse, f"keyed_{S.ORDERS}").hot is None


def test_a_date_filter_reads_its_partitions_and_a_refresh_equals_a_rebuild(spark, raw_by_profile):
    spark.sql("CREATE DATABASE IF NOT EXISTS periods")
    warehouse = sinks.Warehouse(spark, "periods")
    clean, messy = raw_by_profile["clean"], raw_by_profile["messy"]
    runs.refresh_facts(warehouse, clean, unit="year")
    facts = warehouse.table("fct_orders_by_period")
    text = plan(M.in_periods(facts, "1995-03-01", "1995-04-01", "year"))
    assert "order_period" in text.split("PartitionFilters: [")[1].split("]")[0]
    files = M.in_periods(facts, "1995-03-01", "1995-04-01", "year").select(F.input_file_name()).distinct().collect()
    assert files and all("order_period=1995-01-01" in f[0] for f in files)
    runs.refresh_facts(warehouse, messy, ["1995-01-01", "2050-01-01"], unit="year")
    rebuilt = M.with_period(M.build_models(messy)["fct_orders"], "year").where("order_period = '1995-01-01'")
    mine = warehouse.table("fct_orders_by_period").where("order_period = '1995-01-01'")
    assert mine.exceptAll(rebuilt.select(*mine.columns)).isEmpty() and mine.count() == rebuilt.count()
    other = M.with_period(M.build_models(clean)["fct_orders"], "year").where("order_period <> '1995-01-01'")
    assert warehouse.table("fct_orders_by_period").where("order_period <> '1995-01-01'").count() == other.count()
    # A period without orders any more loses its partition.
    runs.refresh_facts(warehouse, {**clean, S.ORDERS: clean[S.ORDERS].limit(0)}, ["1995-01-01"], unit="year")
    assert mine.sparkSession.table("periods.fct_orders_by_period").where("order_period = '1995-01-01'").count() == 0
