"""Whole runs against a warehouse: load and check, build, answer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.operators.firsts import preview, sample_keys
from ledgerlane.plans import insights as I
from ledgerlane.plans import runs
from ledgerlane.quality.gate import DataQualityError
from ledgerlane.sources.readers import read_raw
from ledgerlane.sources.sinks import RunContext, Warehouse, write_csv


def fresh(spark, name):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    return Warehouse(spark, name)


def landed(spark, raw, folder):
    for name, df in raw.items():
        write_csv(df, f"{folder}/{name}")
    return read_raw(spark, f"{folder}/{S.ORDERS}", f"{folder}/{S.ORDER_EVENTS}")


def test_a_full_run_from_csv(spark, raw_by_profile, tmp_path):
    warehouse = fresh(spark, "full_run")
    tables = landed(spark, raw_by_profile["messy"], tmp_path / "raw")
    runs.ingest(tables, warehouse, str(tmp_path / "reports"))
    report = spark.read.option("header", True).csv(
        str(tmp_path / "reports" / "data_quality_report.csv")
    )
    assert report.columns == S.DQ_REPORT.fieldNames() and report.count() == 13
    assert warehouse.table("dq_failed_samples").count() == 221
    assert dict(warehouse.table("raw_orders").dtypes)["order_created_at"] == "timestamp"

    runs.transform(warehouse)
    assert spark.table("stg_orders").count() == 1505
    assert warehouse.table("fct_orders").count() == 1505

    context = RunContext("messy", 1500, 42, "dev")
    status = runs.analyse(warehouse, context)
    assert [r.status for r in status.collect()] == ["ok"] * 9
    runs.analyse(warehouse, RunContext("messy", 1500, 42, "dev"))
    assert warehouse.table("revenue_metrics").count() == 1
    gaps = warehouse.table("insight_01_revenue_gap")
    assert gaps.count() == 2 and gaps.select("run_id").distinct().count() == 2
    assert gaps.filter(F.col("run_id") == context.run_id).first()["orders_paid"] == 1273
    # The same run again replaces its own rows.
    runs.analyse(warehouse, context)
    assert warehouse.table("insight_01_revenue_gap").count() == 2


def test_production_fails_after_everything_is_written(spark, raw_by_profile, tmp_path):
    warehouse = fresh(spark, "prod_run")
    with pytest.raises(DataQualityError, match="R004"):
        runs.ingest(raw_by_profile["messy"], warehouse, str(tmp_path), mode="prod")
    assert warehouse.table("dq_report").count() == 13
    assert warehouse.table("raw_order_events").count() == 4265
    # A second load that keeps tables leaves all four as they are, and passes.
    runs.ingest(
        raw_by_profile["clean"], warehouse, str(tmp_path), mode="prod", overwrite=False
    )
    assert warehouse.table("raw_orders").count() == 1505
    assert warehouse.table("dq_report").filter("failed_rows > 0").count() == 13
    # Replacing takes the clean tables; the samples keep their columns without any row.
    runs.ingest(raw_by_profile["clean"], warehouse, str(tmp_path), mode="prod")
    assert warehouse.table("raw_orders").count() == 1500
    samples = warehouse.table("dq_failed_samples")
    assert samples.columns == S.DQ_FAILED_SAMPLES.fieldNames() and samples.isEmpty()


def test_a_failing_insight_does_not_stop_the_others(spark, raw_by_profile, tmp_path):
    warehouse = fresh(spark, "broken_run")
    runs.ingest(raw_by_profile["clean"], warehouse, str(tmp_path))
    runs.transform(warehouse)
    broken = I.Insight("broken", "Broken", "fct_orders", lambda df: df.select("nothing"))
    absent = I.Insight("absent", "Absent", "no_table", lambda df: df)
    status = runs.analyse(
        warehouse, RunContext("clean", 1500, 42, "dev"), (broken, absent, I.INSIGHTS[1])
    )
    rows = status.collect()
    assert [r.status for r in rows] == ["error", "error", "ok"]
    assert "nothing" in rows[0].error and "no_table" in rows[1].error


def test_steps_name_the_tables_they_lack(spark):
    warehouse = fresh(spark, "empty_run")
    with pytest.raises(LookupError, match="raw_orders"):
        runs.transform(warehouse)
    with pytest.raises(LookupError, match="fct_orders"):
        runs.analyse(warehouse, RunContext("clean", 1, 1, "dev"))


def test_preview_tells_what_it_leaves_out(spark):
    rows, state = preview(spark.range(25).orderBy("id"))
    assert (rows.count(), state) == (10, "truncated")
    assert preview(spark.range(10))[1] == "all"
    assert preview(spark.range(0))[1] == "no rows"
    assert preview(spark.range(3).select())[1] == "no columns"


def test_sample_keys_of_a_frame(spark):
    df = spark.createDataFrame(
        [("b", 1), ("a", 2), ("a", 2), (None, 3), ("a", None)], "k string, n int"
    )
    assert sample_keys(df, ["k", "n"]).first()[0] == "a,2; a,nan; b,1; nan,3"
    assert sample_keys(df, ["k"], 2).first()[0] == "a; b"
    assert sample_keys(df.limit(0), ["k"]).first()[0] == ""
