"""Complete batch runs: load and check raw tables, build the models, answer the insights."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.operators.lookup import (
    HOT_ROWS,
    hot_frame,
    hot_values,
)
from ledgerlane.plans import insights as I
from ledgerlane.plans import models as M
from ledgerlane.quality.gate import enforce
from ledgerlane.quality.report import run_quality_checks
from ledgerlane.quality.rules import Rule, Tables
from ledgerlane.sources.keyed import read_keyed, write_keyed
from ledgerlane.sources.readers import typed_timestamps
from ledgerlane.sources.sinks import RunContext, Warehouse, stamp, write_csv


def check(
    spark: SparkSession,
    tables: Tables,
    reports_path: str,
    rules: Sequence[Rule] | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Check the raw tables and write report and samples; nothing is loaded.

    Hot keys are found on the way. Returns both as written.
    """
    report_path, samples_path = (
        f"{reports_path}/data_quality_report",
        f"{reports_path}/failed_samples",
    )
    report, samples = run_quality_checks(tables, rules, hot_rows)
    # Both have a bounded number of rows (one, or 50, per rule): a single file each,
    # by a last small shuffle that leaves the stages before it parallel.
    report.repartition(1).write.mode("overwrite").parquet(f"{report_path}.parquet")
    samples.repartition(1).write.mode("overwrite").parquet(f"{samples_path}.parquet")
    report = spark.read.parquet(f"{report_path}.parquet").orderBy("rule_id")
    samples = spark.read.parquet(f"{samples_path}.parquet")
    write_csv(report, f"{report_path}.csv", files=1)
    write_csv(samples, f"{samples_path}.csv", files=1)
    return report, samples


def ingest(
    tables: Tables,
    warehouse: Warehouse,
    reports_path: str,
    mode: str = S.DEV,
    overwrite: bool = True,
    rules: Sequence[Rule] | None = None,
) -> None:
    """Check the raw tables, write report and samples, load all four tables, then gate.

    Rules see the raw texts, the warehouse gets typed timestamps. In production mode a
    critical failure raises only after everything is written.
    """
    report, samples = check(warehouse.spark, tables, reports_path, rules)
    typed_orders = typed_timestamps(tables[S.ORDERS], "order_created_at")
    typed_events = typed_timestamps(tables[S.ORDER_EVENTS], "event_timestamp")
    warehouse.write("raw_orders", typed_orders, overwrite)
    warehouse.write("raw_order_events", typed_events, overwrite)
    warehouse.write("dq_report", report, overwrite)
    warehouse.write("dq_failed_samples", samples, overwrite)
    enforce(report, mode)


def transform(warehouse: Warehouse) -> None:
    """Staging views and the three model tables, from the loaded raw tables."""
    warehouse.require("raw_orders", "raw_order_events")
    orders = M.stg_orders(warehouse.table("raw_orders"))
    events = M.stg_order_events(warehouse.table("raw_order_events"))
    orders.createOrReplaceTempView("stg_orders")
    events.createOrReplaceTempView("stg_order_events")
    warehouse.write("int_order_event_summary", M.int_order_event_summary(events))
    summary = warehouse.table("int_order_event_summary")
    hot = hot_frame(warehouse.spark, hot_values(orders, "order_id"), "order_id")
    warehouse.write("fct_orders", M.fct_orders(orders, summary, hot))
    facts = warehouse.table("fct_orders")
    warehouse.write("fct_daily_revenue", M.fct_daily_revenue(facts))


def analyse(
    warehouse: Warehouse,
    context: RunContext,
    insights: Sequence[I.Insight] = I.INSIGHTS,
) -> DataFrame:
    """Write the metrics record (replaced) and every insight, stamped with the run.

    Insight tables keep one partition per run: another run adds its own, the same run_id again
    replaces what it wrote before. A failing insight does not stop the others. Returns one status row per insight.
    """
    warehouse.require("fct_orders")
    metrics = I.revenue_metrics(warehouse.table("fct_orders"))
    warehouse.write("revenue_metrics", stamp(metrics, context))
    outcome = []
    for insight in insights:
        try:
            answer = insight.query(warehouse.table(insight.table))
            warehouse.write_parts(insight.name, stamp(answer, context), "run_id")
            outcome.append((insight.name, insight.title, "ok", None))
        except Exception as error:  # whatever it is, the others still run
            outcome.append((insight.name, insight.title, "error", str(error)))
    return warehouse.spark.createDataFrame(
        outcome, "insight string, title string, status string, error string"
    ).withColumn("run_id", F.lit(context.run_id))


def store_keyed(warehouse: Warehouse, tables: Tables, buckets: int, hot_rows: int = HOT_ROWS) -> None:
    """Store both raw tables in buckets of order_id, rows of hot keys beside them.

    Once stored, facts, summaries and rules by order_id join them without a shuffle.
    """
    both = tables[S.ORDERS].select("order_id").unionAll(tables[S.ORDER_EVENTS].select("order_id"))
    hot = hot_frame(warehouse.spark, hot_values(both, "order_id", hot_rows), "order_id")
    for name, df in tables.items():
        write_keyed(warehouse, f"keyed_{name}", df, "order_id", buckets, hot)


def keyed_facts(warehouse: Warehouse) -> DataFrame:
    """``fct_orders`` from the tables that ``store_keyed`` has written."""
    return M.keyed_facts(*[read_keyed(warehouse, f"keyed_{n}") for n in (S.ORDERS, S.ORDER_EVENTS)]).whole()


def refresh_facts(warehouse: Warehouse, tables: Tables, periods: Sequence[str] | None = None, unit: str = "day") -> None:
    """Rebuild the stored facts of the given periods (their first days), or of all.

    Only orders of these periods are joined, and only their partitions are replaced; a period
    without orders any more loses its partition. Undated orders form a partition of their own, which
    a refresh of all periods replaces.
    """
    chosen = dict(tables)
    if periods is not None:
        created = X.lenient_wall_time(tables[S.ORDERS], "order_created_at")
        first_day = F.to_date(F.date_trunc(unit, created))
        chosen[S.ORDERS] = tables[S.ORDERS].where(first_day.isin([datetime.date.fromisoformat(p) for p in periods]))
    facts = M.with_period(M.build_models(chosen)["fct_orders"], unit)
    if periods is None:
        warehouse.drop("fct_orders_by_period")
    warehouse.write_parts("fct_orders_by_period", facts, M.PERIOD)
    if periods is not None:
        found = {str(r[0]) for r in facts.select(M.PERIOD).distinct().collect()}  # at most the given periods
        warehouse.drop_parts("fct_orders_by_period", M.PERIOD, [p for p in periods if p not in found])
