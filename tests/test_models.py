from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.plans import insights as I
from ledgerlane.plans import models as M
from ledgerlane.quality import gate as G
from ledgerlane.quality import report as Q
from ledgerlane.quality.bindings import standard_rules

T0 = "2024-01-01 10:00:00"


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def models(raw_by_profile):
    return {p: M.build_models(raw) for p, raw in raw_by_profile.items()}


# Known results on the smallest test tables.
FAILED = {
    "messy": [12, 13, 18, 24, 10, 12, 19, 7, 20, 47, 6, 10, 23],
    "clean": [0] * 13,
}


@pytest.mark.parametrize("profile", FAILED)
def test_known_failure_counts_and_gate(raw_by_profile, profile):
    raw = raw_by_profile[profile]
    report, samples = Q.run_quality_checks(raw)
    rows = report.collect()
    assert [r.failed_rows for r in rows] == FAILED[profile]
    assert [r.rule_id for r in rows] == [r.rule_id for r in standard_rules()]
    assert report.schema.simpleString() == S.DQ_REPORT.simpleString()
    assert samples.schema.simpleString() == S.DQ_FAILED_SAMPLES.simpleString()
    per_rule = {r.rule_id: r["count"] for r in samples.groupBy("rule_id").count().collect()}
    assert per_rule == {r.rule_id: min(50, r.failed_rows) for r in rows if r.failed_rows}
    assert G.would_fail(report) == (profile == "messy")
    decisions = {r.mode: r.would_fail for r in G.gate_decisions(report).collect()}
    assert decisions == {"dev": False, "prod": profile == "messy"}
    G.enforce(report, "dev")
    if profile == "messy":
        with pytest.raises(G.DataQualityError, match="R001 Duplicate primary key"):
            G.enforce(report, "prod")
    else:
        G.enforce(report, "prod")


def test_known_insights(models):
    facts, daily = models["messy"]["fct_orders"], models["messy"]["fct_daily_revenue"]
    gap = one(I.revenue_gap(facts))
    assert (gap["orders_total"], gap["orders_completed"], gap["orders_paid"]) == (
        1505,
        1328,
        1273,
    )
    assert (gap["completed_revenue"], gap["paid_revenue"]) == (325751011.27, 312304656.37)
    assert tuple(one(I.conflict_flags(facts)).values()) == (55, 2)
    assert one(I.average_order_value(facts))["avg_order_value_completed"] == 246035.51
    assert tuple(one(I.payment_to_shipment(facts)).values()) == (237.75, 236, 302)
    assert tuple(one(I.event_coverage_pct(facts)).values()) == (98.54, 87.51, 87.64, 7.97)
    assert one(I.orders_without_events(facts))["orders_without_events"] == 7
    assert [r.customer_id for r in I.top_customers(facts).take(2)] == ["C10112", "C10019"]
    assert one(I.revenue_metrics(facts))["completed_missing_customer_orders"] == 8
    smooth = I.daily_revenue_ma7(daily).agg(
        F.count("*"), F.round(F.sum("revenue_completed"), 2), F.round(F.sum("revenue_ma7"), 2)
    )
    assert tuple(smooth.first()) == (1093, 325751011.27, 324389110.30)


@pytest.mark.parametrize("profile", ["messy", "clean"])
def test_consistency_between_answers(models, profile):
    facts, daily = models[profile]["fct_orders"], models[profile]["fct_daily_revenue"]
    kpis = one(I.status_kpis(facts))
    by_day = daily.agg(
        F.round(F.sum("revenue_completed"), 2), F.sum("orders_total"), F.sum("orders_completed")
    ).first()
    assert tuple(by_day) == (
        kpis["revenue_completed"],
        kpis["orders_total"],
        kpis["orders_completed"],
    )
    gap, metrics = one(I.revenue_gap(facts)), one(I.revenue_metrics(facts))
    definitions = one(I.revenue_definitions(facts))
    assert round(metrics["completed_revenue"], 2) == gap["completed_revenue"]
    assert round(definitions["gap"], 2) == gap["revenue_gap"]
    assert metrics["paid_revenue"] <= metrics["completed_revenue"]
    assert list(one(I.event_coverage(facts)).values()) == list(
        one(I.event_coverage_pct(facts)).values()
    )
    missing = one(I.completed_missing_events(facts))
    assert missing["missing_payment"] == metrics["missing_payment_orders"]
    if profile == "clean":
        assert gap["revenue_gap"] == 0 and missing["missing_shipped"] == 0


def test_results_do_not_depend_on_partitioning(raw_by_profile, models):
    spread = {n: df.repartition(7) for n, df in raw_by_profile["messy"].items()}
    facts = M.build_models(spread)["fct_orders"]
    assert facts.exceptAll(models["messy"]["fct_orders"]).isEmpty()
    assert models["messy"]["fct_orders"].exceptAll(facts).isEmpty()


def test_facts_keep_every_order_row(tables):
    raw = tables(
        [("1", "c", T0, 1.0, "completed")] * 2
        + [(None, "c", T0, 1.0, "cancelled"), ("2", "c", "soon", 1.0, None)],
        [
            ("a", "1", "payment_confirmed", "2024-01-01 12:00:00"),
            ("b", "1", "payment_confirmed", "2024-01-01 11:00:00"),
            ("c", "1", "payment_confirmed", None),
            ("d", "1", "unheard_of", T0),
            ("e", None, "order_shipped", T0),
        ],
    )
    models = M.build_models(raw)
    rows = models["fct_orders"].orderBy(F.asc_nulls_last("order_id")).collect()
    assert [r.order_id for r in rows] == ["1", "1", "2", None]
    first, _, second, keyless = rows
    assert (first.event_count, first.payment_event_ts) == (4, dt.datetime(2024, 1, 1, 11))
    assert (first.has_payment_event, first.dq_completed_missing_payment_flag) == (1, 0)
    assert (second.event_count, second.order_created_at) == (None, None)
    assert (keyless.shipped_event_ts, keyless.dq_cancelled_has_shipment_flag) == (None, 0)
    summary = {r.order_id: r for r in models["int_order_event_summary"].collect()}
    assert (summary["1"].payment_event_count, summary["1"].shipped_event_count) == (3, 0)
    assert summary[None].shipped_event_count == 1


def test_an_unknown_event_type_is_an_event_but_no_lifecycle_time(tables):
    raw = tables(
        [("1", "c", T0, 1.0, "completed")], [("a", "1", "unheard_of", T0)]
    )
    facts = M.build_models(raw)["fct_orders"]
    assert one(I.orders_without_events(facts))["orders_without_events"] == 1
    assert Q.measure(raw, standard_rules())["R008"][0] == 0


def test_a_day_without_known_amounts_has_no_revenue(tables):
    day = "2024-01-0{} 10:00:00"
    raw = tables(
        [("1", "c", day.format(1), 4.0, "completed"), ("2", "c", day.format(2), None, "completed")]
        + [("3", "c", day.format(4), 2.0, "completed"), ("4", "c", "soon", 6.0, "completed")]
    )
    daily = M.build_models(raw)["fct_daily_revenue"]
    series = I.daily_revenue_ma7(daily).orderBy(F.asc_nulls_last("order_date")).collect()
    assert [(r.revenue_completed, r.revenue_ma7) for r in series] == [
        (4.0, 4.0),
        (None, 4.0),
        (2.0, 3.0),
        (6.0, 4.0),
    ]
    bounds = one(I.daily_revenue_bounds(daily))
    assert bounds["start_date"] == dt.date(2024, 1, 1)
    assert bounds["end_date"] == dt.date(2024, 1, 4)


def test_the_mean_covers_seven_rows_whatever_the_dates(tables):
    raw = tables(
        [(str(i), "c", f"2024-{i:02d}-01 00:00:00", float(i), "completed") for i in range(1, 11)]
    )
    series = I.daily_revenue_ma7(M.build_models(raw)["fct_daily_revenue"])
    assert series.orderBy(F.desc("order_date")).first()["revenue_ma7"] == 7.0


def test_empty_tables(tables):
    facts = M.build_models(tables())["fct_orders"]
    assert list(one(I.conflict_flags(facts)).values()) == [None, None]
    gap = one(I.revenue_gap(facts))
    assert (gap["orders_total"], gap["completed_revenue"], gap["revenue_gap_pct"]) == (
        0,
        None,
        None,
    )
    assert set(one(I.revenue_metrics(facts)).values()) == {0}
    assert set(one(I.revenue_definitions(facts)).values()) == {0.0}
    assert one(I.event_coverage_pct(facts))["pct_with_created_event"] is None
    assert one(I.orders_without_events(facts))["orders_without_events"] == 0


def test_zero_revenue_is_null_percent_in_one_and_zero_in_the_other(tables):
    facts = M.build_models(tables([("1", "c", T0, 0.0, "completed")]))["fct_orders"]
    assert one(I.revenue_gap(facts))["revenue_gap_pct"] is None
    assert one(I.revenue_metrics(facts))["revenue_gap_pct"] == 0.0
    assert one(I.revenue_definitions(facts))["gap_pct"] == 0.0


def test_shipments_before_payment_are_left_out_and_minutes_are_boundaries(tables):
    raw = tables(
        [(k, "c", T0, 1.0, "completed") for k in "ab"],
        [
            ("1", "a", "payment_confirmed", "2024-01-01 10:00:59"),
            ("2", "a", "order_shipped", "2024-01-01 10:01:00"),
            ("3", "b", "payment_confirmed", "2024-01-01 12:00:00"),
            ("4", "b", "order_shipped", "2024-01-01 11:00:00"),
        ],
    )
    answer = one(I.payment_to_shipment(M.build_models(raw)["fct_orders"]))
    assert list(answer.values()) == [1.0, 1, 1]


def test_customers_with_equal_revenue_are_ordered_by_name(tables):
    raw = tables(
        [(str(i), f"c{i % 12:02d}", T0, 5.0, "completed") for i in range(24)]
        + [("x", None, T0, 99.0, "completed"), ("y", "c00", T0, 1000.0, "refunded")]
    )
    top = I.top_customers(M.build_models(raw)["fct_orders"]).collect()
    assert [r.customer_id for r in top] == ["UNKNOWN"] + [f"c{i:02d}" for i in range(9)]
