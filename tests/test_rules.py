"""Each rule on a handful of rows: missing keys, copies, empty tables, zero totals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.operators import firsts
from ledgerlane.operators.lookup import measured
from ledgerlane.operators.sequence import later_than
from ledgerlane.quality import report as Q
from ledgerlane.quality import rules as R
from ledgerlane.quality import violations as V
from ledgerlane.quality.bindings import standard_rules
from tests.test_sequence import random_tables

T0 = "2024-01-01 00:00:00"
RULES = {r.rule_id: r for r in standard_rules()}


def order(order_id, customer="c", created=T0, amount=1.0, status="completed"):
    return (order_id, customer, created, amount, status)


def event(event_id, order_id, kind="payment_confirmed", at=T0):
    return (event_id, order_id, kind, at)


def failures(raw, *rule_ids):
    counts = Q.measure(raw, standard_rules())
    found = {}
    for rule_id in rule_ids or RULES:
        violations = RULES[rule_id].violations(raw)
        measure = (
            F.coalesce(F.sum("later_orders"), F.lit(0))
            if rule_id == "R013"
            else F.count("*")
        )
        # The fused count and the listed rows must tell the same.
        assert violations.agg(measure).first()[0] == counts[rule_id][0], rule_id
        found[rule_id] = counts[rule_id][0]
    return found


def test_all_rules_pass_on_consistent_rows(tables):
    raw = tables(
        [order("1"), order("2", status="cancelled")],
        [event("a", "1"), event("b", "2", "order_cancelled")],
    )
    assert set(failures(raw).values()) == {0}


def test_empty_tables_fail_nothing_and_have_rate_zero(tables):
    raw = tables()
    assert set(failures(raw).values()) == {0}
    report, samples = Q.run_quality_checks(raw)
    assert [r.rule_id for r in report.collect()] == list(RULES)
    assert {(r.total_rows, r.failure_rate, r.sample_keys) for r in report.collect()} == {
        (0, 0.0, "")
    }
    assert samples.columns == S.DQ_FAILED_SAMPLES.fieldNames()
    assert samples.isEmpty()


def test_every_copy_of_a_key_is_a_duplicate_and_missing_keys_equal_each_other(tables):
    raw = tables(
        [order("1"), order("1"), order("2"), order(None), order(None)],
        [event(None, "1"), event(None, "1"), event("a", "1"), event("b", "1")],
    )
    found = failures(raw, "R001", "R002")
    assert found == {"R001": 2, "R002": 4}


def test_a_single_missing_key_is_no_duplicate(tables):
    raw = tables([order(None), order("1")], [event(None, "1"), event("a", "1")])
    assert failures(raw, "R001", "R002") == {"R001": 0, "R002": 0}


def test_required_fields_do_not_include_the_currency(tables, spark):
    raw = tables([order("1"), order("2", customer=None), order("3", amount=None)])
    raw[S.ORDERS] = raw[S.ORDERS].withColumn("currency", F.lit(None).cast("string"))
    assert failures(raw, "R004") == {"R004": 2}


def test_missing_values_are_outside_the_domain_and_zero_is_not_negative(tables):
    raw = tables(
        [order("1", status=None), order("2", status="lost"), order("3", amount=0.0)]
        + [order("4", amount=-0.01), order("5", amount=None)],
        [event("a", "1", None), event("b", "1", "opened"), event("c", "1")],
    )
    assert failures(raw, "R005", "R006", "R007") == {"R005": 2, "R006": 2, "R007": 2}


def test_missing_keys_never_match_between_orders_and_events(tables):
    raw = tables([order(None), order("1")], [event("a", None), event("b", "2")])
    assert failures(raw, "R008", "R009") == {"R008": 2, "R009": 2}


def test_a_payment_without_key_pays_orders_without_key(tables):
    orders = [order(None), order(None), order("1"), order(None, status="refunded")]
    unpaid = tables(orders, [event("a", None, "order_shipped"), event("b", "1")])
    assert failures(unpaid, "R010") == {"R010": 2}
    paid = tables(orders, [event("a", None), event("b", "2")])
    assert failures(paid, "R010") == {"R010": 1}


def test_a_payment_counts_whatever_its_timestamp_but_not_in_the_flag(tables):
    from ledgerlane.plans.models import build_models

    raw = tables([order("1")], [event("a", "1", at="soon")])
    assert failures(raw, "R010") == {"R010": 0}
    flagged = build_models(raw)["fct_orders"].first()
    assert flagged.dq_completed_missing_payment_flag == 1
    assert flagged.event_count == 1


def test_completed_orders_are_the_total_of_the_payment_rule(tables):
    raw = tables([order("1"), order("2", status="refunded"), order("3", status=None)])
    assert Q.measure(raw, standard_rules())["R010"] == (1, 1)


def test_a_rate_may_exceed_one_when_an_event_conflicts_with_several_orders(tables):
    raw = tables([order("1")] * 3, [event("a", "1", at="2023-01-01 00:00:00")])
    report = {r.rule_id: r for r in Q.quality_report(raw).collect()}
    assert (report["R013"].failed_rows, report["R013"].failure_rate) == (3, 3.0)
    samples = Q.failed_samples(raw).filter("rule_id = 'R013'").collect()
    assert [r.event_id for r in samples] == ["a"] * 3


def test_sample_rows_and_keys_are_the_first_in_order(tables):
    raw = tables(
        [order(f"{i:03d}", amount=-1.0) for i in range(60)]
        + [order(None, amount=-1.0), order("000", amount=-2.0)]
    )
    samples = Q.failed_samples(raw).filter("rule_id = 'R007'").collect()
    assert len(samples) == 50
    assert [(r.order_id, r.order_amount) for r in samples[:3]] == [
        ("000", -2.0),
        ("000", -1.0),
        ("001", -1.0),
    ]
    report = {r.rule_id: r for r in Q.quality_report(raw).collect()}
    assert report["R007"].sample_keys == "000; 001; 002; 003; 004"
    few = tables([order(None, amount=-1.0)] * 3 + [order("x", amount=-1.0)])
    report = {r.rule_id: r for r in Q.quality_report(few).collect()}
    assert report["R007"].sample_keys == "x; nan"


def test_two_key_columns_are_joined_by_commas(tables):
    raw = tables([], [event("b", "2"), event("a", "2"), event("c", None)])
    report = {r.rule_id: r for r in Q.quality_report(raw).collect()}
    assert report["R009"].sample_keys == "2,a; 2,b; nan,c"


def test_own_rules_on_own_tables(spark):
    shops = spark.createDataFrame(
        [(1, "open"), (2, "shut"), (2, None)], "shop_id bigint, state string"
    )
    rules = (
        R.duplicate_pk("shops", "shop_id", "S1", S.WARNING, ["shop_id"]),
        R.allowed_values("shops", "state", ["open"], "S2", S.CRITICAL, ["shop_id", "state"]),
        R.not_null("shops", ["state", "shop_id"], "S3", S.WARNING, ["state"]),
    )
    report, samples = Q.run_quality_checks({"shops": shops}, rules)
    assert [(r.rule_id, r.failed_rows, r.total_rows, r.sample_keys) for r in report.collect()] == [
        ("S1", 2, 3, "2"),
        ("S2", 2, 3, "shut; nan"),
        ("S3", 1, 3, "nan"),
    ]
    assert samples.count() == 5
    assert {"shop_id", "state"} <= set(samples.columns)


def test_rule_names_are_free_and_other_tables_may_have_order_keys(tables, spark):
    raw = tables([order("1")], [event("a", "1")])
    raw["returns"] = spark.createDataFrame([("1",), ("1",), ("2",)], "order_id string")
    rules = (
        R.orders_without_events("it's -1-", S.WARNING, ["order_id"]),
        R.duplicate_pk("returns", "order_id", "twice\\", S.WARNING, ["order_id"]),
        R.not_null("returns", ["order_id"], "a b", S.WARNING, ["order_id"]),
    )
    report, samples = Q.run_quality_checks(raw, rules)
    assert [(r.rule_id, r.failed_rows, r.total_rows) for r in report.collect()] == [
        ("it's -1-", 0, 1),
        ("twice\\", 2, 3),
        ("a b", 0, 3),
    ]
    assert [r.rule_id for r in samples.collect()] == ["twice\\"] * 2


@pytest.mark.parametrize("rule_id", list(RULES))
def test_hot_keys_do_not_change_a_rule(raw_by_profile, rule_id):
    """With every repeated key isolated, the rules list the same rows."""
    raw = raw_by_profile["messy"]
    expected = sorted(RULES[rule_id].violations(raw).collect(), key=str)
    tables = measured(raw, S.KEY_COLUMNS, hot_rows=2)
    assert len(tables.hot["order_id"]) > 100
    assert sorted(RULES[rule_id].violations(tables).collect(), key=str) == expected


def test_hot_keys_do_not_change_a_run(raw_by_profile):
    """With keys of few rows taken as hot, counts, keys and samples stay the same."""
    raw = raw_by_profile["messy"]
    plain = [sorted(df.collect(), key=str) for df in Q.run_quality_checks(raw)]
    hot = [sorted(df.collect(), key=str) for df in Q.run_quality_checks(raw, hot_rows=3)]
    assert hot == plain


def test_a_run_over_random_tables_equals_the_rules_one_by_one(tables):
    for seed in range(3):
        _, _, raw = random_tables(seed, tables)
        found = V.find(raw, list(RULES.values()), hot_rows=(1, 4, 100)[seed])
        for rule in RULES.values():
            rows = rule.violations(raw)
            failed = rows.agg({"later_orders": "sum"}).first()[0] or 0 if rule.rule_id == "R013" else rows.count()
            assert found.counts[rule.rule_id][0] == failed, rule.rule_id


def test_more_rules_than_bits_and_checks_of_another_kind(spark):
    class Small(R.Check):
        def violations(self, tables, table):
            return tables[table].filter("n < 3")

    shops = spark.createDataFrame([(i, i % 5) for i in range(20)], "shop_id bigint, n int")
    rules = [R.allowed_values("shops", "n", [i % 5], f"A{i:03d}", S.WARNING, ["shop_id"]) for i in range(70)]
    rules.append(R.Rule("Z", "Small", "shops", S.WARNING, Small(), ("shop_id",), ("shop_id", "n")))
    report, samples = Q.run_quality_checks({"shops": shops}, rules)
    rows = report.collect()
    assert [(r.failed_rows, r.total_rows) for r in rows] == [(16, 20)] * 70 + [(12, 20)]
    assert rows[-1].sample_keys == "0; 1; 10; 11; 12"
    assert samples.count() == 70 * 16 + 12


def test_empty_tables_have_a_report(tables):
    report, samples = Q.run_quality_checks(tables([], []))
    assert {(r.failed_rows, r.total_rows, r.failure_rate, r.sample_keys) for r in report.collect()} == {(0, 0, 0.0, "")}
    assert samples.count() == 0


def test_first_keys_are_exact_whatever_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(firsts, "KEY_BUCKETS", 3)
    rows = [("a", f"{i % 40:02d}") for i in range(400)] + [("b", "x"), ("b", "x"), ("c", None), ("c", "1")]
    df = spark.createDataFrame(rows, "g string, k string").selectExpr("g", f"{firsts.key_cells(['k'])} AS cells")
    found = {r["g"]: r["sample_keys"] for r in firsts.first_keys(df, "g", "cells", 5).collect()}
    assert found == {"a": "00; 01; 02; 03; 04", "b": "x", "c": "1; nan"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 33])
def test_binary_search_counts_later_entries(spark, size):
    moments = sorted([(i * 7) % 20 for i in range(size)])
    df = spark.createDataFrame([(moments, m) for m in range(-1, 22)], "moments array<int>, moment int")
    for r in df.withColumn("later", later_than(F.col("moments"), F.col("moment"))).collect():
        assert r["later"] == sum(x > r["moment"] for x in moments)
