"""Failure counts, sample keys and sample rows of a set of rules.

A run finds and stores all violating rows first (``violations``). ``count_failures`` needs no
stored rows and stays lazy. It does not run rule by rule either: row predicates of one table share one scan without
a shuffle. The rules that compare orders with events share one join of per-key counts,
one row a key on either side, so that neither hot keys nor copies reach a task unreduced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.operators.firsts import first_keys, first_rows, key_cells
from ledgerlane.operators.lookup import HOT_ROWS
from ledgerlane.quality import rules as R
from ledgerlane.quality.bindings import standard_rules
from ledgerlane.quality.rules import Rule, Tables
from ledgerlane.quality.violations import (
    RELATION_CHECKS,
    Found,
    find,
    is_order_key_duplicate,
    sql_text,
    violating,
)

def run_quality_checks(
    tables: Tables, rules: Sequence[Rule] | None = None, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The report (one row per rule) and the failed samples.

    The tables are read at once, and their violating rows stored with all counts
    (``violations.find``); report and samples read what was stored. No hot keys need be
    measured before: the pass over the keys finds them.
    """
    found = find(tables, tuple(rules or standard_rules()), hot_rows)
    return report_of(found, tables), samples_of(found, tables, found.rules)


def quality_report(tables: Tables, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per rule in the order of the rules."""
    return report_of(find(tables, tuple(rules or standard_rules())), tables)


def failed_samples(
    tables: Tables,
    rules: Sequence[Rule] | None = None,
    shown_for: Sequence[Rule] = (),
    n: int = R.SAMPLE_ROWS,
) -> DataFrame:
    """Up to ``n`` violating rows of each rule, first in the order of the sample columns.

    The columns are the same whichever rules fail; a rule leaves those it does not show
    NULL. ``shown_for`` adds the columns of rules beyond those evaluated.
    """
    rules = tuple(standard_rules() if rules is None else rules)
    return samples_of(find(tables, rules), tables, (*rules, *shown_for), n)


def rule_sample_keys(tables: Tables, rules: Sequence[Rule]) -> DataFrame:
    """rule_id and the text of its first five distinct keys; rules without failures are absent."""
    return keys_of(find(tables, rules))


def report_of(found: Found, tables: Tables) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    report = spark.createDataFrame(
        [
            (i, r.rule_id, r.rule_name, r.table_name, r.severity, *found.counts[r.rule_id])
            for i, r in enumerate(found.rules)
        ],
        "position int, rule_id string, rule_name string, table_name string,"
        " severity string, failed_rows bigint, total_rows bigint",
    ).withColumn(
        "failure_rate", X.ratio_or_zero(F.col("failed_rows"), F.col("total_rows"))
    )
    if found.failing():
        keys = F.broadcast(keys_of(found))  # one row per rule
        report = report.join(keys, "rule_id", "left")
    else:
        report = report.withColumn("sample_keys", F.lit(None).cast("string"))
    return (
        report.withColumn("sample_keys", F.coalesce("sample_keys", F.lit("")))
        .orderBy("position")
        .select(*S.DQ_REPORT.fieldNames())
    )


def keys_of(found: Found) -> DataFrame:
    parts = violating(found, lambda rule, df: {"cells": key_cells(rule.keys_in(df))})
    return first_keys(reduce(DataFrame.unionByName, parts), "rule_id", "cells")


def samples_of(
    found: Found, tables: Tables, shown_for: Sequence[Rule], n: int = R.SAMPLE_ROWS
) -> DataFrame:
    extra = dict.fromkeys(c for r in shown_for for c in r.sample_columns)
    columns = tuple(dict.fromkeys(S.SAMPLE_COLUMNS + tuple(extra)))
    kinds = {f.name: f.dataType for f in S.DQ_FAILED_SAMPLES.fields}
    if not found.failing():
        spark = next(iter(tables.values())).sparkSession
        kind = {c: kinds.get(c, T.StringType()) for c in ("rule_id", *columns)}
        fields = [T.StructField(c, k) for c, k in kind.items()]
        return spark.createDataFrame([], T.StructType(fields))

    def shown(rule: Rule, df: DataFrame) -> dict[str, str]:
        return {
            c: f"CAST({f'`{c}`' if c in rule.sample_columns else 'NULL'} AS "
            f"{kinds.get(c, T.StringType()).simpleString()})"
            for c in columns
        }

    parts = violating(found, shown, repeated=n)
    return first_rows(reduce(DataFrame.unionByName, parts), "rule_id", columns, n)


def measure(tables: Tables, rules: Sequence[Rule]) -> dict[str, tuple[int, int]]:
    """rule_id -> (failed_rows, total_rows), without storing violating rows."""
    rows = count_failures(tables, rules).collect()
    return {r["rule_id"]: (r["failed_rows"], r["total_rows"]) for r in rows}


def count_failures(tables: Tables, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, failed_rows, total_rows, lazily. Every pass adds its share of either number."""
    shares: list[DataFrame] = []
    for table in dict.fromkeys(rule.table_name for rule in rules):
        shares.append(
            _scan_shares(tables, table, [r for r in rules if r.table_name == table])
        )
    relations = [r for r in rules if isinstance(r.check, RELATION_CHECKS)]
    if relations:
        # Duplicate order keys fall out of the same per-key counts.
        relations += [r for r in rules if is_order_key_duplicate(r)]
        shares.append(_relation_shares(tables, relations))
    for rule in rules:
        if isinstance(rule.check, R.EventBeforeOrder):
            pairs = {rule: F.sum("later_orders")}
            shares.append(_shares(rule.check.pair_counts(tables), pairs))
        elif isinstance(rule.check, R.DuplicateCheck) and rule not in relations:
            repeated = rule.check.repeated(tables, rule.table_name)
            shares.append(_shares(repeated, {rule: F.sum("rows")}))
    return (
        reduce(DataFrame.unionByName, shares)
        .groupBy("rule_id")
        .agg(
            F.sum("failed").alias("failed_rows"), F.sum("total").alias("total_rows")
        )
    )


def _scan_shares(tables: Tables, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One scan of a table: every rule's row total, and the failures of row predicates."""
    df = tables[table]
    failed = {
        rule: F.count_if(rule.check.predicate(df))
        for rule in rules
        if isinstance(rule.check, R.RowCheck)
    }
    return _shares(df, failed, totals=rules)


def _relation_shares(tables: Tables, rules: Sequence[Rule]) -> DataFrame:
    """Orders against events through one join of their per-key row counts."""
    orders = (
        tables[S.ORDERS]
        .groupBy("order_id")
        .agg(
            F.count("*").alias("n_orders"),
            F.count_if(F.col("order_status") == S.COMPLETED).alias("n_completed"),
        )
    )
    events = (
        tables[S.ORDER_EVENTS]
        .groupBy("order_id")
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(F.col("event_type") == S.PAYMENT_CONFIRMED).alias("n_payments"),
        )
        .withColumnRenamed("order_id", "event_order_id")
    )
    # Plain equality leaves missing keys unmatched, as the first two rules want.
    both = orders.join(
        events, F.col("order_id") == F.col("event_order_id"), "full_outer"
    )

    def total(condition: Column, value: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))

    unpaid = total(F.coalesce("n_payments", F.lit(0)) == 0, "n_completed")
    # For payments a missing key does match a missing key.
    keyless_completed = total(F.col("order_id").isNull(), "n_completed")
    keyless_payments = total(F.col("event_order_id").isNull(), "n_payments")

    def failures(check: R.Check, table: str) -> Column:
        if isinstance(check, R.OrdersWithoutEvents):
            return total(F.col("n_events").isNull(), "n_orders")
        if isinstance(check, R.EventsWithoutOrders):
            return total(F.col("n_orders").isNull(), "n_events")
        if isinstance(check, R.CompletedWithoutPayment):
            return unpaid - F.when(keyless_payments > 0, keyless_completed).otherwise(0)
        counted = "n_orders" if table == S.ORDERS else "n_events"
        return total(F.col(counted) > 1, counted)

    return _shares(both, {r: failures(r.check, r.table_name) for r in rules})


def _shares(
    df: DataFrame, failed: dict[Rule, Column], totals: Sequence[Rule] = ()
) -> DataFrame:
    """Aggregate once, then one row (rule_id, failed, total) per rule."""
    rules = list(dict.fromkeys([*failed, *totals]))
    populations = list(dict.fromkeys(r.check.population for r in totals))
    sums = df.agg(
        *[c.alias(f"failed_{rules.index(r)}") for r, c in failed.items()],
        *[F.expr(f"count_if({p})").alias(f"total_{i}") for i, p in enumerate(populations)],
    )
    rows = []
    for i, rule in enumerate(rules):
        n_failed = f"failed_{i}" if rule in failed else "0"
        n_total = (
            f"total_{populations.index(rule.check.population)}" if rule in totals else "0"
        )
        rows.append(
            f"{sql_text(rule.rule_id)}, CAST(coalesce({n_failed}, 0) AS BIGINT),"
            f" CAST({n_total} AS BIGINT)"
        )
    return sums.selectExpr(
        f"stack({len(rows)}, {', '.join(rows)}) AS (rule_id, failed, total)"
    )
