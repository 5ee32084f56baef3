"""Every violating row of a set of rules, found and written in one pass over each table.

A stored row carries a bit per rule it breaks, and all counts are taken by Spark's Observation
while the rows are written, so that report, sample keys and sample rows read only what was
stored. What rows cannot tell by themselves is prepared per key:

1. **Order keys.** Counts of orders and events per key meet in one full outer join, one row a key
   on either side. Only keys that break a rule, and hot ones, are stored.
2. **Order times.** For keys with an event before an order: the sorted moments of their orders,
   one row a key; hot keys are ranked by calendar instead.
3. **Repeated keys** of any other column.

Then each table is read once. Its row rules are evaluated, its rows look their keys up (hot keys
spread over several tasks, both sides read once), and rows that break nothing are dropped. Observed
counts are taken in the stage that writes, whose tasks count once however often they run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.operators.lookup import (
    HOT_ROWS,
    HOT_SHARE,
    NULLABLE_KEY,
    lookup_join,
    split_hot,
    with_nullable_key,
)
from ledgerlane.operators.sequence import POINT, later_than, order_moments, orders_after
from ledgerlane.quality import rules as R
from ledgerlane.quality.rules import Rule, Tables
from ledgerlane.session import shared_folder
from ledgerlane.sources.sinks import write_files

RELATION_CHECKS = (R.OrdersWithoutEvents, R.EventsWithoutOrders, R.CompletedWithoutPayment)
KEY_CHECKS = (*RELATION_CHECKS, R.EventBeforeOrder)

# Bits of one stored mask; tables with more rules are read once per so many.
MASK_BITS = 62
BROKEN, PAIRS = "broken_rules", "later_orders"


@dataclass(frozen=True)
class Part:
    """Stored violating rows of one table; the rules' places are their bits."""

    rules: tuple[Rule, ...]
    rows: DataFrame

    def breaks(self, rule: Rule) -> Column:
        return has_bit(F.col(BROKEN), self.rules.index(rule))


@dataclass(frozen=True)
class Found:
    """rule_id -> (failed rows, total rows), and the violating rows."""

    rules: tuple[Rule, ...]
    counts: dict[str, tuple[int, int]]
    parts: tuple[Part, ...]

    def failing(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if self.counts[r.rule_id][0] > 0)


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def bits(conditions: dict[int, Column]) -> Column:
    """A mask with the bit of every condition that holds."""
    set_bits = [F.when(c, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b, c in conditions.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), set_bits, F.lit(0).cast("bigint"))


def find(tables: Tables, rules: Sequence[Rule], hot_rows: int = HOT_ROWS) -> Found:
    """Evaluate all rules; runs the jobs at once."""
    run = _Run(tables, tuple(rules), hot_rows)
    counts: dict[str, tuple[int, int]] = {}
    parts = []
    for table in dict.fromkeys(rule.table_name for rule in rules):
        own = [r for r in rules if r.table_name == table]
        for low in range(0, len(own), MASK_BITS):
            part, counted = run.table_pass(table, tuple(own[low : low + MASK_BITS]))
            counts |= counted
            parts += part
    return Found(tuple(rules), counts, tuple(parts))


def uses_order_keys(rules: Sequence[Rule]) -> list[Rule]:
    """Rules answered by the order keys; duplicate order keys only where others need these anyway."""
    own = [r for r in rules if isinstance(r.check, KEY_CHECKS)]
    return own + [r for r in rules if own and is_order_key_duplicate(r)]


def is_order_key_duplicate(rule: Rule) -> bool:
    return (
        isinstance(rule.check, R.DuplicateCheck)
        and rule.check.column == "order_id"
        and rule.table_name in (S.ORDERS, S.ORDER_EVENTS)
    )


def key_facts(tables: Tables) -> DataFrame:
    """Per order key, missing keys equal: rows, completed orders and payments on either side, and how times lie."""
    orders, events = tables[S.ORDERS], tables[S.ORDER_EVENTS]
    of_orders = (
        with_nullable_key(
            orders.select("order_id", "order_status", X.lenient_wall_time(orders, "order_created_at").alias("moment")), "order_id"
        )
        .groupBy(*NULLABLE_KEY)
        .agg(
            F.count("*").alias("n_orders"),
            F.count_if(F.col("order_status") == S.COMPLETED).alias("n_completed"),
            F.max("moment").alias("latest"),
        )
    )
    of_events = (
        with_nullable_key(
            events.select("order_id", "event_type", X.lenient_wall_time(events, "event_timestamp").alias("moment")), "order_id"
        )
        .groupBy(*NULLABLE_KEY)
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(F.col("event_type") == S.PAYMENT_CONFIRMED).alias("n_payments"),
            F.min("moment").alias("earliest"),
        )
    )
    both = of_orders.join(of_events, NULLABLE_KEY, "full_outer")
    numbers = ("n_orders", "n_completed", "n_events", "n_payments")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def _key_breaks(rule: Rule) -> Column:
    """Whether an order key breaks a rule; NULL counts as not."""
    missing, orders, events = F.col("key_missing"), F.col("n_orders"), F.col("n_events")
    check = rule.check
    if isinstance(check, R.OrdersWithoutEvents):
        return (orders > 0) & (missing | (events == 0))
    if isinstance(check, R.EventsWithoutOrders):
        return (events > 0) & (missing | (orders == 0))
    if isinstance(check, R.CompletedWithoutPayment):
        return (F.col("n_completed") > 0) & (F.col("n_payments") == 0)
    if isinstance(check, R.EventBeforeOrder):
        return F.coalesce(F.col("earliest") < F.col("latest"), F.lit(False))
    return (orders if rule.table_name == S.ORDERS else events) > 1


class _Run:
    """One evaluation: tables, and what was stored per key so far."""

    def __init__(self, tables: Tables, rules: tuple[Rule, ...], hot_rows: int) -> None:
        self.tables, self.hot_rows = tables, hot_rows
        self.spark: SparkSession = next(iter(tables.values())).sparkSession
        self.folder = shared_folder(self.spark, "quality")
        self.steps: list[DataFrame] = []
        self.by_key = uses_order_keys(rules)
        if self.by_key:
            self._order_keys()
        if any(isinstance(r.check, R.EventBeforeOrder) for r in self.by_key):
            self._order_times()

    def _write(self, df: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
        """The rows of ``df`` marked ``kept`` stored, and measures taken of all rows on the way."""
        seen = Observation()
        kept = df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in measures.items()])
        stored = self._stored(kept.where("kept").drop("kept"))
        return stored, dict(seen.get)

    def _stored(self, df: DataFrame) -> DataFrame:
        self.steps.append(df)
        path = f"{self.folder}/{len(self.steps)}"
        write_files(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _hot(self, counted: DataFrame, rows: Column, total: int) -> DataFrame | None:
        """Keys, as stand-in columns, that hold too many rows for one task; fewer than HOT_SHARE."""
        limit = max(self.hot_rows, total // HOT_SHARE)
        found = counted.where(rows > limit).select(*NULLABLE_KEY).collect()
        return self.spark.createDataFrame(found, counted.select(*NULLABLE_KEY).schema) if found else None

    def _order_keys(self) -> None:
        mask = bits({i: _key_breaks(r) for i, r in enumerate(self.by_key)})
        facts = key_facts(self.tables).select(*NULLABLE_KEY, "n_orders", "n_events", mask.alias(BROKEN))
        rows = F.col("n_orders") + F.col("n_events")
        chosen = facts.withColumn("kept", (F.col(BROKEN) != 0) | (rows > self.hot_rows))
        self.keys, seen = self._write(chosen, {"n": F.sum(rows)})
        self.hot_keys = self._hot(self.keys, rows, seen["n"])

    def _order_times(self) -> None:
        rule = next(r for r in self.by_key if isinstance(r.check, R.EventBeforeOrder))
        keys = self.keys.where(has_bit(F.col(BROKEN), self.by_key.index(rule))).select(*NULLABLE_KEY)
        orders = self.tables[S.ORDERS]
        created = with_nullable_key(
            orders.select("order_id", X.lenient_wall_time(orders, "order_created_at").alias("moment")), "order_id"
        ).where(F.col("moment").isNotNull())
        ordinary, hot = (keys, None) if self.hot_keys is None else split_hot(keys, NULLABLE_KEY, self.hot_keys)
        mine = lookup_join(created, ordinary, NULLABLE_KEY, "left_semi", self.hot_keys)
        self.times = self._stored(order_moments(mine))
        self.ranks = None
        if hot is not None and not hot.isEmpty():
            events = self.tables[S.ORDER_EVENTS]
            dated = with_nullable_key(
                events.select("order_id", X.lenient_wall_time(events, "event_timestamp").alias("moment")), "order_id"
            ).where(F.col("moment").isNotNull())
            few = F.broadcast(hot)  # some of the hot keys
            ranks = orders_after(*[df.join(few, NULLABLE_KEY, "left_semi") for df in (created, dated)])
            ranks = ranks.where(F.col("later_orders") > 0).select(*POINT, F.col("later_orders").alias("rank"))
            self.ranks = self._stored(ranks)

    def _repeated(self, table: str, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
        """Values of a column with several rows, and the hot ones among them."""
        keyed = with_nullable_key(self.tables[table].select(rule.check.column), rule.check.column)
        counts = keyed.groupBy(*NULLABLE_KEY).agg(F.count("*").alias("rows")).withColumn("kept", F.col("rows") > 1)
        repeated, seen = self._write(counts, {"n": F.sum("rows")})
        return repeated, self._hot(repeated, F.col("rows"), seen["n"])

    def table_pass(self, table: str, rules: tuple[Rule, ...]) -> tuple[list[Part], dict[str, tuple[int, int]]]:
        """Read a table once for its rules: the stored violating rows and the rules' counts."""
        df = self.tables[table]
        known = (R.RowCheck, R.DuplicateCheck, *KEY_CHECKS)
        others = [r for r in rules if not isinstance(r.check, known)]
        by_key = [r for r in rules if r in self.by_key]
        repeats = [r for r in rules if isinstance(r.check, R.DuplicateCheck) and r not in by_key]
        before = [r for r in by_key if isinstance(r.check, R.EventBeforeOrder)]
        populations = list(dict.fromkeys(r.check.population for r in rules))
        of_rows = {i: r.check.predicate(df) for i, r in enumerate(rules) if isinstance(r.check, R.RowCheck)}

        shown = [c for r in rules if r not in others for c in (*r.sample_columns, *r.keys_in(df))]
        shown += [r.check.column for r in repeats] + ["order_id"] * bool(by_key)
        columns = dict.fromkeys(shown)
        rows = df.select(
            *[F.col(f"`{c}`") for c in columns],
            bits(of_rows).alias(BROKEN),
            *[F.expr(p).alias(f"population_{i}") for i, p in enumerate(populations)],
            *([X.lenient_wall_time(df, "event_timestamp").alias("moment")] if before else []),
        )
        broken = [F.col(BROKEN)]
        if by_key:
            rows, mask = self._with_key_bits(rows, rules, by_key, populations)
            broken.append(mask)
        for i, rule in enumerate(rules):
            if rule in repeats:
                repeated, hot = self._repeated(table, rule)
                keyed = with_nullable_key(rows, rule.check.column)
                flags = repeated.select(*NULLABLE_KEY, F.lit(1 << i).cast("bigint").alias(f"repeated_{i}"))
                rows = lookup_join(keyed, flags, NULLABLE_KEY, "left", hot).drop(*NULLABLE_KEY)
                broken.append(F.coalesce(F.col(f"repeated_{i}"), F.lit(0)))
        pairs = self._pairs() if before else F.lit(0).cast("bigint")
        rows = rows.withColumn(PAIRS, F.coalesce(pairs, F.lit(0))) if before else rows.withColumn(PAIRS, pairs)
        late = {rules.index(r): F.col(PAIRS) > 0 for r in before}
        rows = rows.withColumn(BROKEN, reduce(lambda a, b: a.bitwiseOR(b), [*broken, bits(late)]))
        rows = rows.withColumn("kept", F.col(BROKEN) != 0)

        measures = {f"total_{i}": F.count_if(F.col(f"population_{i}")) for i in range(len(populations))}
        for i, rule in enumerate(rules):
            one = F.count_if(has_bit(F.col(BROKEN), i))
            measures[f"failed_{i}"] = F.sum(PAIRS) if rule in before else one
        narrow = rows.select(*columns, BROKEN, PAIRS, "kept", *[f"population_{i}" for i in range(len(populations))])
        stored, seen = self._write(narrow, measures)
        parts = [Part(rules, stored)]
        for rule in others:
            part, failed = self._other(table, rule)
            parts.append(part)
            seen[f"failed_{rules.index(rule)}"] = failed
        totals = {r: seen[f"total_{populations.index(r.check.population)}"] for r in rules}
        return parts, {r.rule_id: (seen[f"failed_{i}"], totals[r]) for i, r in enumerate(rules)}

    def _with_key_bits(self, rows, rules, by_key, populations) -> tuple[DataFrame, Column]:
        """Rows with what is stored for their order key, and the mask that follows."""
        flags = {}
        for rule in by_key:
            if isinstance(rule.check, R.EventBeforeOrder):
                continue
            flag = F.coalesce(has_bit(F.col("key_bits"), self.by_key.index(rule)), F.lit(False))
            # Of a key without payment only the completed orders violate.
            among = F.coalesce(F.col(f"population_{populations.index(rule.check.population)}"), F.lit(False))
            flags[rules.index(rule)] = flag & among
        rows = with_nullable_key(rows, "order_id")
        keys = self.keys.where(F.col(BROKEN) != 0).select(*NULLABLE_KEY, F.col(BROKEN).alias("key_bits"))
        rows = lookup_join(rows, keys, NULLABLE_KEY, "left", self.hot_keys)
        if any(isinstance(r.check, R.EventBeforeOrder) for r in by_key):
            rows = lookup_join(rows, self.times, NULLABLE_KEY, "left", self.hot_keys)
            if self.ranks is not None:
                rows = rows.join(self.ranks, POINT, "left")
        return rows.drop(*NULLABLE_KEY), bits(flags)

    def _pairs(self) -> Column:
        earlier = F.col("moment") < F.col("latest")
        found = F.when(earlier, later_than(F.col("moments"), F.col("moment")))
        return found if self.ranks is None else F.coalesce(found, F.col("rank"))

    def _other(self, table: str, rule: Rule) -> tuple[Part, int]:
        """A check of another kind lists its violating rows itself."""
        df = rule.check.violations(self.tables, table)
        columns = dict.fromkeys((*rule.sample_columns, *rule.keys_in(df)))
        one = F.lit(1).cast("bigint")
        rows = df.select(*[F.col(f"`{c}`") for c in columns], one.alias(BROKEN), one.alias(PAIRS), F.lit(True).alias("kept"))
        stored, seen = self._write(rows, {"failed": F.count("*")})
        return Part((rule,), stored), seen["failed"]


def violating(found: Found, columns: Callable[[Rule, DataFrame], dict[str, str]], repeated: int = 1) -> list[DataFrame]:
    """Per stored part, one row per row and rule it breaks, with rule_id and ``columns(rule, df)``.

    Rows of a rule that counts pairs come up to ``repeated`` times, once per pair.
    """
    out = []
    for part in found.parts:
        mine = [r for r in part.rules if not _listed_elsewhere(found, part, r)]
        each = []
        for rule in mine:
            fields = ", ".join(f"{c} AS `{n}`" for n, c in columns(rule, part.rows).items())
            row = F.expr(f"struct({sql_text(rule.rule_id)} AS rule_id, {fields})")
            times = F.least(F.col(PAIRS), F.lit(repeated)).cast("int") if isinstance(rule.check, R.EventBeforeOrder) else F.lit(1)
            each.append(F.when(part.breaks(rule), F.array_repeat(row, times)).otherwise(F.array()))
        if each:
            out.append(part.rows.select(F.inline(F.concat(*each))))
    return out


def _listed_elsewhere(found: Found, part: Part, rule: Rule) -> bool:
    """Whether a part of its own lists the rule's rows."""
    return len(part.rules) > 1 and any(p.rules == (rule,) for p in found.parts if p is not part)


def sql_text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
