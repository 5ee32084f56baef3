"""Every model, insight, rule and report as a named query over a folder of test tables.

The raw tables are derived from the folder's whole ``orders`` table; see
``ledgerlane.sources.lifecycle``. Names without a suffix use the messy profile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.operators.firsts import in_order, preview
from ledgerlane.operators.lookup import measured
from ledgerlane.plans import insights as I
from ledgerlane.plans import models as M
from ledgerlane.plans import runs
from ledgerlane.quality import report as Q
from ledgerlane.quality.bindings import standard_rules
from ledgerlane.quality.gate import gate_decisions
from ledgerlane.session import shared_folder
from ledgerlane.sources import lifecycle as L
from ledgerlane.sources.readers import read_csv, read_csv_checked, read_raw, typed_timestamps
from ledgerlane.sources.sinks import RunContext, Warehouse, stamp, write_csv, write_files
from ledgerlane.sources.timeforms import declare_times, infer_times

Query = Callable[[SparkSession, str], DataFrame]

# Rows a key may have before the queries named *_hot_keys treat it as hot.
LOW_HOT_ROWS = 3


def raw(spark: SparkSession, sf_dir: str, profile: str) -> dict[str, DataFrame]:
    """The derived tables; orders are dealt out first, as their file may be one partition."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return L.raw_tables(orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey"), profile)


def with_hot_keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The messy tables, measured with a limit that makes many keys hot."""
    return measured(raw(spark, sf_dir, L.MESSY), S.KEY_COLUMNS, LOW_HOT_ROWS)


def landed(spark: SparkSession, sf_dir: str, profile: str) -> dict[str, DataFrame]:
    """The raw tables written once and read back, for queries that scan them many times."""
    folder = shared_folder(spark, "raw")
    for name, df in raw(spark, sf_dir, profile).items():
        write_files(df, f"{folder}/{name}")
    return read_raw(spark, f"{folder}/{S.ORDERS}", f"{folder}/{S.ORDER_EVENTS}", "parquet")


def rounded(query: Query, *finer: str) -> Query:
    """Round unrounded sums and means, whose last bits depend on the order of addition.

    Money goes to cents, the columns named in ``finer`` to four digits.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        doubles = [name for name, kind in df.dtypes if kind == "double"]
        return df.withColumns({c: F.round(c, 4 if c in finer else 2) for c in doubles})

    return run


def _raw(table: str, profile: str) -> Query:
    return lambda spark, sf_dir: raw(spark, sf_dir, profile)[table]


def _model(name: str, profile: str = L.MESSY) -> Query:
    return lambda spark, sf_dir: M.build_models(raw(spark, sf_dir, profile))[name]


def _insight(insight: I.Insight, profile: str = L.MESSY) -> Query:
    source = _model(insight.table, profile)
    return lambda spark, sf_dir: insight.query(source(spark, sf_dir))


def _rule(rule_id: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = next(r for r in standard_rules() if r.rule_id == rule_id)
        return rule.violations(raw(spark, sf_dir, L.MESSY))

    return run


def _hot_rule(rule_id: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = next(r for r in standard_rules() if r.rule_id == rule_id)
        return rule.violations(with_hot_keys(spark, sf_dir))

    return run


def _hot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.build_models(with_hot_keys(spark, sf_dir))["fct_orders"]


def _report(profile: str) -> Query:
    return lambda spark, sf_dir: Q.quality_report(landed(spark, sf_dir, profile))


def _failed_samples(profile: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = landed(spark, sf_dir, profile)
        rules = standard_rules()
        return Q.run_quality_checks(tables, rules)[1] if profile == L.CLEAN else Q.failed_samples(tables, rules)

    return run


def _sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rule_sample_keys(landed(spark, sf_dir, L.MESSY), standard_rules())


def _failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count_failures(landed(spark, sf_dir, L.MESSY), standard_rules())


def _gate(profile: str) -> Query:
    """The gate needs the failure counts only, no sample keys."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = standard_rules()
        counts = Q.count_failures(landed(spark, sf_dir, profile), rules)
        severity = F.create_map(
            *[F.lit(x) for r in rules for x in (r.rule_id, r.severity)]
        )
        return gate_decisions(
            counts.withColumn("severity", severity[F.col("rule_id")])
        )

    return run


def _csv_roundtrip(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark, "csv")
        for name, df in raw(spark, sf_dir, L.MESSY).items():
            write_csv(df, f"{folder}/{name}")
        tables = read_raw(spark, f"{folder}/{S.ORDERS}", f"{folder}/{S.ORDER_EVENTS}")
        return tables[table]

    return run


def _second_write(overwrite: bool) -> Query:
    """Clean orders are written, then messy ones to the same place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_folder(spark, "orders")
        write_files(raw(spark, sf_dir, L.CLEAN)[S.ORDERS], path)
        write_files(raw(spark, sf_dir, L.MESSY)[S.ORDERS], path, overwrite)
        return spark.read.parquet(path)

    return run


def _catalog_write(how: str) -> Query:
    """Clean orders, then messy ones, to one catalog table: replaced, kept or appended to."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        warehouse = Warehouse(spark)
        table = f"orders_{uuid.uuid4().hex}"
        warehouse.write(table, raw(spark, sf_dir, L.CLEAN)[S.ORDERS])
        messy = raw(spark, sf_dir, L.MESSY)[S.ORDERS]
        if how == "append":
            warehouse.append(table, messy)
        else:
            warehouse.write(table, messy, overwrite=how == "replace")
        return warehouse.table(table)

    return run


def _readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two tables a step would find: one written from the orders, one never written."""
    warehouse = Warehouse(spark)
    there = f"probe_{uuid.uuid4().hex}"
    warehouse.write(there, raw(spark, sf_dir, L.MESSY)[S.ORDERS].select("order_id"))
    rows = [("written", warehouse.exists(there)), ("absent", warehouse.exists(f"{there}_not"))]
    found = spark.createDataFrame(rows, "name string, ready boolean")
    counted = warehouse.table(there).agg(F.count("*").alias("n_rows"))
    return found.join(counted.withColumn("name", F.lit("written")), "name", "left")


def _analysis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every insight of a run in which one more fails."""
    database = f"run_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    warehouse = Warehouse(spark, database)
    for name, df in raw(spark, sf_dir, L.MESSY).items():
        moment = "order_created_at" if name == S.ORDERS else "event_timestamp"
        warehouse.write(f"raw_{name}", typed_timestamps(df, moment))
    runs.transform(warehouse)
    broken = I.Insight("insight_10_broken", "Fails", "fct_orders", lambda df: df.select("no_such_column"))
    status = runs.analyse(warehouse, RunContext(L.MESSY, 0, 42, S.DEV), (*I.INSIGHTS, broken))
    # The status rows are values already; what the run wrote is not needed any more.
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return status.select("insight", "status", F.col("error").isNotNull().alias("has_error"))


def _day_first(df: DataFrame, column: str) -> DataFrame:
    """Timestamp texts written with the day first; texts that are none stay."""
    moment = F.col(column).try_cast("timestamp_ntz")
    return df.withColumn(column, F.coalesce(F.date_format(moment, "d/M/yyyy H:mm:ss"), F.col(column)))


def _month_first_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times written with the month first, their form found by counting."""
    orders = raw(spark, sf_dir, L.MESSY)[S.ORDERS]
    moment = F.col("order_created_at").try_cast("timestamp_ntz")
    text = F.coalesce(F.date_format(moment, "MM/dd/yyyy HH:mm:ss"), F.col("order_created_at"))
    found = infer_times(orders.select("order_id", text.alias("order_created_at")), "order_created_at")
    return found.select("order_id", X.lenient_wall_time(found, "order_created_at").alias("moment"))


def _counts_day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure counts of tables with day-first times: one form found, one declared."""
    tables = raw(spark, sf_dir, L.MESSY)
    orders = _day_first(tables[S.ORDERS], "order_created_at")
    events = _day_first(tables[S.ORDER_EVENTS], "event_timestamp")
    tables = {
        S.ORDERS: infer_times(orders, "order_created_at"),
        S.ORDER_EVENTS: declare_times(events, {"event_timestamp": "day_first"}),
    }
    return Q.count_failures(tables, standard_rules())


def _lines(df: DataFrame, folder: str, columns: list[str], line: Column) -> str:
    """Rows written as the text lines of a CSV file with a header, as another program might."""
    plain = df.select(line.alias(",".join(columns))).write.option("header", True).option("sep", "\x01").option("quote", "")
    plain.csv(folder)
    return folder


def _cells(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def _csv_short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of order ids that end in 7 lack their last two cells and are padded."""
    orders, columns = raw(spark, sf_dir, L.MESSY)[S.ORDERS], S.RAW_ORDERS.fieldNames()
    cells = _cells(columns)
    short = F.coalesce(F.col("order_id").endswith("7"), F.lit(False))
    line = F.when(short, F.concat_ws(",", *cells[:-2])).otherwise(F.concat_ws(",", *cells))
    path = _lines(orders, shared_folder(spark, "csv"), columns, line)
    return read_csv_checked(spark, path, S.RAW_ORDERS, pad_short=True).rows


def _csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside, by reason: surplus cells, lacking cells, amounts that are no numbers."""
    orders, columns = raw(spark, sf_dir, L.MESSY)[S.ORDERS], S.RAW_ORDERS.fieldNames()
    cells = _cells(columns)
    ends = F.substring("order_id", -1, 1)
    wordy = [F.lit("much") if c == "order_amount" else cell for c, cell in zip(columns, cells, strict=True)]
    line = (
        F.when(ends == "3", F.concat_ws(",", *cells, F.lit("")))
        .when(ends == "5", F.concat_ws(",", *cells[:-1]))
        .when(ends == "9", F.concat_ws(",", *wordy))
        .otherwise(F.concat_ws(",", *cells))
    )
    path = _lines(orders, shared_folder(spark, "csv"), columns, line)
    found = read_csv_checked(spark, path, S.RAW_ORDERS)
    aside = shared_folder(spark, "quarantine")
    write_files(found.rejected, aside)
    reasons = spark.read.parquet(aside).groupBy("reason").agg(F.count("*").alias("n_rows"))
    return reasons.unionByName(found.rows.agg(F.lit("fits").alias("reason"), F.count("*").alias("n_rows")))


def _csv_two_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two folders whose files have their columns in different orders."""
    orders, columns = raw(spark, sf_dir, L.MESSY)[S.ORDERS], S.RAW_ORDERS.fieldNames()
    even = F.coalesce(F.substring("order_id", -1, 1).isin(*"02468"), F.lit(True))
    paths = []
    for rows, layout in ((orders.where(even), columns), (orders.where(~even), columns[::-1])):
        paths.append(_lines(rows, shared_folder(spark, "csv"), layout, F.concat_ws(",", *_cells(layout))))
    return read_csv(spark, paths, S.RAW_ORDERS)


def _csv_missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of order ids that end in 1 replaced by the texts that stand for a missing value, in turn."""
    orders, columns = raw(spark, sf_dir, L.MESSY)[S.ORDERS], S.RAW_ORDERS.fieldNames()
    tokens = F.array(*[F.lit(t) for t in S.MISSING_TOKENS])
    turn = F.pmod(F.xxhash64("order_id"), F.lit(len(S.MISSING_TOKENS))).cast("int")
    chosen = F.coalesce(F.col("order_id").endswith("1"), F.lit(False))
    marked = orders.withColumn("customer_id", F.when(chosen, F.get(tokens, turn)).otherwise(F.col("customer_id")))
    path = _lines(marked, shared_folder(spark, "csv"), columns, F.concat_ws(",", *_cells(columns)))
    return read_csv(spark, path, S.RAW_ORDERS)


def _fresh_database(spark: SparkSession) -> Warehouse:
    database = f"run_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    return Warehouse(spark, database)


def _bucketed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts over raw tables stored in buckets, with a limit that makes many keys hot."""
    warehouse = _fresh_database(spark)
    runs.store_keyed(warehouse, raw(spark, sf_dir, L.MESSY), 8, LOW_HOT_ROWS)
    return runs.keyed_facts(warehouse)


def _rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run written twice and another once: each is there once."""
    warehouse = _fresh_database(spark)
    facts = _model("fct_orders")(spark, sf_dir)
    for run_id in ("run-1", "run-2", "run-1"):
        context = RunContext(L.MESSY, 0, 42, S.DEV, run_id=run_id)
        warehouse.write_parts("status_kpis", stamp(I.status_kpis(facts), context), "run_id")
    return warehouse.table("status_kpis").drop("generated_at")


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of clean tables stored by month, of which the months of 1995 are rebuilt from messy ones."""
    warehouse = _fresh_database(spark)
    runs.refresh_facts(warehouse, raw(spark, sf_dir, L.CLEAN), unit="month")
    months = [f"1995-{m:02d}-01" for m in range(1, 13)]
    runs.refresh_facts(warehouse, raw(spark, sf_dir, L.MESSY), months, unit="month")
    return warehouse.table("fct_orders_by_period").drop(M.PERIOD)


def _one_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts of some days, read from their months alone."""
    warehouse = _fresh_database(spark)
    runs.refresh_facts(warehouse, raw(spark, sf_dir, L.MESSY), unit="month")
    stored = warehouse.table("fct_orders_by_period")
    return M.in_periods(stored, "1996-02-10", "1996-03-05", "month").drop(M.PERIOD)


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"orders_view_{uuid.uuid4().hex}"
    raw(spark, sf_dir, L.MESSY)[S.ORDERS].createOrReplaceTempView(name)
    return spark.table(name)


def _iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times in each accepted text form, read back as one wall time."""
    orders = raw(spark, sf_dir, L.CLEAN)[S.ORDERS]
    text = F.col("order_created_at")
    forms = {
        "iso": F.replace(text, F.lit(" "), F.lit("T")),
        "iso_zulu": F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")),
        "offset": F.concat(text, F.lit("+0130")),
        "minutes": F.substring(text, 1, 16),
        "day": F.substring(text, 1, 10),
        "nanoseconds": F.concat(text, F.lit(".123456789")),
    }
    rows = orders.select(
        "order_id", F.inline(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items()]))
    )
    return rows.select("order_id", "form", X.lenient_wall_time(rows, "text").alias("moment"))


def _first_ten_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _model("fct_orders")(spark, sf_dir)
    rows, _ = preview(facts.orderBy(*in_order(["order_id", "customer_id"])))
    return rows


def _stamped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = RunContext(L.MESSY, 0, 42, S.DEV, run_id="run-1")
    metrics = I.revenue_metrics(_model("fct_orders")(spark, sf_dir))
    return stamp(metrics, context).drop("generated_at")


def _insight_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = M.build_models(raw(spark, sf_dir, L.MESSY))
    counts = [
        i.query(models[i.table]).agg(
            F.lit(i.name).alias("insight"), F.count("*").alias("n_rows")
        )
        for i in I.INSIGHTS
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def all_queries() -> dict[str, Query]:
    validations = {i.name: i for i in I.VALIDATIONS}
    queries: dict[str, Query] = {
        "raw_orders": _raw(S.ORDERS, L.MESSY),
        "raw_order_events": _raw(S.ORDER_EVENTS, L.MESSY),
        "raw_orders_clean": _raw(S.ORDERS, L.CLEAN),
        "raw_order_events_clean": _raw(S.ORDER_EVENTS, L.CLEAN),
        "stg_orders": _model("stg_orders"),
        "stg_order_events": _model("stg_order_events"),
        "int_order_event_summary": _model("int_order_event_summary"),
        "fct_orders": _model("fct_orders"),
        "fct_orders_clean": _model("fct_orders", L.CLEAN),
        "fct_daily_revenue": rounded(_model("fct_daily_revenue")),
    }
    for insight in I.INSIGHTS:
        queries[insight.name] = _insight(insight)
    queries["insight_01_revenue_gap_clean"] = _insight(I.INSIGHTS[0], L.CLEAN)
    queries["insight_row_counts"] = _insight_row_counts
    for name in ("daily_revenue_bounds", "event_coverage", "completed_missing_events"):
        queries[name] = _insight(validations[name])
    for name, finer in (
        ("revenue_metrics", "revenue_gap_pct"),
        ("revenue_definitions", "gap_pct"),
        ("daily_revenue_ma7", "revenue_ma7"),
    ):
        queries[name] = rounded(_insight(validations[name]), finer)
    queries["daily_revenue_bounds"] = rounded(queries["daily_revenue_bounds"])
    queries["revenue_metrics_stamped"] = rounded(_stamped_metrics, "revenue_gap_pct")
    for rule_id in [f"R{i:03d}" for i in range(1, 14)]:
        queries[f"dq_{rule_id.lower()}"] = _rule(rule_id)
    queries |= {
        "dq_failure_counts": _failure_counts,
        "dq_sample_keys": _sample_keys,
        "dq_report": _report(L.MESSY),
        "dq_report_clean": _report(L.CLEAN),
        "dq_failed_samples": _failed_samples(L.MESSY),
        "dq_failed_samples_clean": _failed_samples(L.CLEAN),
        "fct_orders_hot_keys": _hot_facts,
        "dq_r001_hot_keys": _hot_rule("R001"),
        "dq_r009_hot_keys": _hot_rule("R009"),
        "dq_r013_hot_keys": _hot_rule("R013"),
        "table_appended": _catalog_write("append"),
        "catalog_replaced": _catalog_write("replace"),
        "catalog_kept": _catalog_write("keep"),
        "readiness_probe": _readiness,
        "analysis_status": _analysis_status,
        "raw_orders_view": _view,
        "raw_orders_iso_times": _iso_times,
        "dq_gate": _gate(L.MESSY),
        "dq_gate_clean": _gate(L.CLEAN),
        "csv_roundtrip_orders": _csv_roundtrip(S.ORDERS),
        "csv_roundtrip_order_events": _csv_roundtrip(S.ORDER_EVENTS),
        "csv_short_rows": _csv_short_rows,
        "csv_quarantine": _csv_quarantine,
        "csv_two_layouts": _csv_two_layouts,
        "csv_missing_tokens": _csv_missing_tokens,
        "raw_orders_month_first_times": _month_first_times,
        "dq_failure_counts_day_first": _counts_day_first,
        "fct_orders_bucketed": _bucketed_facts,
        "insight_03_rerun": _rerun,
        "fct_orders_refreshed": _refreshed,
        "fct_orders_one_month": _one_month,
        "table_replaced": _second_write(overwrite=True),
        "table_kept": _second_write(overwrite=False),
        "fct_orders_preview": _first_ten_orders,
    }
    return queries
