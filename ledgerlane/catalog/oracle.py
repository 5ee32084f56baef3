"""The same queries as DuckDB SQL text, written apart from the Spark code.

Every text starts from the ``orders`` view and shares no expression with the package.
"""

from __future__ import annotations


def _case(default: str, *faults: tuple[str, str], messy: bool) -> str:
    """A CASE whose fault branches exist in the messy profile only."""
    if not messy or not faults:
        return default
    branches = " ".join(f"WHEN {when} THEN {then}" for when, then in faults)
    return f"CASE {branches} ELSE {default} END"


def _text(timestamp: str) -> str:
    return f"strftime({timestamp}, '%Y-%m-%d %H:%M:%S')"


def _tables(messy: bool) -> str:
    """CTEs from base rows to the five models."""

    def case(default: str, *faults: tuple[str, str]) -> str:
        return _case(default, *faults, messy=messy)

    status = (
        "CASE WHEN k % 25 IN (0, 1) THEN 'cancelled'"
        " WHEN k % 100 IN (8, 9, 10) THEN 'refunded' ELSE 'completed' END"
    )
    key = "'O' || CAST(100000 + k AS VARCHAR)"
    copies = "UNION ALL SELECT * FROM order_rows WHERE k % 300 = 44" if messy else ""
    kept = "AND k % 400 <> 42" if messy else ""
    steps = [
        (
            1,
            "true",
            case("'order_created'", ("k % 350 = 20", "NULL"), ("k % 350 = 30", "'order_opened'")),
            case(_text("created + INTERVAL 5 SECOND"), ("k % 350 = 65", "NULL")),
            key,
            "CASE WHEN k % 2 = 0 THEN 'web' ELSE 'mobile' END",
        ),
        (
            2,
            "status IN ('completed', 'refunded')"
            + (" AND (100000 + k) % 37 <> 0" if messy else ""),
            "'payment_confirmed'",
            case(
                _text("created + INTERVAL 3 MINUTE"),
                ("k % 350 = 55", "'not-a-date'"),
                ("k % 350 = 40", _text("created - INTERVAL 1 HOUR")),
            ),
            case(key, ("k % 450 = 53", "NULL")),
            "'backend'",
        ),
        (
            3,
            "status = 'completed'",
            "'order_shipped'",
            case(
                _text("created + to_seconds((239 + k % 3) * 60 + (k % 7) * 10)"),
                ("k % 350 = 45", _text("created + INTERVAL 1 MINUTE")),
            ),
            case(key, ("k % 450 = 52", "NULL")),
            "'backend'",
        ),
        (
            4,
            "status = 'cancelled'",
            "'order_cancelled'",
            _text("created + INTERVAL 10 MINUTE"),
            key,
            "'backend'",
        ),
    ]
    if messy:
        steps.append(
            (
                5,
                "status = 'cancelled' AND (100000 + k) % 53 = 0",
                "'order_shipped'",
                _text("created + INTERVAL 6 HOUR"),
                key,
                "'backend'",
            )
        )
    events = [
        f"""SELECT 'E' || CAST({case(f"10 * k + {j}", ("k % 250 = 60", "10 * k + 1"))
                               if j == 2 else f"10 * k + {j}"} AS VARCHAR) AS event_id,
            {order} AS order_id, {kind} AS event_type, {at} AS event_timestamp,
            {source} AS source_system
            FROM base WHERE ({exists}) {kept}"""
        for j, exists, kind, at, order, source in steps
    ]
    if messy:
        events.append(
            f"""SELECT 'E' || CAST(10 * k + 6 AS VARCHAR), 'X' || CAST(k AS VARCHAR),
            'order_created', {_text("created")}, 'web' FROM base WHERE k % 600 = 13"""
        )
    return f"""WITH base AS (
        SELECT o_orderkey AS k, o_custkey, o_totalprice,
            o_orderdate + to_seconds((o_orderkey * 7 % 1440) * 60 + o_orderkey % 60)
                AS created,
            {case(status.replace("k %", "o_orderkey %"),
                  ("o_orderkey % 250 = 99", "'unknown'"),
                  ("o_orderkey % 250 = 199", "NULL"))} AS status
        FROM orders
    ), order_rows AS (
        SELECT k,
            {case(key, ("k % 700 = 62", "NULL"))} AS order_id,
            {case("'C' || CAST(10000 + o_custkey AS VARCHAR)", ("k % 200 = 7", "NULL"))}
                AS customer_id,
            {case(_text("created"), ("k % 500 = 123", "'not-a-date'"),
                  ("k % 500 = 321", "NULL"))} AS order_created_at,
            {case("o_totalprice", ("k % 100 = 33", "-10.0"), ("k % 400 = 77", "NULL"))}
                AS order_amount,
            'EUR' AS currency,
            status AS order_status
        FROM base
    ), raw_orders AS (
        SELECT * EXCLUDE (k) FROM (SELECT * FROM order_rows {copies})
    ), raw_order_events AS (
        {" UNION ALL ".join(events)}
    ), stg_orders AS (
        SELECT * REPLACE (TRY_CAST(order_created_at AS TIMESTAMP) AS order_created_at)
        FROM raw_orders
    ), stg_order_events AS (
        SELECT * REPLACE (TRY_CAST(event_timestamp AS TIMESTAMP) AS event_timestamp)
        FROM raw_order_events
    ), int_order_event_summary AS (
        SELECT order_id,
            min(event_timestamp) FILTER (event_type = 'order_created') AS created_event_ts,
            min(event_timestamp) FILTER (event_type = 'payment_confirmed')
                AS payment_event_ts,
            min(event_timestamp) FILTER (event_type = 'order_shipped') AS shipped_event_ts,
            min(event_timestamp) FILTER (event_type = 'order_cancelled')
                AS cancelled_event_ts,
            count(*) AS event_count,
            count(*) FILTER (event_type = 'payment_confirmed') AS payment_event_count,
            count(*) FILTER (event_type = 'order_shipped') AS shipped_event_count
        FROM stg_order_events GROUP BY order_id
    ), fct_orders AS (
        SELECT o.*, created_event_ts, payment_event_ts, shipped_event_ts,
            cancelled_event_ts, event_count,
            CAST(payment_event_ts IS NOT NULL AS INTEGER) AS has_payment_event,
            CAST(shipped_event_ts IS NOT NULL AS INTEGER) AS has_shipped_event,
            CAST(coalesce(order_status = 'completed', false)
                 AND payment_event_ts IS NULL AS INTEGER)
                AS dq_completed_missing_payment_flag,
            CAST(coalesce(order_status = 'cancelled', false)
                 AND shipped_event_ts IS NOT NULL AS INTEGER)
                AS dq_cancelled_has_shipment_flag
        FROM stg_orders o
        LEFT JOIN int_order_event_summary s ON o.order_id = s.order_id
    ), fct_daily_revenue AS (
        SELECT CAST(order_created_at AS DATE) AS order_date,
            sum(CASE WHEN order_status = 'completed' THEN order_amount ELSE 0 END)
                AS revenue_completed,
            count(*) AS orders_total,
            count(*) FILTER (order_status = 'completed') AS orders_completed
        FROM fct_orders GROUP BY 1
    )"""


_DONE = "order_status = 'completed'"
_PAID = "order_status = 'completed' AND has_payment_event = 1"
_LAG = "date_diff('minute', payment_event_ts, shipped_event_ts)"


def _revenue(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN order_amount ELSE 0 END)"


def _share(column: str, name: str) -> str:
    return f"round(100.0 * count({column}) / nullif(count(*), 0), 2) AS {name}"


def _coverage(names: tuple[str, str, str, str]) -> str:
    columns = (
        "created_event_ts",
        "payment_event_ts",
        "shipped_event_ts",
        "cancelled_event_ts",
    )
    shares = ", ".join(_share(c, n) for c, n in zip(columns, names))
    return f"SELECT {shares} FROM fct_orders"


_INSIGHTS = {
    "insight_01_revenue_gap": f"""
        SELECT orders_total, orders_completed, orders_paid,
            round(c, 2) AS completed_revenue, round(p, 2) AS paid_revenue,
            round(c - p, 2) AS revenue_gap,
            round(100.0 * (c - p) / nullif(c, 0), 2) AS revenue_gap_pct
        FROM (SELECT count(*) AS orders_total,
                count(*) FILTER ({_DONE}) AS orders_completed,
                count(*) FILTER ({_PAID}) AS orders_paid,
                {_revenue(_DONE)} AS c, {_revenue(_PAID)} AS p
              FROM fct_orders)""",
    "insight_02_conflict_flags": """
        SELECT CAST(sum(dq_completed_missing_payment_flag) AS BIGINT)
                AS completed_missing_payment_orders,
            CAST(sum(dq_cancelled_has_shipment_flag) AS BIGINT)
                AS cancelled_has_shipment_orders
        FROM fct_orders""",
    "insight_03_status_kpis": f"""
        SELECT count(*) AS orders_total,
            count(*) FILTER ({_DONE}) AS orders_completed,
            count(*) FILTER (order_status = 'cancelled') AS orders_cancelled,
            count(*) FILTER (order_status = 'refunded') AS orders_refunded,
            round({_revenue(_DONE)}, 2) AS revenue_completed
        FROM fct_orders""",
    "insight_04_daily_revenue": """
        SELECT order_date, round(revenue_completed, 2) AS revenue_completed,
            orders_total, orders_completed
        FROM fct_daily_revenue ORDER BY order_date NULLS LAST""",
    "insight_05_average_order_value": f"""
        SELECT round(avg(order_amount), 2) AS avg_order_value_completed
        FROM fct_orders WHERE {_DONE}""",
    "insight_06_top_customers": f"""
        SELECT coalesce(customer_id, 'UNKNOWN') AS customer_id,
            round(sum(order_amount), 2) AS revenue_completed
        FROM fct_orders WHERE {_DONE} GROUP BY 1
        ORDER BY revenue_completed DESC NULLS LAST, customer_id LIMIT 10""",
    "insight_07_payment_to_shipment": f"""
        SELECT round(avg(m), 2) AS avg_minutes_payment_to_ship,
            min(m) AS min_minutes_payment_to_ship,
            max(m) AS max_minutes_payment_to_ship
        FROM (SELECT {_LAG} AS m FROM fct_orders
              WHERE {_PAID} AND has_shipped_event = 1) WHERE m >= 0""",
    "insight_08_event_coverage_pct": _coverage(
        (
            "pct_with_created_event",
            "pct_with_payment_event",
            "pct_with_shipped_event",
            "pct_with_cancelled_event",
        )
    ),
    "insight_09_orders_without_events": """
        SELECT count(*) AS orders_without_events FROM fct_orders
        WHERE coalesce(created_event_ts, payment_event_ts, shipped_event_ts,
                       cancelled_event_ts) IS NULL""",
}

_METRICS = f"""
    SELECT completed_orders, round(c, 2) AS completed_revenue, paid_orders,
        round(p, 2) AS paid_revenue, round(c - p, 2) AS revenue_gap,
        round(CASE WHEN c = 0 THEN 0.0 ELSE (c - p) / c * 100.0 END, 4)
            AS revenue_gap_pct,
        missing_payment_orders, cancelled_with_shipment_orders,
        completed_missing_customer_orders
    FROM (SELECT count(*) FILTER ({_DONE}) AS completed_orders,
            coalesce(sum(order_amount) FILTER ({_DONE}), 0.0) AS c,
            count(*) FILTER ({_PAID}) AS paid_orders,
            coalesce(sum(order_amount) FILTER ({_PAID}), 0.0) AS p,
            CAST(coalesce(sum(dq_completed_missing_payment_flag), 0) AS BIGINT)
                AS missing_payment_orders,
            CAST(coalesce(sum(dq_cancelled_has_shipment_flag), 0) AS BIGINT)
                AS cancelled_with_shipment_orders,
            count(*) FILTER ({_DONE} AND customer_id IS NULL)
                AS completed_missing_customer_orders
          FROM fct_orders)"""

_VALIDATIONS = {
    "revenue_metrics": _METRICS,
    "revenue_metrics_stamped": f"""
        SELECT *, 'run-1' AS run_id, 'messy' AS dq_profile, CAST(0 AS BIGINT) AS n,
            CAST(42 AS BIGINT) AS seed, 'dev' AS mode FROM ({_METRICS})""",
    "daily_revenue_ma7": """
        SELECT order_date, round(revenue_completed, 2) AS revenue_completed,
            orders_total, orders_completed,
            round(avg(revenue_completed) OVER (ORDER BY order_date NULLS LAST
                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS revenue_ma7
        FROM fct_daily_revenue""",
    "daily_revenue_bounds": """
        SELECT min(order_date) AS start_date, max(order_date) AS end_date,
            round(max(revenue_completed), 2) AS max_revenue_completed
        FROM fct_daily_revenue""",
    "event_coverage": _coverage(
        ("order_created", "payment_confirmed", "order_shipped", "order_cancelled")
    ),
    "completed_missing_events": f"""
        SELECT completed_orders, missing_payment, missing_shipped,
            round(100.0 * missing_payment / nullif(completed_orders, 0), 2)
                AS missing_payment_pct,
            round(100.0 * missing_shipped / nullif(completed_orders, 0), 2)
                AS missing_shipped_pct
        FROM (SELECT count(*) AS completed_orders,
                count(*) - count(payment_event_ts) AS missing_payment,
                count(*) - count(shipped_event_ts) AS missing_shipped
              FROM fct_orders WHERE {_DONE})""",
    "revenue_definitions": f"""
        SELECT round(c, 2) AS completed_revenue, round(p, 2) AS paid_revenue,
            round(c - p, 2) AS gap,
            round(CASE WHEN c = 0 THEN 0.0 ELSE (c - p) / c * 100.0 END, 4) AS gap_pct
        FROM (SELECT coalesce({_revenue(_DONE)}, 0.0) AS c,
                coalesce({_revenue(_PAID)}, 0.0) AS p FROM fct_orders)""",
}

# Violating rows per rule. R013 lists an event once, with its number of later orders.
_BAD = {
    "R001": """SELECT * FROM raw_order_events
        QUALIFY count(*) OVER (PARTITION BY event_id) > 1""",
    "R002": """SELECT * FROM raw_orders
        QUALIFY count(*) OVER (PARTITION BY order_id) > 1""",
    "R003": """SELECT * FROM raw_order_events WHERE event_id IS NULL OR order_id IS NULL
        OR event_type IS NULL OR event_timestamp IS NULL""",
    "R004": """SELECT * FROM raw_orders WHERE order_id IS NULL OR customer_id IS NULL
        OR order_created_at IS NULL OR order_amount IS NULL OR order_status IS NULL""",
    "R005": """SELECT * FROM raw_order_events WHERE event_type IS NULL OR event_type NOT IN
        ('order_created', 'payment_confirmed', 'order_shipped', 'order_cancelled')""",
    "R006": """SELECT * FROM raw_orders WHERE order_status IS NULL
        OR order_status NOT IN ('completed', 'cancelled', 'refunded')""",
    "R007": "SELECT * FROM raw_orders WHERE order_amount IS NULL OR order_amount < 0",
    "R008": """SELECT o.* FROM raw_orders o WHERE NOT EXISTS
        (SELECT 1 FROM raw_order_events e WHERE e.order_id = o.order_id)""",
    "R009": """SELECT e.* FROM raw_order_events e WHERE NOT EXISTS
        (SELECT 1 FROM raw_orders o WHERE o.order_id = e.order_id)""",
    "R010": """SELECT o.order_id FROM raw_orders o WHERE o.order_status = 'completed'
        AND NOT EXISTS (SELECT 1 FROM raw_order_events e
            WHERE e.event_type = 'payment_confirmed'
            AND e.order_id IS NOT DISTINCT FROM o.order_id)""",
    "R011": """SELECT * FROM raw_orders
        WHERE TRY_CAST(order_created_at AS TIMESTAMP) IS NULL""",
    "R012": """SELECT * FROM raw_order_events
        WHERE TRY_CAST(event_timestamp AS TIMESTAMP) IS NULL""",
    "R013": """SELECT * EXCLUDE (i) FROM (
            SELECT e.i, e.event_id, e.order_id, e.event_type, e.event_timestamp,
                e.source_system, count(*) AS later_orders
            FROM (SELECT *, row_number() OVER () AS i FROM raw_order_events) e
            JOIN raw_orders o ON e.order_id IS NOT DISTINCT FROM o.order_id
            WHERE TRY_CAST(e.event_timestamp AS TIMESTAMP)
                < TRY_CAST(o.order_created_at AS TIMESTAMP)
            GROUP BY ALL)""",
}

# rule_id: name, table, severity, key columns, sample columns
_RULES = {
    "R001": ("Duplicate primary key: event_id", "order_events", "critical",
             "event_id", "event_id order_id event_type event_timestamp"),
    "R002": ("Duplicate primary key: order_id", "orders", "critical",
             "order_id", "order_id customer_id order_status order_amount"),
    "R003": ("Missing required fields: event_id, order_id, event_type, event_timestamp",
             "order_events", "critical",
             "order_id", "event_id order_id event_type event_timestamp"),
    "R004": ("Missing required fields: order_id, customer_id, order_created_at,"
             " order_amount, order_status", "orders", "critical", "order_id",
             "order_id customer_id order_created_at order_amount order_status"),
    "R005": ("Invalid values in event_type", "order_events", "warning",
             "order_id", "event_id order_id event_type"),
    "R006": ("Invalid values in order_status", "orders", "warning",
             "order_id", "order_id order_status"),
    "R007": ("Order amount must be >= 0", "orders", "warning",
             "order_id", "order_id order_amount order_status"),
    "R008": ("Orders without any events", "orders", "warning",
             "order_id", "order_id order_status order_created_at"),
    "R009": ("Events without matching order", "order_events", "warning",
             "order_id event_id", "event_id order_id event_type event_timestamp"),
    "R010": ("Completed orders missing payment_confirmed event", "orders", "warning",
             "order_id", "order_id"),
    "R011": ("Unparseable timestamp in order_created_at", "orders", "critical",
             "order_id", "order_id order_created_at"),
    "R012": ("Unparseable timestamp in event_timestamp", "order_events", "critical",
             "order_id event_id", "event_id order_id event_timestamp"),
    "R013": ("Event timestamp earlier than order_created_at", "order_events", "warning",
             "order_id event_id", "event_id order_id event_type event_timestamp"),
}

_SAMPLE_TYPES = {
    "event_id": "VARCHAR",
    "order_id": "VARCHAR",
    "event_type": "VARCHAR",
    "event_timestamp": "VARCHAR",
    "customer_id": "VARCHAR",
    "order_status": "VARCHAR",
    "order_amount": "DOUBLE",
    "order_created_at": "VARCHAR",
}


def _failed(rule: str) -> str:
    counted = "coalesce(sum(later_orders), 0)" if rule == "R013" else "count(*)"
    return f"(SELECT CAST({counted} AS BIGINT) FROM ({_BAD[rule]}))"


def _total(rule: str) -> str:
    where = " WHERE order_status = 'completed'" if rule == "R010" else ""
    return f"(SELECT count(*) FROM raw_{_RULES[rule][1]}{where})"


def _keys(rule: str) -> str:
    columns = _RULES[rule][3].split()
    cells = " || ',' || ".join(f"coalesce({c}, 'nan')" for c in columns)
    order = ", ".join(f"{c} NULLS LAST" for c in columns)
    return f"""(SELECT string_agg({cells}, '; ' ORDER BY {order}) FROM
        (SELECT DISTINCT {", ".join(columns)} FROM ({_BAD[rule]})
         ORDER BY {order} LIMIT 5))"""


def _report() -> str:
    rows = [
        f"""SELECT '{rule}' AS rule_id, '{name}' AS rule_name, '{table}' AS table_name,
            '{severity}' AS severity, {_failed(rule)} AS failed_rows,
            {_total(rule)} AS total_rows, coalesce({_keys(rule)}, '') AS sample_keys"""
        for rule, (name, table, severity, _, _) in _RULES.items()
    ]
    return f"""SELECT *, CASE WHEN total_rows = 0 THEN 0.0
            ELSE CAST(failed_rows AS DOUBLE) / total_rows END AS failure_rate
        FROM ({" UNION ALL ".join(rows)})"""


def _counts() -> str:
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, {_failed(r)} AS failed_rows, {_total(r)} AS total_rows"
        for r in _RULES
    )


def _sample_keys() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, {_keys(r)} AS sample_keys" for r in _RULES
    )
    return f"SELECT * FROM ({rows}) WHERE sample_keys IS NOT NULL"


def _samples() -> str:
    order = ", ".join(f"{c} NULLS LAST" for c in _SAMPLE_TYPES)
    parts = []
    for rule, (*_, shown) in _RULES.items():
        columns = ", ".join(
            c if c in shown.split() else f"CAST(NULL AS {kind}) AS {c}"
            for c, kind in _SAMPLE_TYPES.items()
        )
        bad = f"({_BAD[rule]})"
        if rule == "R013":
            bad += " b, range(b.later_orders) r"
        parts.append(
            f"""SELECT * FROM (SELECT '{rule}' AS rule_id, {columns} FROM {bad})
                QUALIFY row_number() OVER (ORDER BY {order}) <= 50"""
        )
    return " UNION ALL ".join(f"({p})" for p in parts)


def _gate() -> str:
    critical = [r for r, rule in _RULES.items() if rule[2] == "critical"]
    any_failed = " OR ".join(f"{_failed(r)} > 0" for r in critical)
    return f"""SELECT 'dev' AS mode, false AS would_fail
        UNION ALL SELECT 'prod', {any_failed}"""


def _row_counts() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS insight, count(*) AS n_rows FROM ({sql})"
        for name, sql in _INSIGHTS.items()
    )


_ISO_TIMES = """SELECT order_id, form, moment FROM (
    SELECT order_id, CAST(order_created_at AS TIMESTAMP) AS t FROM raw_orders) o,
    LATERAL (VALUES
      ('iso', o.t), ('iso_zulu', o.t), ('offset', o.t - INTERVAL 90 MINUTE),
      ('minutes', date_trunc('minute', o.t)), ('day', CAST(CAST(o.t AS DATE) AS TIMESTAMP)),
      ('nanoseconds', o.t + to_microseconds(123456))) AS f(form, moment)"""


def _appended() -> str:
    parts = [f"SELECT * FROM ({_tables(messy)} SELECT * FROM raw_orders)" for messy in (False, True)]
    return " UNION ALL ".join(parts)


def _status() -> str:
    rows = [f"('{name}', 'ok', false)" for name in _INSIGHTS if name.startswith("insight_")]
    rows.append("('insight_10_broken', 'error', true)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS s(insight, status, has_error)"


_SHORT = """SELECT * REPLACE (
    CASE WHEN order_id LIKE '%7' THEN NULL ELSE currency END AS currency,
    CASE WHEN order_id LIKE '%7' THEN NULL ELSE order_status END AS order_status) FROM raw_orders"""

_QUARANTINE = """SELECT CASE right(order_id, 1) WHEN '3' THEN 'too many cells' WHEN '5' THEN 'too few cells'
    WHEN '9' THEN 'no number' ELSE 'fits' END AS reason, count(*) AS n_rows FROM raw_orders GROUP BY 1"""

_TOKENS = """SELECT * REPLACE (CASE WHEN order_id LIKE '%1' THEN NULL ELSE customer_id END AS customer_id)
    FROM raw_orders"""

_ONE_MONTH = """SELECT * FROM fct_orders
    WHERE order_created_at >= DATE '1996-02-10' AND order_created_at < DATE '1996-03-06'"""


def _rerun() -> str:
    return f"""SELECT k.*, run_id, 'messy' AS dq_profile, CAST(0 AS BIGINT) AS n, CAST(42 AS BIGINT) AS seed,
        'dev' AS mode FROM ({_INSIGHTS["insight_03_status_kpis"]}) k, (VALUES ('run-1'), ('run-2')) AS r(run_id)"""


def _refreshed() -> str:
    parts = []
    for messy, chosen in ((False, "IS DISTINCT FROM 1995"), (True, "= 1995")):
        parts.append(f"SELECT * FROM ({_tables(messy)} SELECT * FROM fct_orders WHERE year(order_created_at) {chosen})")
    return " UNION ALL ".join(parts)


def all_oracles() -> dict[str, str]:
    messy = {
        name: f"SELECT * FROM {name}"
        for name in (
            "raw_orders",
            "raw_order_events",
            "stg_orders",
            "stg_order_events",
            "int_order_event_summary",
            "fct_orders",
        )
    }
    messy["fct_daily_revenue"] = (
        "SELECT * REPLACE (round(revenue_completed, 2) AS revenue_completed)"
        " FROM fct_daily_revenue"
    )
    messy |= _INSIGHTS | _VALIDATIONS
    messy |= {f"dq_{rule.lower()}": sql for rule, sql in _BAD.items()}
    messy |= {
        "insight_row_counts": _row_counts(),
        "dq_failure_counts": _counts(),
        "dq_sample_keys": _sample_keys(),
        "dq_report": _report(),
        "dq_failed_samples": _samples(),
        "dq_gate": _gate(),
        "csv_roundtrip_orders": "SELECT * FROM raw_orders",
        "csv_roundtrip_order_events": "SELECT * FROM raw_order_events",
        "csv_short_rows": _SHORT,
        "csv_quarantine": _QUARANTINE,
        "csv_two_layouts": "SELECT * FROM raw_orders",
        "csv_missing_tokens": _TOKENS,
        "raw_orders_month_first_times": "SELECT order_id, TRY_CAST(order_created_at AS TIMESTAMP) AS moment FROM raw_orders",
        "dq_failure_counts_day_first": _counts(),
        "fct_orders_bucketed": "SELECT * FROM fct_orders",
        "fct_orders_one_month": _ONE_MONTH,
        "insight_03_rerun": _rerun(),
        "table_replaced": "SELECT * FROM raw_orders",
        "catalog_replaced": "SELECT * FROM raw_orders",
        "raw_orders_view": "SELECT * FROM raw_orders",
        "fct_orders_hot_keys": "SELECT * FROM fct_orders",
        **{f"dq_{rule.lower()}_hot_keys": _BAD[rule] for rule in ("R001", "R009", "R013")},
        "readiness_probe": "SELECT 'written' AS name, true AS ready, count(*) AS n_rows"
        " FROM raw_orders UNION ALL SELECT 'absent', false, NULL",
        "analysis_status": _status(),
        "fct_orders_preview": "SELECT * FROM fct_orders"
        " ORDER BY order_id NULLS LAST, customer_id NULLS LAST LIMIT 10",
    }
    clean = {
        "raw_orders_clean": "SELECT * FROM raw_orders",
        "raw_order_events_clean": "SELECT * FROM raw_order_events",
        "fct_orders_clean": "SELECT * FROM fct_orders",
        "insight_01_revenue_gap_clean": _INSIGHTS["insight_01_revenue_gap"],
        "dq_report_clean": _report(),
        "dq_gate_clean": _gate(),
        "table_kept": "SELECT * FROM raw_orders",
        "catalog_kept": "SELECT * FROM raw_orders",
        "dq_failed_samples_clean": _samples(),
        "raw_orders_iso_times": _ISO_TIMES,
    }
    return {"table_appended": _appended(), "fct_orders_refreshed": _refreshed()} | {name: f"{_tables(True)} {sql}" for name, sql in messy.items()} | {
        name: f"{_tables(False)} {sql}" for name, sql in clean.items()
    }
