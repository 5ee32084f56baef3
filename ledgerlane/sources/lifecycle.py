"""Raw orders and lifecycle events derived from a plain orders table.

Profile ``clean`` gives consistent data. Profile ``messy`` plants faults by fixed
predicates on the order key, so that every quality rule has something to find.
Expressions are SQL texts: there are many, and a text is one call into the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane import schemas as S

CLEAN = "clean"
MESSY = "messy"


def raw_orders(orders: DataFrame, profile: str = MESSY) -> DataFrame:
    created_at = _value(
        profile,
        "CAST(created AS STRING)",
        ("k % 500 = 123", "'not-a-date'"),
        ("k % 500 = 321", "NULL"),
    )
    copies = _value(
        profile,
        f"array({created_at})",
        ("k % 300 = 44", f"array({created_at}, {created_at})"),
    )
    return (
        _base(orders, profile)
        .select("*", F.explode(F.expr(copies)).alias("order_created_at"))
        .selectExpr(
            _value(profile, _ORDER_ID, ("k % 700 = 62", "NULL")) + " AS order_id",
            _value(
                profile,
                "'C' || CAST(o_custkey + 10000 AS STRING)",
                ("k % 200 = 7", "NULL"),
            )
            + " AS customer_id",
            "order_created_at",
            _value(
                profile,
                "o_totalprice",
                ("k % 100 = 33", "-10.0D"),
                ("k % 400 = 77", "NULL"),
            )
            + " AS order_amount",
            "'EUR' AS currency",
            "status AS order_status",
        )
    )


def raw_order_events(orders: DataFrame, profile: str = MESSY) -> DataFrame:
    """Up to six events per order: steps and their times are expanded, the rest follows."""
    messy = str(profile == MESSY).lower()
    kept = f"NOT ({messy} AND k % 400 = 42)"
    done, dropped = f"status = '{S.COMPLETED}'", f"status = '{S.CANCELLED}'"
    steps = {
        1: (kept, _value(profile, _after("5"), ("k % 350 = 65", "NULL"))),
        2: (
            f"{kept} AND status IN ('{S.COMPLETED}', '{S.REFUNDED}')"
            f" AND NOT ({messy} AND (k + 100000) % 37 = 0)",
            _value(
                profile,
                _after("180"),
                ("k % 350 = 55", "'not-a-date'"),
                ("k % 350 = 40", _after("-3600")),
            ),
        ),
        3: (
            f"{kept} AND {done}",
            _value(
                profile,
                _after("(k % 3 + 239) * 60 + (k % 7) * 10"),
                ("k % 350 = 45", _after("60")),
            ),
        ),
        4: (f"{kept} AND {dropped}", _after("600")),
        5: (f"{kept} AND {messy} AND {dropped} AND (k + 100000) % 53 = 0", _after("21600")),
        6: (f"{messy} AND k % 600 = 13", _after("0")),
    }
    structs = ", ".join(
        f"CASE WHEN {exists} THEN named_struct('step', {step}, 'event_timestamp', {at}) END"
        for step, (exists, at) in steps.items()
    )
    expanded = (
        _base(orders, profile).selectExpr("k", f"inline(array({structs}))").filter("step > 0")
    )
    return expanded.selectExpr(
        "'E' || CAST("
        + _value(profile, "k * 10 + step", ("step = 2 AND k % 250 = 60", "k * 10 + 1"))
        + " AS STRING) AS event_id",
        _value(
            profile,
            _ORDER_ID,
            ("step = 6", "'X' || CAST(k AS STRING)"),
            ("step = 2 AND k % 450 = 53 OR step = 3 AND k % 450 = 52", "NULL"),
        )
        + " AS order_id",
        _value(
            profile,
            f"CASE step WHEN 2 THEN '{S.PAYMENT_CONFIRMED}' WHEN 3 THEN '{S.ORDER_SHIPPED}'"
            f" WHEN 4 THEN '{S.ORDER_CANCELLED}' WHEN 5 THEN '{S.ORDER_SHIPPED}'"
            f" ELSE '{S.ORDER_CREATED}' END",
            ("step = 1 AND k % 350 = 20", "NULL"),
            ("step = 1 AND k % 350 = 30", "'order_opened'"),
        )
        + " AS event_type",
        "event_timestamp",
        "CASE WHEN step = 6 OR step = 1 AND k % 2 = 0 THEN 'web'"
        " WHEN step = 1 THEN 'mobile' ELSE 'backend' END AS source_system",
    )


def raw_tables(orders: DataFrame, profile: str = MESSY) -> dict[str, DataFrame]:
    return {
        S.ORDERS: raw_orders(orders, profile),
        S.ORDER_EVENTS: raw_order_events(orders, profile),
    }


_ORDER_ID = "'O' || CAST(k + 100000 AS STRING)"


def _base(orders: DataFrame, profile: str) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS k",
        "o_custkey",
        "o_totalprice",
        "timestampadd(SECOND, o_orderkey * 7 % 1440 * 60 + o_orderkey % 60,"
        " CAST(o_orderdate AS TIMESTAMP_NTZ)) AS created",
        _value(
            profile,
            f"CASE WHEN o_orderkey % 25 IN (0, 1) THEN '{S.CANCELLED}'"
            f" WHEN o_orderkey % 100 IN (8, 9, 10) THEN '{S.REFUNDED}'"
            f" ELSE '{S.COMPLETED}' END",
            ("o_orderkey % 250 = 99", "'unknown'"),
            ("o_orderkey % 250 = 199", "NULL"),
        )
        + " AS status",
    )


def _value(profile: str, regular: str, *faults: tuple[str, str]) -> str:
    """The regular value; in the messy profile the first fault that applies replaces it."""
    if profile not in (CLEAN, MESSY):
        raise ValueError(f"unknown profile: {profile}")
    if profile == CLEAN:
        return regular
    cases = " ".join(f"WHEN {condition} THEN {value}" for condition, value in faults)
    return f"CASE {cases} ELSE {regular} END"


def _after(seconds: str) -> str:
    return f"CAST(timestampadd(SECOND, {seconds}, created) AS STRING)"
