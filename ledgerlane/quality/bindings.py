"""The thirteen standard rules: which check runs on which table, with which severity."""

from __future__ import annotations

from ledgerlane import schemas as S
from ledgerlane.quality import rules as R

_EVENT_ROW = ("event_id", "order_id", "event_type", "event_timestamp")
_ORDER_FIELDS = (
    "order_id",
    "customer_id",
    "order_created_at",
    "order_amount",
    "order_status",
)


# Ids, severities, key and sample columns of the thirteen rules.
def standard_rules() -> tuple[R.Rule, ...]:
    return (
        R.duplicate_pk(S.ORDER_EVENTS, "event_id", "R001", S.CRITICAL, _EVENT_ROW),
        R.duplicate_pk(
            S.ORDERS,
            "order_id",
            "R002",
            S.CRITICAL,
            ("order_id", "customer_id", "order_status", "order_amount"),
        ),
        R.not_null(S.ORDER_EVENTS, _EVENT_ROW, "R003", S.CRITICAL, _EVENT_ROW),
        R.not_null(S.ORDERS, _ORDER_FIELDS, "R004", S.CRITICAL, _ORDER_FIELDS),
        R.allowed_values(
            S.ORDER_EVENTS,
            "event_type",
            S.EVENT_TYPES,
            "R005",
            S.WARNING,
            ("event_id", "order_id", "event_type"),
        ),
        R.allowed_values(
            S.ORDERS,
            "order_status",
            S.ORDER_STATUSES,
            "R006",
            S.WARNING,
            ("order_id", "order_status"),
        ),
        R.amount_non_negative(
            "R007", S.WARNING, ("order_id", "order_amount", "order_status")
        ),
        R.orders_without_events(
            "R008", S.WARNING, ("order_id", "order_status", "order_created_at")
        ),
        R.events_without_orders("R009", S.WARNING, _EVENT_ROW),
        R.completed_without_payment("R010", S.WARNING),
        R.timestamp_parseable(
            S.ORDERS,
            "order_created_at",
            ("order_id",),
            "R011",
            S.CRITICAL,
            ("order_id", "order_created_at"),
        ),
        R.timestamp_parseable(
            S.ORDER_EVENTS,
            "event_timestamp",
            ("order_id", "event_id"),
            "R012",
            S.CRITICAL,
            ("event_id", "order_id", "event_timestamp"),
        ),
        R.event_not_before_order("R013", S.WARNING, _EVENT_ROW),
    )
