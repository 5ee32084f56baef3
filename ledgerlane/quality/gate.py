"""The pass/fail gate over a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane import schemas as S


class DataQualityError(RuntimeError):
    """A critical rule failed in a production run."""


def critical_failures(report: DataFrame) -> DataFrame:
    return report.filter(
        (F.col("severity") == S.CRITICAL) & (F.col("failed_rows") > 0)
    )


def would_fail(report: DataFrame) -> bool:
    return not critical_failures(report).isEmpty()


def gate_decisions(report: DataFrame) -> DataFrame:
    """Per run mode, whether this report fails the run; development runs never fail."""
    return report.agg(
        F.count_if((F.col("severity") == S.CRITICAL) & (F.col("failed_rows") > 0)).alias(
            "critical_failures"
        )
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit(S.DEV).alias("mode"), F.lit(False).alias("would_fail")),
                F.struct(
                    F.lit(S.PROD).alias("mode"),
                    (F.col("critical_failures") > 0).alias("would_fail"),
                ),
            )
        )
    )


def enforce(report: DataFrame, mode: str) -> None:
    """Raise in production when a critical rule failed; the message names each of them."""
    if mode not in (S.DEV, S.PROD):
        raise ValueError(f"unknown mode: {mode}")
    if mode == S.DEV:
        return
    failed = critical_failures(report).orderBy("rule_id").collect()
    if failed:
        lines = [
            f"{r.rule_id} {r.rule_name} ({r.table_name}): "
            f"{r.failed_rows} rows, rate {r.failure_rate:.6f}"
            for r in failed
        ]
        raise DataQualityError("critical data quality failures\n" + "\n".join(lines))
