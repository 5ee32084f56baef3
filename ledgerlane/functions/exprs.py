"""Column expressions: flags, guarded ratios, time handling. All run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane import schemas as S


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for an unknown condition)."""
    return F.when(condition, 1).otherwise(0)


def presence_flag(column: Column) -> Column:
    return flag(column.isNotNull())


def count_where(condition: Column) -> Column:
    """Number of rows that satisfy the condition; NULL on no rows at all."""
    return F.sum(flag(condition).cast("bigint"))


def sum_where(condition: Column, value: Column) -> Column:
    """Sum of ``value`` with every other row adding 0.0; NULL only without any non-null term."""
    return F.sum(F.when(condition, value).otherwise(0.0))


def any_null(*columns: str) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def null_or_outside(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def null_or_negative(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) < 0)


def percent_or_null(part: Column, whole: Column) -> Column:
    """Share in percent; NULL where the whole is zero."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0.0 where the whole is zero or missing."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)
    )


def minute_boundaries(start: Column, end: Column) -> Column:
    """Minute marks crossed from start to end, not elapsed whole minutes."""
    return F.timestamp_diff(
        "MINUTE", F.date_trunc("MINUTE", start), F.date_trunc("MINUTE", end)
    )


def _plain_form(text: Column) -> Column:
    """An accepted text in the one form that Spark's casts read: microseconds, +hh:mm, no blank before it."""
    full = F.regexp_replace(text, r"^(.{10}[ T]\d{2}:\d{2})(?=$|[ Z+-])", "$1:00")
    short = F.regexp_replace(full, r"(\.\d{6})\d{1,3}", "$1")
    close = F.regexp_replace(short, r"(:\d{2}(?:\.\d+)?) (Z|[+-])", "$1$2")
    colon = F.regexp_replace(close, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    return F.regexp_replace(colon, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")


def parse_instant(text: Column) -> Column:
    """Instant of an accepted text, NULL for anything else.

    A shape check plus Spark's own cast: the cast rejects impossible dates, the
    shape rejects the short forms the cast would let through. The common form, a day and
    a time to the second, is cast as it is; only the others are rewritten.
    """
    plain = _plain_form(text)
    # A day alone takes no offset.
    timed = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(plain)
    return (
        F.when(text.rlike(S.COMMON_TIMESTAMP), F.concat(text, F.lit("Z")).try_cast("timestamp"))
        .when(text.rlike(S.PLAIN_TIMESTAMP), F.concat(timed, F.lit("Z")).try_cast("timestamp"))
        .when(text.rlike(S.OFFSET_TIMESTAMP), plain.try_cast("timestamp"))
    )


def parse_wall_time(text: Column) -> Column:
    """UTC wall clock of an accepted text; plain texts need no detour over an instant."""
    plain = _plain_form(text)
    return (
        F.when(text.rlike(S.COMMON_TIMESTAMP), text.try_cast("timestamp_ntz"))
        .when(text.rlike(S.PLAIN_TIMESTAMP), plain.try_cast("timestamp_ntz"))
        .when(text.rlike(S.OFFSET_TIMESTAMP), utc_wall_time(plain.try_cast("timestamp")))
    )


# Forms of timestamp texts by name, in the order in which they are preferred where several fit equally
# well. Days and months have one digit or two; a time of day is optional; texts are UTC.
_CLOCK = "[ H:mm[:ss[.SSSSSS]]]"
TIME_FORMS = {
    "iso": None,
    "month_first": "M/d/yyyy" + _CLOCK,
    "day_first": "d/M/yyyy" + _CLOCK,
    "day_first_dots": "d.M.yyyy" + _CLOCK,
    "day_first_dashes": "d-M-yyyy" + _CLOCK,
    "year_first_slashes": "yyyy/M/d" + _CLOCK,
    "compact": "yyyyMMdd[ HHmmss]",
    "month_name": "MMM d, yyyy" + _CLOCK,
}

# Key in a column's metadata that names the form of its texts.
TIME_FORM = "time_form"


def parse_form(text: Column, form: str) -> Column:
    """Instant of a text in a named form, NULL for anything else."""
    pattern = TIME_FORMS[form]
    if pattern is None:
        return parse_instant(text)
    return F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(pattern + "X"))


def _form_of(df: DataFrame, column: str) -> str:
    return df.schema[column].metadata.get(TIME_FORM, "iso")


def utc_wall_time(instant: Column) -> Column:
    """The UTC wall clock of an instant as a zone-less timestamp, in any session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def lenient_instant(df: DataFrame, column: str) -> Column:
    """Instant of a text or timestamp column; texts that do not parse become NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return parse_form(F.col(column), _form_of(df, column))
    return strict_instant(df, column)


def lenient_wall_time(df: DataFrame, column: str) -> Column:
    """UTC wall clock of a text or timestamp column; texts that do not parse become NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        form = _form_of(df, column)
        text = F.col(column)
        return parse_wall_time(text) if form == "iso" else utc_wall_time(parse_form(text, form))
    return utc_timestamp(df, column)


def strict_instant(df: DataFrame, column: str) -> Column:
    """Instant of a text or timestamp column; a bad text fails the query."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.TimestampType):
        return value
    if isinstance(kind, T.TimestampNTZType):
        # Read the wall clock as UTC whatever the session zone is.
        return F.concat(value.cast("string"), F.lit("Z")).cast("timestamp")
    zoned = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return (
        F.when(zoned, value).otherwise(F.concat(value, F.lit("Z"))).cast("timestamp")
    )


def utc_timestamp(df: DataFrame, column: str) -> Column:
    """Strict conversion of a column to a zone-less UTC timestamp."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.col(column)
    return utc_wall_time(strict_instant(df, column))
