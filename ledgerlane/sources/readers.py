"""Raw orders and order events from CSV or parquet, under declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """CSV with a header, columns matched by name; missing-value texts become NULL.

    All files of one path have one header; a file with another one fails the read. Paths
    with different headers are given as a list and united by name. A missing path, a
    missing column, a row with too few or too many cells, or a number that is none fails the
    read. ``multi_line`` allows line breaks inside quotes, which makes files unsplittable;
    without it such a row is one with too few cells.
    """
    if not isinstance(path, str):
        parts = [read_csv(spark, p, schema, multi_line) for p in path]
        return reduce(DataFrame.unionByName, parts)
    text = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        # Rows are counted cell by cell, also where a query reads few columns.
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )
    return text.select(*[_typed(f, _present(F.col(f.name))) for f in schema.fields])


# Columns added while reading: the line of a row that does not fit, and its file.
CORRUPT, SOURCE_FILE = "corrupt_line", "source_file"
_MARK = "\x02"


@dataclass(frozen=True)
class CheckedRows:
    """Rows that fit, typed, and those that do not, as (source_file, line, reason)."""

    rows: DataFrame
    rejected: DataFrame


def read_csv_checked(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    pad_short: bool = False,
    multi_line: bool = False,
) -> CheckedRows:
    """As ``read_csv``, but rows that do not fit are set aside and do not end the read.

    Reasons: ``too many cells``, ``too few cells``, ``open quote``, ``no number``. With ``pad_short`` the cells
    that a short row lacks at its end are missing values, and the row fits. Files of one path
    must still share their header, and missing columns fail.
    """
    if not isinstance(path, str):
        parts = [read_csv_checked(spark, p, schema, pad_short, multi_line) for p in path]
        return CheckedRows(*[reduce(DataFrame.unionByName, [getattr(p, side) for p in parts]) for side in ("rows", "rejected")])
    options = {
        "header": True,
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "multiLine": multi_line,
    }
    header = spark.read.options(**options).csv(path).columns
    cells = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    read = spark.read.options(**options).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False, columnPruning=False
    )
    text = read.schema(cells).csv(path).select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))
    # The line is read again with a mark as its last cell: the mark's place tells how many it has.
    wide = ", ".join(f"c{i} string" for i in range(len(header) + 1))
    marked = F.from_csv(F.concat(F.col(CORRUPT), F.lit(f",{_MARK}")), wide, {"escape": '"', "multiLine": str(multi_line).lower()})
    seen = F.array(*[F.coalesce(marked[f"c{i}"], F.lit("")) for i in range(len(header) + 1)])
    whole = F.array_contains(seen, _MARK)
    misfit = (
        F.when(whole & ~F.lit(pad_short), "too few cells")
        .when(~whole & F.exists(seen, lambda c: c.endswith(_MARK)), "open quote")
        .when(~whole, "too many cells")
    )
    typed = {f.name: _typed(f, _present(F.col(f"`{f.name}`")), Column.try_cast) for f in schema.fields}
    numbers = [f.name for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    wrong = F.lit(False)
    for name in numbers:
        given = _present(F.col(f"`{name}`"))
        wrong = wrong | (given.isNotNull() & given.try_cast(schema[name].dataType).isNull())
    reason = F.coalesce(F.when(F.col(CORRUPT).isNotNull(), misfit), F.when(wrong, "no number"))
    judged = text.withColumn("reason", reason)
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in header]))
    return CheckedRows(
        judged.where("reason IS NULL").select(*typed.values()),
        judged.where("reason IS NOT NULL").select(SOURCE_FILE, line.alias("line"), "reason"),
    )


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with at least the schema's columns; NaN becomes NULL, timestamps stay typed."""
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    moments = (T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            F.col(f.name)
            if isinstance(kinds.get(f.name), moments)
            else _typed(f, F.col(f.name))
            for f in schema.fields
        ]
    )


def read_raw(
    spark: SparkSession, orders_path: str, events_path: str, fmt: str = "csv"
) -> dict[str, DataFrame]:
    """Both raw tables, keyed as the quality rules expect them."""
    read = {"csv": read_csv, "parquet": read_parquet}[fmt]
    return {
        S.ORDERS: read(spark, orders_path, S.RAW_ORDERS),
        S.ORDER_EVENTS: read(spark, events_path, S.RAW_ORDER_EVENTS),
    }


def typed_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Text timestamps as instants; a text that does not parse becomes NULL."""
    return df.withColumns({c: X.lenient_instant(df, c) for c in columns})


def wall_times(df: DataFrame, *columns: str) -> DataFrame:
    """As ``typed_timestamps``, but zone-less UTC times, for models built without storing."""
    return df.withColumns({c: X.lenient_wall_time(df, c) for c in columns})


def _present(column: Column) -> Column:
    return F.when(~column.isin(*S.MISSING_TOKENS), column)


def _typed(field: T.StructField, column: Column, cast: Callable[..., Column] = Column.cast) -> Column:
    value = cast(column, field.dataType)
    if isinstance(field.dataType, T.DoubleType):
        value = F.when(~F.isnan(value), value)
    return value.alias(field.name)
