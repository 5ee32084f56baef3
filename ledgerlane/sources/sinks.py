"""Table and CSV outputs, and the run context stamped on insight tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunContext:
    """What produced an output: input profile, input size, seed and mode of the run."""

    dq_profile: str
    n: int
    seed: int
    mode: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Warehouse:
    """Named tables in one database of the Spark catalog."""

    spark: SparkSession
    database: str = "default"

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def require(self, *tables: str) -> None:
        absent = [t for t in tables if not self.exists(t)]
        if absent:
            raise LookupError(f"missing tables: {', '.join(map(self.name, absent))}")

    def write(self, table: str, df: DataFrame, overwrite: bool = True) -> None:
        """Replace the table, or with ``overwrite=False`` leave an existing one as it is."""
        mode = "overwrite" if overwrite else "ignore"
        df.write.mode(mode).format("parquet").saveAsTable(self.name(table))

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")

    def append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").format("parquet").saveAsTable(self.name(table))

    def write_parts(self, table: str, df: DataFrame, by: str) -> None:
        """Replace, in the partitioned table, the partitions that ``df`` has rows of, and no others.

        The table is made where there is none. Rows of one partition are brought together before
        they are written; Spark divides partitions that are large.
        """
        rows = df.select(*[c for c in df.columns if c != by], by).hint("rebalance", by)
        if not self.exists(table):
            rows.write.partitionBy(by).format("parquet").saveAsTable(self.name(table))
            return
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.select(*self.table(table).columns).write.insertInto(self.name(table), overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def drop_parts(self, table: str, by: str, values: Sequence[str]) -> None:
        """Drop partitions by value, present or not."""
        for value in values:
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({by} = '{value}')")


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV folder with header, replaced. ``files=1`` only for outputs of bounded size."""
    out = df if files is None else df.coalesce(files)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def stamp(df: DataFrame, context: RunContext) -> DataFrame:
    """Add the run context and the generation time to every row."""
    return df.withColumns(
        {
            "run_id": F.lit(context.run_id),
            "dq_profile": F.lit(context.dq_profile),
            "n": F.lit(context.n).cast("bigint"),
            "seed": F.lit(context.seed).cast("bigint"),
            "mode": F.lit(context.mode),
            "generated_at": F.current_timestamp(),
        }
    )


def write_files(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Parquet folder, replaced; with ``overwrite=False`` an existing one is left as it is."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)
