"""Small helpers shared by the operators: worker imports and memory, and the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this machine import the package wherever the driver was started."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def give_back() -> None:
    """Hands memory that this process has freed back to the system.

    Python workers serve one stage after another; what one freed but kept would add to the next.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run``, a task's function, with its memory given back when it ends."""

    def whole(*arguments) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*arguments)
        finally:
            give_back()

    return whole


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back.

    Cuts the lineage: a lost executor costs no recomputation of what was written, and
    several readers see the same rows. The folder is spark.checkpoint.dir; where none is
    set (in tests), the warehouse folder of the session. It goes with the application.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/ledgerlane-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # The folder's file system removes it when the application ends.
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
