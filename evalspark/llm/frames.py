"""Small Spark helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession

from evalspark.session import fresh_dir

# Rows per Arrow batch: texts of some kilobytes each make batches of a few megabytes.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on; all of them can be set on a live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder.

    Aggregates that are joined back to their rows are written too: Spark splits a hot key of a join only if both
    sides come from shuffles of their own, which the result of an aggregate by that key doesn't.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str) -> DataFrame:
    """mapInArrow, the batches of ``function`` given as dicts of arrays in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(batches):
            names = list(out)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return a finished task's memory to the system: workers live on from stage to stage, beside each other and the heap."""
    pa.default_memory_pool().release_unused()
    if "libc" not in _LIBRARY:
        _LIBRARY["libc"] = ctypes.CDLL(None)
    trim = getattr(_LIBRARY["libc"], "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


_LIBRARY: dict[str, ctypes.CDLL] = {}


def bounded_rows(df: DataFrame, most: int) -> list[Row]:
    """The rows of ``df``, of which a parameter allows at most ``most``."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than the {most} rows that may reach the driver")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
