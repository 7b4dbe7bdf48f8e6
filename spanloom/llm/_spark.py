"""Shared helpers: tables written to the cluster's shared folder, and small Arrow batches."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, written

#: Rows of one Arrow batch; texts may be long, so batches stay far below Spark's 10,000 rows.
BATCH_ROWS = 512
#: The share of the driver's heap beyond which it is collected after a table is written.
HEAP = 0.4


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back; what was shuffled for it goes at once."""
    out = written(df, name)
    shrink(df.sparkSession)
    return out


def small_batches(spark: SparkSession) -> None:
    """Ready the workers, and keep Arrow batches small: a text column may hold very long values."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Hand memory that the driver has freed back to the system, where the C library can: after a fit, the rest of a job needs little."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shrink(spark: SparkSession) -> None:
    """Let the driver's JVM hand back what plans, compiled code and results of earlier jobs took, once its heap has grown beyond HEAP of the most that it may have.

    A heap grows to its limit however little of it lives (about a sixth in near-dedup), and is only made smaller by a full collection. What lies outside
    the heap takes nearly as much again, so both together fit the driver only while the heap stays small.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        runtime.gc()
        give_back()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
