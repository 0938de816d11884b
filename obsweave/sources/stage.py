"""Stage tables, exports and run metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _done(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path))


def outputs_exist(spark: SparkSession, paths: list[str]) -> bool:
    """A stage may be skipped only when all of its outputs are complete."""
    return all(_done(spark, p) for p in paths)


def materialize(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    force: bool = False,
) -> DataFrame:
    """Read a finished stage table, or build, write and read it back."""
    if force or not _done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_metadata(
    spark: SparkSession,
    counts: DataFrame,
    steps: list[str],
    source_id: str,
    run_date: str,
    store: str | None = None,
) -> DataFrame:
    """One row about a run; ``counts`` has the columns raw_n and clean_n.

    With ``store`` a source's first record is kept on later runs: the row is
    appended only when the store has none for this source.
    """
    row = counts.select(
        F.lit(source_id).alias("source_id"),
        F.lit(run_date).alias("run_date"),
        F.col("raw_n").cast("long").alias("raw_n"),
        F.col("clean_n").cast("long").alias("clean_n"),
        F.array(*[F.lit(s) for s in steps]).alias("steps"),
    )
    if store is None:
        return row
    if _done(spark, store):
        kept = spark.read.parquet(store)
        row = row.join(F.broadcast(kept.select("source_id").distinct()), "source_id", "left_anti")
    row.write.mode("append").parquet(store)
    return spark.read.parquet(store).where(F.col("source_id") == source_id)
