"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """Session for tests and benches; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("obsweave")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder, because
    driver and executors then share one file system.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"obsweave-{os.getpid()}")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where later steps read a result several times or iterate over it: plans
    stay short, and neither an iteration nor a lost executor repeats the
    record-sized steps that produced ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, grouped by application."""
    app = f"obsweave-{spark.sparkContext.applicationId}"
    return os.path.join(shared_dir(spark), app, f"{name}-{uuid.uuid4().hex}")


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide flag expressions need.

    A generated method above 8000 bytes of bytecode is never compiled by the JVM,
    so such a stage falls back to per-operator code, which is split into small methods.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


#: Bytes of rows that a Python worker is handed at once where a row holds blocks of values.
BATCH_BYTES = 8_000_000


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Hand rows to Python in batches of ``size`` bytes while eager steps run.

    By default a batch holds up to 10,000 rows, whatever a row weighs.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(min(size, int(before)) if str(before).isdigit() else size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
