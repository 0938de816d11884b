"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.plans.session import scratch_path

#: A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower case, and every byte that is no word byte `[0-9a-z\x80-\xff]` becomes a space.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text."""
    return text.translate(WORDS).split()


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each row; null is empty. Converts a few rows at a time."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    for at in range(0, len(column), 256):
        for value in column.slice(at, 256).to_pylist():
            yield value or b""


def _trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks until told
    if trim:
        trim(0)


def give_back() -> None:
    """Return memory that earlier tasks of this worker have freed; workers are reused from stage to stage."""
    import gc

    gc.collect()
    _trim()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, returning freed memory before, after and between batches."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _trim()

        give_back()
        yield from run(each())
        give_back()

    return tidied


def digest(text: str = "text") -> Column:
    """16 bytes that stand for a whole text (null: empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def held(doc_id: str, modulus: int) -> Column:
    """True where crc32 of the id's decimal text leaves 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 2, F.lit(False))


#: Folders written by ``keep`` and not yet dropped.
KEPT: list[str] = []


def keep(df: DataFrame, name: str, file_rows: int = 0, parts: tuple[str, ...] = ()) -> DataFrame:
    """Write once to the shared folder and go on from the files.

    A lost executor then repeats nothing before this point, and a table that is
    read more than once is made once. ``drop_kept`` removes the files when no
    result that reads them is needed any more. ``file_rows`` bounds the rows of a
    file, for rows of many MB, of which a reader holds a whole file's; ``parts`` are columns to file rows under.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).partitionBy(*parts).parquet(path)
    KEPT.append(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan reads any more.

    Spark removes them when the driver's JVM finds their plans unused, which by itself
    may be half an hour after the table they led to was written.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def drop_kept(spark: SparkSession, paths: list[str]) -> None:
    """Remove kept tables whose readers are done."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in KEPT:
            KEPT.remove(path)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected to, for every node of ``links`` (a, b).

    Labels spread along links and through labels of labels; every round is written,
    so neither plan nor recovery grows with the number of rounds.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = keep(both, "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("new"))
        of_label = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        new = keep(
            new.join(of_label, "new").select(
                "node", F.least("new", "further").alias("label"), (F.least("new", "further") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def numbered(df: DataFrame, by: str, out: str, order: list[str], salt: str) -> DataFrame:
    """Number the rows of each value of ``by`` from 0.

    A value may hold most rows: numbers run inside (value, ``salt``), and each
    such part starts after the parts with a smaller salt. Only counts of parts
    meet in one window.
    """
    from pyspark.sql import Window

    parts = df.groupBy(by, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, salt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(by, salt).orderBy(*order)
    local = df.withColumn("__row", F.row_number().over(inside) - 1)
    return (
        local.join(parts, [by, salt])
        .withColumn(out, (F.col("__row") + F.col("__before")).cast("long"))
        .drop("__row", "__before", salt)
    )
