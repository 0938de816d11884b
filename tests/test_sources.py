"""Reading, stages and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.columns import Columns
from obsweave.operators.flags import add_local_flags
from obsweave.queries.base import RULES, occurrences, references
from obsweave.sources import stage
from obsweave.sources.occurrences import read_occurrences, scope_filter
from obsweave.streaming.flags import flag_stream


def test_materialize_skips_and_forces(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n)
        return run

    assert stage.materialize(spark, build(3), path).count() == 3
    assert stage.materialize(spark, build(4), path).count() == 3
    assert stage.materialize(spark, build(5), path, force=True).count() == 5
    assert calls == [3, 5]
    assert stage.outputs_exist(spark, [path]) and not stage.outputs_exist(spark, [path, path + "x"])


def test_bad_lines_are_kept(spark, tmp_path):
    f = tmp_path / "o.tsv"
    f.write_text("occ_id\tlon\n1\t2.5\nx\ty\n")

    schema = T.StructType([T.StructField("occ_id", T.LongType()), T.StructField("lon", T.DoubleType())])
    rows = read_occurrences(spark, str(f), "tsv", schema=schema, corrupt="bad").collect()
    assert [(r["occ_id"], r["lon"]) for r in rows if r["bad"] is None] == [(1, 2.5)]
    assert [r["bad"] for r in rows if r["bad"]] == ["x\ty"]


def test_scope_reaches_the_scan(spark, tmp_path):
    df = spark.range(10).select(
        F.lit("KE").alias("country_code"), F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"),
        F.lit(False).alias("has_geospatial_issue"), F.lit("PRESENT").alias("occurrence_status"),
        (F.col("id") + 1945).cast("int").alias("year"), F.lit("x").alias("species"),
    )
    path = str(tmp_path / "p")
    df.write.parquet(path)
    out = scope_filter(read_occurrences(spark, path), "KE").select("year")
    scan = out._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert out.count() == 5
    assert "GreaterThanOrEqual(year,1950)" in scan.metadata().apply("PushedFilters")
    assert "species" not in scan.requiredSchema().simpleString()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    occurrences(spark, sf_dir).write.parquet(src)
    batch = add_local_flags(spark.read.parquet(src), Columns(), references(spark), RULES)
    stream = spark.readStream.schema(batch.sparkSession.read.parquet(src).schema).parquet(src)
    q = (
        flag_stream(stream, Columns(), references(spark), RULES)
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    flags = [c for c in got.columns if c.startswith("flag_")]
    count = lambda d: d.agg(*[F.count_if(c).alias(c) for c in flags]).collect()
    assert got.count() == batch.count() and count(got) == count(batch)


def test_text_is_read_by_header_name(spark, tmp_path):
    """Other columns are ignored, order is free, a stray quote is text, blanks stay, misfits are kept."""
    path = tmp_path / "records.txt"
    path.write_text(
        "year\textra\tspecies\tdecimalLongitude\n"
        '2001\tx\t"Genus odd\t36.5\n'
        "20x1\ty\tb\t37\n"
        "2003\tz\t\t\n"
        "2004\tz\n"
    )
    schema = T.StructType([
        T.StructField("species", T.StringType()), T.StructField("decimalLongitude", T.DoubleType()),
        T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    ])
    rows = read_occurrences(spark, str(path), "tsv", schema=schema, corrupt="bad").collect()
    assert [(r["species"], r["decimalLongitude"], r["year"], r["month"]) for r in rows[:3]] == [
        ('"Genus odd', 36.5, 2001, None), ("b", 37.0, None, None), ("", None, 2003, None)]
    assert [r["bad"] is not None for r in rows] == [False, True, False, True]
