"""Reading and scoping occurrence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.columns import Columns


def occurrence_schema(cols: Columns = Columns(), corrupt: str | None = None) -> T.StructType:
    """Declared input schema; nothing is inferred from the data."""
    text = [*cols.ranks.values(), cols.basis, cols.event_date, cols.collector,
            cols.country, cols.status]
    fields = [T.StructField(cols.occ_id, T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in text]
    fields += [T.StructField(c, T.DoubleType()) for c in (cols.lon, cols.lat, cols.uncertainty)]
    fields += [T.StructField(c, T.IntegerType()) for c in (cols.year, cols.month, cols.day)]
    fields += [T.StructField(cols.has_issue, T.BooleanType())]
    if corrupt:
        fields.append(T.StructField(corrupt, T.StringType()))
    return T.StructType(fields)


def read_occurrences(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    cols: Columns = Columns(),
    schema: T.StructType | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """Parquet, or delimited text with a header.

    Columns are found by their names in the header; others are ignored, missing
    ones are NULL. Tab-separated text has no quotes. Blank text stays blank, blank
    numbers are NULL. ``corrupt`` names a column that keeps lines with too many or
    too few fields or with a value that does not fit its type.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    schema = schema or occurrence_schema(cols)
    sep = "\t" if fmt == "tsv" else ","
    reader = spark.read.option("sep", sep).option("header", True).option("quote", "" if fmt == "tsv" else '"')
    names = reader.option("inferSchema", False).csv(path).columns
    bad = corrupt or "_corrupt"
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    raw = reader.schema(text).option("columnNameOfCorruptRecord", bad).csv(path)
    out, misfit = [], F.lit(False)
    for f in schema.fields:
        if f.name == corrupt:
            continue
        cell = F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast("string")
        if isinstance(f.dataType, T.StringType):
            out.append((F.coalesce(cell, F.lit("")) if f.name in names else cell).alias(f.name))
        else:
            value = cell.try_cast(f.dataType)
            misfit = misfit | (cell.isNotNull() & value.isNull())
            out.append(value.alias(f.name))
    if corrupt:
        line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names])
        out.append(F.coalesce(F.col(bad), F.when(misfit, line)).alias(corrupt))
    return raw.select(*out)


def scope_filter(
    df: DataFrame,
    country: str | None,
    cols: Columns = Columns(),
    min_year: int = 1950,
    status: str | None = "PRESENT",
    has_coordinate: bool = True,
    no_issue: bool = True,
) -> DataFrame:
    """Acquisition predicates; plain comparisons, so they reach the scan."""
    if country is not None:
        df = df.where(F.col(cols.country) == country)
    if has_coordinate:
        df = df.where(F.col(cols.lon).isNotNull() & F.col(cols.lat).isNotNull())
    if no_issue:
        df = df.where(~F.col(cols.has_issue))
    if status is not None:
        df = df.where(F.col(cols.status) == status)
    return df.where(F.col(cols.year) >= min_year)
