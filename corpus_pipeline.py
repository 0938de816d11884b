"""The training-data pipeline over documents: its stages in order, and the run that applies them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import common, decontaminate, jaccard_join, packing, suffix_dedup, toxicity

#: Near duplicates share 80 of 100 of their shingles of five words; op10 has values of its own.
WORDS, SIMILAR, OF = 5, 80, 100
#: Bytes of a batch handed to a Python worker, beyond a single longer text.
BATCH_BYTES = 8_000_000
#: Tables kept by the last call of each stage; the next stage reads what that call returned, written by then.
_LEFT: dict[str, list[str]] = {}


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id and text as operators read them; all else in one column, so that no name clashes with theirs."""
    others = F.struct(*[c for c in docs.columns if c != "text"])
    row = F.struct(others.alias("columns"), F.col("text").isNull().alias("no_text"))
    return docs.select(row.alias("row"), "doc_id", "text")


def _unwrapped(out: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` again, some of them new."""
    new = {"text": F.col("text"), **new}
    return out.select(*[new.get(c, F.col(f"row.columns.`{c}`")).alias(c) for c in docs.columns])


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [stage.__name__ for _, stage in STAGES]
        here = names.index(make.__name__)
        if here:  # the result of the stage before was written to become these docs
            common.drop_kept(spark, _LEFT.pop(names[here - 1], []))
        # texts of any length reach Python workers a few MB at a time
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        before = set(common.KEPT)
        out = make(spark, docs, sf_dir)
        if make.__name__ != names[-1]:  # nobody knows when the last result is read; its tables stay
            _LEFT.setdefault(make.__name__, []).extend(p for p in common.KEPT if p not in before)
        return out

    run_stage.__doc__ = make.__doc__
    run_stage.__name__ = make.__name__
    return run_stage


@_stage
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the network calls toxic; null and empty texts are not."""
    labels = common.read(spark, sf_dir, "labels")
    scored = toxicity.toxic_scores(_wrapped(docs), labels, ["row", "text"])
    return _unwrapped(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each group that shingles link: the smallest id, null last, then the smallest text key.
    Rows without words are linked with nothing and stay; of rows equal in id and text one stays."""
    marked = common.keep(jaccard_join.linked(docs, WORDS, SIMILAR, OF), "groups")
    row = F.struct("doc_id", "key").alias("row")  # nulls within are equal
    first = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("row")
    wordless = marked.where("n_shingles = 0").select(row).distinct()
    stay = marked.where("n_shingles > 0").groupBy("node").agg(first).select("row").union(wordless)
    # the columns travel in one struct, so that none of them can clash
    named = docs.select(F.struct(*docs.columns).alias("all"), F.struct("doc_id", common.digest().alias("key")).alias("row"))
    out = named.join(stay, "row", "left_semi")
    if marked.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["row"])
    return out.select("all.*")


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every string of 200 bytes that also starts elsewhere, up to whole characters;
    documents of which nothing is left go, those that were empty stay."""
    out = suffix_dedup.deduplicated(_wrapped(docs), ["row"], whole_characters=True)
    out = out.where((F.col("n_bytes") == 0) | (F.octet_length("kept") > 0))
    text = F.when(~F.col("row.no_text"), F.decode("kept", "UTF-8"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return _unwrapped(out, docs, **new)


@_stage
def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(_wrapped(docs), common.read(spark, sf_dir, "benchmark"), ["row", "text"])
    return _unwrapped(found.where(F.size("items") == 0), docs)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    return packing.op3_best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", contaminated_documents),
    ("best-fit packing", packed_sequences),
]
#: No SQL: the stages cannot be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole documents table; each one's result is written before the next reads it."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        written = common.KEPT[-1]
        common.drop_kept(spark, [p for p in (*_LEFT.pop(stage.__name__, []), read) if p])
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
