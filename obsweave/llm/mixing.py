"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every row has an expected number of copies. Running sums of it, plus one offset per
source, cross an integer now and then; a row is emitted once per integer it
crosses. In order of size, the words taken differ from the expected ones by less
than twice the longest text of the source, whatever the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import keep
from obsweave.plans.running import running_sums
from obsweave.plans.skew import attach

WEIGHTS = (5, 2, 1)
MOST = 3
#: Expected copies are counted in units of 1e-9, so that sums are exact in any order.
UNIT = 1_000_000_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size).

    Sources in code point order, null last, take the weights in turn. With sources
    filled in order of capacity over weight, the level that all others share is the
    largest of the levels left after each of them: the same as sharing the excess
    again until no source is above its capacity.
    """
    named = sizes.withColumns({"last": F.col("source").isNull().cast("int"), "one": F.lit(1).cast("long")})
    ranked = running_sums(named, ["last", "source"], {"place": "one"})
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    ranked = ranked.withColumns({
        "weight": F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1),
        "room": F.col("source_size") * most,
    })
    ranked = ranked.withColumn("fill", F.col("room") / F.col("weight"))
    full = running_sums(ranked, ["fill", "last", "source"], {"rooms": "room", "weights": "weight"}, totals=True)
    full = keep(full, "source-levels")
    words = F.col("rooms_all") / most
    after = F.when(F.col("weights") < F.col("weights_all"),
                   (words - F.col("rooms")) / (F.col("weights_all") - F.col("weights")))
    level = full.agg(F.max(F.greatest(after, words / F.col("weights_all")))).scalar()
    target = F.least(level * F.col("weight"), F.col("room").cast("double"))
    return full.select("source", "source_size", "weight", target.alias("target"))


def offset(source: str, seed: str) -> Column:
    """One number of 0 to ``UNIT`` - 1 per source; null has its own."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("source "), F.col(source)), F.lit("null")))
    return F.pmod(F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(UNIT))


def systematic(rows: DataFrame, units: str, order: list[str], by: str = "source", seed: str = "mix") -> DataFrame:
    """Adds ``copies``: integers crossed by the running sum of ``units`` (of ``UNIT``) within ``by``, in this order.

    A source is cut along its order, sums run inside the cuts and start from the
    sums of the cuts before, so no task holds a source. Eager: the ranged rows are
    written once.
    """
    summed = running_sums(rows.withColumn("share", F.col(units).cast("decimal(19,0)")), order, {"upto": "share"}, [by])
    end = F.col("upto") + offset(by, seed)
    crossed = F.expr(f"(end div {UNIT}) - ((end - share) div {UNIT})")
    return summed.withColumn("end", end).withColumn("copies", crossed).drop("share", "upto", "end")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies`` of every row.

    Texts are read once; everything after works on a few numbers per row.
    """
    rows = docs.select(
        "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie")
    )
    rows = keep(rows.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = keep(sizes, "sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    facts = targets.join(sizes.select(F.col("source").alias("of"), "rows"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    facts = keep(facts, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    facts = facts.withColumn("units", F.floor(rate * UNIT + 0.5).cast("long"))
    total = facts.agg(F.sum("rows")).scalar()
    known = attach(rows, facts, ["source"], ["source_size", "target", "units"], weight="rows", total=total)
    return systematic(known, "units", ["size", "doc_id", "tie"], seed=seed).drop("units", "tie")


def emitted(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row once per copy, with ``copy`` from 1; rows without copies go."""
    own = df.where(F.col(copies) > 0)
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))


def op12_source_mix(docs: DataFrame) -> DataFrame:
    """Words taken of every document.

    Null text has no words; such and other empty texts take none. A null source is
    a source of its own, the last one. Ties of size are ordered by doc_id (null
    first) and a hash of the text, so that reruns agree; repeated rows share out
    their copies among them. Other columns are not read. An empty table gives an
    empty result.
    """
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
p AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM s),
f AS (SELECT *, {MOST} * source_size AS room,
             sum({MOST} * source_size) OVER o AS rooms, sum(weight) OVER o AS weights,
             sum(source_size) OVER () AS words, sum(weight) OVER () AS weights_all
      FROM p WINDOW o AS (ORDER BY ({MOST} * source_size)::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(greatest(words::DOUBLE / weights_all::DOUBLE,
                          CASE WHEN weights < weights_all THEN (words - rooms)::DOUBLE / (weights_all - weights)::DOUBLE END)) AS level FROM f),
t AS (SELECT source, source_size, least(level * weight, room::DOUBLE) AS target,
             ('0x' || substr(md5('mix:' || coalesce('source ' || source, 'null')), 1, 12))::BIGINT % {UNIT} AS start
      FROM f, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT} + 0.5)::BIGINT ELSE 0 END AS units FROM t),
c AS (SELECT doc_id, size, source_size, target, units,
             start + sum(units) OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS stop
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (size * (stop // {UNIT} - (stop - units) // {UNIT}))::BIGINT AS taken,
       (stop // {UNIT} - (stop - units) // {UNIT})::BIGINT AS copies
FROM c"""
