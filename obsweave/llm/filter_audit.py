"""Filter interaction audit: what every order of a few filters removes, from one count per failure pattern.

The filters that already ran form a state of the subset lattice; running one more
is an edge. Path counts from the empty state forward and from the full state
backward say how many orders cross an edge, so the removals of the edges give
Shapley sums and the steps of every order without running any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import digest

#: Java's and DuckDB's class of the six characters that part words.
GAP = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 7  # 5040 orders of 7 steps per part


def _words() -> Column:
    """Words of ``body``; a text without words has none."""
    trimmed = F.btrim("body", F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


#: Filters by letter: the condition under which a text fails, over ``body`` (text, null as empty) and its ``words``.
TEXT_FILTERS: dict[str, str] = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * (octet_length(body) - octet_length(regexp_replace(body, '[A-Z]', ''))) > 3 * length(body)",
    "D": "body rlike '[#$%&*|]'",
}
#: The filter that fails a text some smaller doc_id has as well.
REPEATED = "E"


def paths(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders that lead from it to the full one."""
    states = 1 << n
    reach, leave = [0] * states, [0] * states
    reach[0] = leave[-1] = 1
    for state in range(states):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(states)):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def patterns(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = TEXT_FILTERS, repeated: str | None = REPEATED) -> DataFrame:
    """Documents by part (lang), failure pattern and labels: part, bits, n, good, toxic.

    Bit k is the k-th filter in letter order. Copies of a text are grouped by
    (text, part, labels) before anything compares ids, so a text that a third of
    the rows share reaches the last step as a few rows.
    """
    letters = sorted([*filters, *([repeated] if repeated else [])])
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    bits = F.lit(0)
    for letter, fails in filters.items():
        bits = bits + F.when(F.expr(fails), 1 << letters.index(letter)).otherwise(0)
    rows = (
        docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
        .withColumn("words", _words())
        .select("doc_id", "part", digest("body").alias("key"), bits.alias("bits"))
        .groupBy("doc_id", "part", "key", "bits").agg(F.count(F.lit(1)).alias("n"))
    )
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # null ids have no labels; they would all meet in one partition of the join
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    groups = (
        named.unionByName(nameless)
        .groupBy("key", "part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"),
             F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    )
    if repeated:
        least = F.min("first").over(Window.partitionBy("key"))
        at_least = F.when(F.col("first") == least, F.col("at_first")).otherwise(0)
        groups = groups.withColumn("late", F.col("with_id") - at_least).select(
            "part", "good", "toxic",
            F.inline(F.array(
                F.struct("bits", (F.col("n") - F.col("late")).alias("n")),
                F.struct((F.col("bits") + F.lit(1 << letters.index(repeated))).alias("bits"), F.col("late").alias("n")),
            )),
        )
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return groups.groupBy("part", "bits").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def edges(found: DataFrame, letters: Sequence[str]) -> DataFrame:
    """One row per part and lattice edge: the state before, the filter, what it meets and removes there, its Shapley sum.

    A part has at most 2^n patterns, so they travel as one short array.
    """
    n = len(letters)
    reach, leave = paths(n)
    item = F.struct("bits", "n", "good", "toxic")
    whole = found.groupBy("part").agg(F.collect_list(item).alias("seen"))
    at = F.explode(F.sequence(F.lit(0), F.lit((n << n) - 1)))
    edge = whole.select("part", "seen", at.alias("edge")).withColumns(
        {"state": F.floor(F.col("edge") / n).cast("int"), "filter": (F.col("edge") % n).cast("int")}
    )
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    edge = edge.withColumn("bit", bit).where(F.col("state").bitwiseAND(F.col("bit")) == 0)
    state, bit = F.col("state"), F.col("bit")

    def total(field: str, want) -> Column:
        return F.aggregate("seen", F.lit(0).cast("long"), lambda acc, x: acc + F.when(want(x["bits"]), x[field]).otherwise(0))

    passed = lambda b: b.bitwiseAND(state) == 0
    fails = lambda b: b.bitwiseAND(bit) != 0
    edge = edge.select(
        "part", "state", "filter",
        total("n", lambda b: b.bitwiseAND(state.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", lambda b: passed(b) & fails(b)).alias("removed"),
        total("n", lambda b: ~passed(b) & fails(b)).alias("redundant"),
        total("n", lambda b: b == bit).alias("unique_fails"),
        total("good", lambda b: passed(b) & fails(b)).alias("good_lost"),
        total("toxic", lambda b: passed(b) & fails(b)).alias("toxic_lost"),
        (F.element_at(F.lit(reach), state + 1) * F.element_at(F.lit(leave), state + bit + 1)).alias("orders"),
    )
    own = Window.partitionBy("part", "filter")  # 2^(n-1) edges
    return edge.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(own))


def steps(crossed: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Every order of the filters, step by step, read from the edges it crosses."""
    rows = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append((state, f, "".join(letters[x] for x in order), step))
            state |= 1 << f
    table = crossed.sparkSession.createDataFrame(rows, "state int, filter int, filter_order string, step int")
    # at most 7! * 7 rows whatever the data
    return crossed.join(F.broadcast(table), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters, and step, zeros included.

    Null text is empty text, and equal to it; null lang is the part of the empty
    string. Repeated rows count each; rows of one doc_id are never smaller than
    each other, and a row without doc_id neither repeats a text nor is repeated. Of
    several labels of a doc_id one that says 1 is enough. Other columns are not
    read. An empty table has no parts and gives no rows.
    """
    letters = sorted([*TEXT_FILTERS, REPEATED])
    return steps(edges(patterns(docs, labels), letters), letters)


def _sql() -> str:
    """The same rows in DuckDB, order by order."""
    return r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    firsts AS (SELECT t, min(doc_id) AS least FROM w GROUP BY 1),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
              FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
                 || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                 || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
          FROM w JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
    c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, filter_order[step] AS own, substr(filter_order, 1, step - 1) AS earlier
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS bad, fails = own AS only_this,
                 len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone
          FROM c, s),
    k AS (SELECT part, filter_order, step, own,
                 coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost
          FROM r GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM k"""


SQL = _sql()
