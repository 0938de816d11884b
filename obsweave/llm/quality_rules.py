"""Quality rules: each rule runs once; policies and ablations read its stored bit.

``ledger`` measures every whole text and stores one failure bit per rule next to
the measurements. A policy is a named set of rules; applying one, or asking what
each rule alone costs, is arithmetic on the bits and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import texts

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower",
    "n_loud_words", "top_word",
)

#: Rules in bit order: a rule keeps its place for ever, new ones go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "upper_case": "2 * n_upper > n_lower",
    "exclamations": "10 * n_loud_words > n_words",
    "one_word": "4 * top_word > n_words and n_words >= 20",
}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"),
    "v2": tuple(RULES),
}


def measured(text: bytes) -> tuple[int, ...]:
    """The numbers in ``MEASURES`` for one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        end = 0  # words before this place are counted
        for at, w in enumerate(windows):
            if seen[w] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    n = len(text)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUED)),
        n - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        n - len(text.translate(None, bytes(range(65, 91)))),
        n - len(text.translate(None, bytes(range(97, 123)))),
        sum(c for w, c in counts.items() if w.endswith(b"!!")),
        max(counts.values(), default=0),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and one long column for each measurement; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(t) for t in texts(batch)]
            columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES]
            )

    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return narrow.mapInArrow(run, schema)


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Measurements and ``failed_bits``, one bit per rule, set where it rejects.

    Null or empty text has no words and fails the rules that such counts fail.
    Repeated rows each get their row; an empty table gives an empty ledger.
    """
    if len(rules) > 62:
        raise ValueError("a ledger holds at most 62 rules")
    bits = F.lit(0).cast("long")
    for at, rule in enumerate(rules.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << at)).otherwise(F.lit(0)).cast("long")
    return measure(docs).withColumn("failed_bits", bits)


def mask(policy: Iterable[str], rules: Mapping[str, str] = RULES) -> int:
    """Bits of the rules that a policy applies."""
    names = list(rules)
    return sum(1 << names.index(r) for r in set(policy))


def passes(policy: Iterable[str], rules: Mapping[str, str] = RULES, bits: str = "failed_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablations(
    book: DataFrame, policies: Mapping[str, Iterable[str]] = POLICIES, rules: Mapping[str, str] = RULES
) -> DataFrame:
    """For each policy and rule: rows kept, kept without the rule, failing it, failing only it.

    Counts rows per bit pattern first, so the rest runs over at most 2^rules rows.
    """
    names = list(rules)
    cases = F.array(*(
        F.struct(F.lit(p).alias("policy"), F.lit(mask(chosen, rules)).cast("long").alias("mask"), F.lit(r).alias("rule"),
                 F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for p, chosen in policies.items() for r in chosen
    ))
    n = F.col("n")
    hit, without = F.col("failed_bits").bitwiseAND(F.col("mask")), F.col("mask") - F.col("bit")
    return (
        book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
        .select("failed_bits", "n", F.inline(cases))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(hit == 0, n).otherwise(0)).alias("kept"),
            F.sum(F.when(F.col("failed_bits").bitwiseAND(without) == 0, n).otherwise(0)).alias("kept_without"),
            F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("failed"),
            F.sum(F.when(hit == F.col("bit"), n).otherwise(0)).alias("failed_only_this"),
        )
    )


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's measurements, its base verdict, and policy v2's."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(POLICIES["base"])).alias("base_failed"),
        passes(POLICIES["v2"]).alias("kept"),
        "failed_bits",
    )


def _sql() -> str:
    """The same columns in DuckDB."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << at} ELSE 0 END" for at, rule in enumerate(RULES.values()))
    without = lambda c: f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))"
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
               FROM documents),
    three AS (SELECT doc_id, p, ws[p:p + 2] AS key FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM w WHERE len(ws) > 2)),
    twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, key) AS c FROM three) WHERE c > 1),
    again AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY 1),
    words AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY 1, 2),
    top AS (SELECT doc_id, max(c) AS top_word, sum(CASE WHEN ends_with(word, '!!') THEN c ELSE 0 END) AS n_loud_words FROM words GROUP BY 1),
    m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                 {without('#*$%&|<>')} AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                 coalesce(n, 0) AS n_repeat_words, {without('A-Z')} AS n_upper, {without('a-z')} AS n_lower,
                 coalesce(n_loud_words, 0) AS n_loud_words, coalesce(top_word, 0) AS top_word
          FROM w LEFT JOIN again USING (doc_id) LEFT JOIN top USING (doc_id)),
    b AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
           failed_bits & {mask(POLICIES['base'])} <> 0 AS base_failed, failed_bits & {mask(POLICIES['v2'])} = 0 AS kept, failed_bits
    FROM b"""


SQL = _sql()
