"""URL filters: rules indexed by their rarest literal token.

A rule names literal tokens that every matching URL holds as whole tokens. Each
rule is filed under the one of them that is rarest in the URLs at hand; the
tokens of a URL fetch candidate rules, and only those run their regular
expression. Host rules and pattern rules share the index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z0-9]+")
UPPER = {b: b + 32 for b in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are whole tokens of every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    host: bool = False


def host_rule(rule: str, verdict: str) -> Rule:
    """``host/path``: that host and its subdomains, paths that start with the rule's."""
    host, slash, path = rule.partition("/")
    return Rule(
        rule, verdict, r"\A(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), tuple(TOKEN.findall(host)), True
    )


def label_rule(words: str, verdict: str = "block") -> Rule:
    """Hosts that have ``words`` (joined by hyphens) as whole tokens in a row."""
    return Rule(f"*{words}*", verdict, rf"\A(?:[^/]*[^/a-z0-9])?{re.escape(words)}(?:[^a-z0-9]|\z)", tuple(TOKEN.findall(words)))


def path_rule(words: str, verdict: str = "block") -> Rule:
    """Paths that have the token ``words`` as a folder."""
    return Rule(f"/{words}/", verdict, rf"/{re.escape(words)}/", tuple(TOKEN.findall(words)))


HOST_RULES = (
    host_rule("net/", "block"), host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"),
)
PATTERN_RULES = (
    *(label_rule(x) for x in (
        "casino", "casino-win", "free-bets", "bets", "poker", "jackpot", "cheap-pills", "pills", "adult", "adult-x",
        "porn", "xxx", "escort", "spam", "spam-farm", "malware", "phishing", "torrent", "warez", "payday-loan")),
    *(path_rule(x) for x in ("ads", "adserver", "tracker", "banner", "wp-admin", "cgi-bin", "xxx", "casino")),
)
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the contract has them; null or no ``://``: both empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :]).group()


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """How many URLs hold each token that a rule names: as many rows as the rules have tokens."""
    names = sorted({t for r in rules for t in r.tokens})
    wanted = F.array(*(F.lit(t) for t in names))
    found = F.array_distinct(F.array_intersect(F.split(F.lower(F.col(url)), "[^a-z0-9]+"), wanted))
    rows = pages.select(F.explode(found).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token to the places of the rules filed under it; ties go to the first in order."""
    out: dict[str, list[int]] = {}
    for at, rule in enumerate(rules):
        out.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(at)
    return out


def judge(
    pages: DataFrame, key: str = "page_id", url: str = "url",
    rules: Sequence[Rule] = HOST_RULES + PATTERN_RULES, default: str = DEFAULT,
) -> DataFrame:
    """key, host, path, rule, verdict and the pattern rule that decided, if any.

    The longest host rule decides; without one the first pattern rule in order,
    and without that the default. Null URLs and those without ``://`` have an empty
    host and path and get the default. One row per input row.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token")
    filed = index(rules, token_counts(pages, rules, url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern.replace(r"\z", r"\Z")) for r in rules]
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                host, path = split_url(value)
                target = host + path
                tokens = set(TOKEN.findall(target.translate(UPPER)))
                hits = [i for t in tokens & filed.keys() for i in filed[t] if patterns[i].search(target)]
                by_host = max((i for i in hits if rules[i].host), key=lambda i: (len(rules[i].name), -i), default=None)
                by_pattern = min((i for i in hits if not rules[i].host), default=None)
                chosen = by_pattern if by_host is None else by_host
                out.append((
                    host, path, None if by_host is None else rules[by_host].name,
                    default if chosen is None else rules[chosen].verdict,
                    None if by_pattern is None else rules[by_pattern].name,
                ))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)],
                [key, "host", "path", "rule", "verdict", "pattern_rule"],
            )

    narrow = pages.select(key, F.col(url).cast("string").alias(url))
    schema = T.StructType([
        narrow.schema[key],
        *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "pattern_rule")),
    ])
    return narrow.mapInArrow(run, schema)


def _sql() -> str:
    """The same verdicts in DuckDB, by trying every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = sorted((r for r in HOST_RULES), key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN regexp_matches(host || path, {quote(r.pattern)}) THEN {quote(r.name)}" for r in hosts)
    base = " ".join(f"WHEN rule = {quote(r.name)} THEN {quote(r.verdict)}" for r in hosts)
    pattern = " ".join(f"WHEN regexp_matches(host || path, {quote(r.pattern)}) THEN {quote(r.name)}" for r in PATTERN_RULES)
    mine = " ".join(f"WHEN pattern_rule = {quote(r.name)} THEN {quote(r.verdict)}" for r in PATTERN_RULES)
    return rf"""
    WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
    c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT *, CASE {rule} ELSE NULL END AS rule, CASE {pattern} ELSE NULL END AS pattern_rule FROM c)
    SELECT page_id, host, path, rule, CASE {base} {mine} ELSE '{DEFAULT}' END AS verdict, pattern_rule FROM d"""


SQL = _sql()
