"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window (10 words, or a whole shorter item) is a set of shingles of
two words. All of them must occur in a document for the window to occur, so the
join needs a prefix of one shingle only: the rarest in the documents. A document
shingle that is some window's prefix makes a candidate; its place gives the only
start the window can have (positional bound), the document must hold the whole
window from there (length bound), and the words decide exactly.

The benchmark is the stated query side: it is taken in slices of bounded size,
each of which visits every document.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import alnum_words, keep, texts, tidy

WINDOW = 10
SHINGLE = 2
#: Words of benchmark text in one slice, the bound of what a task holds of it (about 100 MB).
SLICE_WORDS = 500_000


def shingles(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[k:] for k in range(size)))


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Consecutive words of an item; one window where it has fewer, none without words."""
    if not words:
        return []
    return list(shingles(words, min(window, len(words))))


def shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]], sizes: set[int]) -> Counter:
    """Occurrences of the wanted shingles over all documents; as many numbers as a slice has shingles."""
    code = {s: i for i, s in enumerate(sorted(wanted))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts(batch):
                words = alnum_words(text)
                for size in sizes:
                    seen.update(s for s in shingles(words, size) if s in code)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([code[s] for s in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"]
            )

    rows = docs.select("text").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    names = sorted(wanted)
    return Counter({names[r["code"]]: r["n"] for r in rows})


def _prefix_index(items: list[tuple[int, bytes]], docs: DataFrame, window: int, size: int) -> tuple[dict, set[int]]:
    """Prefix shingle to {its place in a window: {window: its items}}."""
    owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for item_id, text in items:
        for w in item_windows(alnum_words(text), window):
            owners[w].add(item_id)
    sizes = {min(size, len(w)) for w in owners}
    wanted = {s for w in owners for s in shingles(list(w), min(size, len(w)))}
    counts = shingle_counts(docs, wanted, sizes) if wanted else Counter()
    index: dict = defaultdict(lambda: defaultdict(dict))
    for w, ids in owners.items():
        parts = list(shingles(list(w), min(size, len(w))))
        place = min(range(len(parts)), key=lambda k: (counts[parts[k]], parts[k], k))
        if counts[parts[place]]:  # a window with a shingle that no document has occurs nowhere
            index[parts[place]][place][w] = sorted(ids)
    return {s: {p: dict(ws) for p, ws in by_place.items()} for s, by_place in index.items()}, sizes


def find(words: list[bytes], index: dict, sizes: set[int], by_length: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans [start, end) of words inside occurring windows, not merged, and the items found."""
    spans, found = [], set()
    for size in sizes:
        for at, s in enumerate(shingles(words, size)):
            if s not in index:
                continue
            for place, windows in index[s].items():
                start = at - place
                if start < 0:
                    continue
                for length in by_length[s, place]:
                    if start + length <= len(words):
                        ids = windows.get(tuple(words[start : start + length]))
                        if ids:
                            spans.append((start, start + length))
                            found.update(ids)
    return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_HITS = (
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
)


def _visit(docs: DataFrame, index: dict, sizes: set[int]) -> DataFrame:
    """Adds one slice's hits to those that ``docs`` carries."""
    by_length = {(s, p): sorted({len(w) for w in ws}) for s, by_place in index.items() for p, ws in by_place.items()}
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [batch.column(names.index(c)).to_pylist() for c in ("starts", "ends", "items")]
            rows = []
            for text, starts, ends, items in zip(texts(batch), *before):
                words = alnum_words(text)
                spans, found = find(words, index, sizes, by_length)
                spans = merged(spans + list(zip(starts, ends)))
                rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(found | set(items))))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string())]
            new = {f.name: pa.array(c, k) for f, c, k in zip(_HITS, columns, kinds)}
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else batch.column(i) for i, c in enumerate(names)], names
            )

    return docs.mapInArrow(tidy(run), docs.schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, carry: list[str] = ["doc_id"], window: int = WINDOW, size: int = SHINGLE,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """The carried columns, ``n_words``, ``starts`` and ``ends`` of hit word runs, ``items`` found.

    Item ids of any type are reported as text. Null and empty texts have no words. Items without id or words are left out;
    equal items are all reported. Repeated documents each get their row.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / 4 / slice_words))
    none = F.array().cast("array<long>")
    kept = [c for c in carry if c != "text"]
    out = docs.select(*kept, "text", F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        index, sizes = _prefix_index([(r["item_id"], r["text"].encode()) for r in part], docs, window, size)
        out = _visit(out, index, sizes)
        if slices > 1:
            out = keep(out, "hits")
    return out.select(*carry, "n_words", "starts", "ends", "items")


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``contamination``."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.array_sort("items"), ",")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH lw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM iw WHERE len(ws) > 0),
ix AS (SELECT item_id, n, unnest(list_transform(generate_series(1, len(ws) - n + 1), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS key FROM il),
sizes AS (SELECT DISTINCT n FROM ix),
dx AS (SELECT doc_id, n, unnest(generate_series(1, len(ws) - n + 1)) AS p, ws FROM lw, sizes WHERE len(ws) >= n),
dk AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS key FROM dx),
hits AS (SELECT doc_id, n, p, item_id FROM dk JOIN (SELECT DISTINCT item_id, n, key FROM ix) USING (n, key)),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS w FROM hits) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
