"""Jaccard join of word shingles by T-occurrence search.

Two sets of sizes n and m reach Jaccard t exactly when they share
``ceil(t (n + m) / (1 + t))`` shingles, so a join is a search for the sets that
occur often enough on the inverted lists of a query set. Which pairs have to be
searched follows from a global order, rare shingles first: sets that link share k
shingles among their first ``n - ceil(t n) + k``, at places that leave room for
the overlap. A search takes one query and a block of candidates: the short
inverted lists are merged on a heap, and only candidates near enough to their
overlap are looked up in the long ones by binary search (DivideSkip).

Only connected components are asked for, so a list's sets are first searched
against a leader or two, and pairs within a list are searched only where these
links have left them apart. Equal sets are one set from the start.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import LOWER, components, digest, keep, texts, tidy

#: The contract of op10: words of a shingle, and the Jaccard similarity from which two sets link.
SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
#: Shingles whose frequency orders them; all others count as rare. Any number gives the same links.
RANKED = 200_000
#: Shingles that two sets must share at the beginning of their order before they are searched.
COMMON = 3
#: Candidates of one search.
BLOCK = 256
AT_ONCE = 8_000_000
#: Bits of the filter that spares reading sets nobody searches (4 MB); the join after it is exact.
FILTER_BITS = 1 << 25

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(parts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: ``size`` consecutive lower-cased words
    `[^\\x20\\x09-\\x0D]+`; fewer words are one shingle, none are the empty set."""
    import xxhash

    words = [p.translate(LOWER).split() for p in parts]
    lengths = np.array([len(w) for w in words], np.int64)
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    run = names[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    place = np.arange(size)
    odd = _ODD[place % 4] * (2 * place + 1).astype(np.uint64)
    total = np.zeros(max(len(run) - size + 1, 0), np.uint64)
    for k in range(size):
        total += run[k : k + len(total)] * odd[k]
    total = _mixed(total)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= size:
            out.append(np.unique(total[at : at + n - size + 1]))
        elif n:
            short = run[at : at + n] * odd[:n]
            out.append(_mixed(np.array([short.sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _parts(values: Iterator[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for v in values:
        part.append(v)
        size += len(v)
        if size > AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def frequent(docs: DataFrame, size: int, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur and how often about, sorted by shingle; they only order the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(texts(batch)):
                sets = {s.tobytes(): s for s in shingle_sets(part, size)}
                if sets:
                    token, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    on = n > 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token[on].view(np.int64)), pa.array(n[on])], ["token", "n"]
                    )

    counted = docs.select("text").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where("n > 2").orderBy(F.desc("n"), "token").limit(ranked).toArrow()
    token = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["n"].to_numpy()[order]


def prefix_length(n: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """How many of its first shingles a set of ``n`` is listed under."""
    return n - -(-numerator * n // denominator) + COMMON


def described(
    docs: DataFrame, ranks: tuple[np.ndarray, np.ndarray], size: int, numerator: int, denominator: int
) -> DataFrame:
    """Per document: ``key`` of its text, set size, signature of the set, its prefix in the global order."""
    heavy, weight = ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at = 0
            for part in _parts(texts(batch, "text")):
                n, sig, prefix = [], [], []
                for s in shingle_sets(part, size):
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if len(heavy) and len(s):
                        spot = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        s = s[np.lexsort((s, np.where(heavy[spot] == s, weight[spot], 0)))]
                    listed = prefix_length(len(s), numerator, denominator) if len(s) else 0
                    prefix.append(s[:listed].view(np.int64))
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(prefix, pa.list_(pa.int64()))],
                    ["doc_id", "key", "n", "sig", "prefix"],
                )

    narrow = docs.select("doc_id", "text", digest().alias("key"))
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("sig", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
    ])
    return narrow.mapInArrow(tidy(run), schema)


def _need(n: Column, m: Column, numerator: int, denominator: int) -> Column:
    """Shingles that sets of these sizes must share."""
    return F.ceil(F.lit(numerator) * (n + m) / F.lit(numerator + denominator) - F.lit(1e-9))


def _room(n: Column, i: Column, m: Column, j: Column, among: int, numerator: int, denominator: int) -> Column:
    """Sizes n, m whose shingle at places i, j is one of the first ``among`` they share can still reach the overlap."""
    least, most = F.least(n, m), F.greatest(n, m)
    left = among + F.least(n - i - 1, m - j - 1)
    return (denominator * least >= numerator * most) & (left >= _need(n, m, numerator, denominator))


def _often(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough listed shingles; a row of ``pairs`` is one of them."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "need")
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
    return counted.where(F.col("c") >= F.least(F.lit(COMMON), "need")).select("a", "b")


def overlap_needed(n: int, m: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    return -(-numerator * (n + m) // (numerator + denominator))


def divide_skip(
    query: np.ndarray, sets: list[np.ndarray], numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> list[int]:
    """Places of the sets that share enough shingles with the query."""
    need = [overlap_needed(len(query), len(s), numerator, denominator) for s in sets]
    # inverted lists of the query's shingles, each in order of the candidates
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    on = query[at] == tokens
    order = np.argsort(at[on], kind="stable")
    listed, ends = owner[on][order], np.cumsum(np.bincount(at[on], minlength=len(query)))
    lists = sorted((x for x in np.split(listed, ends[:-1]) if len(x)), key=len)
    # a candidate misses at most as many short lists as there are long ones
    least = min(need, default=0)
    n_long = int(least / (0.01 * math.log2(max(len(lists[-1]) if lists else 1, 1) + 1) + 1))
    n_long = max(0, min(n_long, least - 1, len(lists)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    count: dict[int, int] = {}
    for c in heapq.merge(*(x.tolist() for x in short)):
        count[c] = count.get(c, 0) + 1
    out = []
    for c, seen in count.items():
        if seen < need[c] - n_long:
            continue
        left = n_long
        for x in long:
            if seen >= need[c] or seen + left < need[c]:
                break
            spot = np.searchsorted(x, c)
            seen += int(spot < len(x) and x[spot] == c)
            left -= 1
        if seen >= need[c]:
            out.append(c)
    return sorted(out)


def _filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of the keys; 512 pieces of 8 KB however many keys there are."""
    piece = FILTER_BITS // 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot in batch.column(0).to_pylist():
                bits.setdefault(slot // piece, np.zeros(piece, np.uint8))[slot % piece] = 1
        for k, b in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(b).tobytes()])], ["piece", "bits"])

    slots = keys.select(F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("slot"))
    by_piece = slots.repartition(64, F.expr(f"slot div {piece}"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in by_piece.mapInArrow(tidy(run), "piece long, bits binary").collect():
        first = r["piece"] * piece // 8
        out[first : first + piece // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def sets_of(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """``keys`` (key, node) with the ``shingles`` (sorted, binary) of the texts that have these keys."""
    bits = _filter(keys)
    slot = F.pmod(F.xxhash64(digest()), F.lit(FILTER_BITS))
    narrow = docs.select(digest().alias("key"), slot.alias("slot"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(1).to_numpy()
            on = np.flatnonzero(bits[slots // 8] >> (7 - slots % 8) & 1)
            first = dict(zip(reversed(batch.column(0).take(pa.array(on)).to_pylist()), reversed(on.tolist())))
            chosen = batch.take(pa.array(sorted(first.values()), pa.int64()))  # copies in a batch are one
            at = 0
            for part in _parts(texts(chosen)):
                sets = pa.array([s.tobytes() for s in shingle_sets(part, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(at, len(part)), sets], ["key", "shingles"])
                at += len(part)

    made = narrow.mapInArrow(tidy(run), "key binary, shingles binary")
    return made.join(keys, "key").dropDuplicates(["key"])  # both by key: one shuffle


def verified(
    docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, numerator: int, denominator: int
) -> DataFrame:
    """The pairs (a, b) that link, found by searching b's block with a as the query."""
    pairs = keep(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keyed = keep(reps.select("node", "key").join(nodes, "node"), "keys")
    sets = keep(sets_of(docs, keyed, size).select("node", "shingles"), "sets")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    # a query that many sets follow is searched block by block
    rows = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).drop("blocks")
    candidates = rows.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "shingles")
    queries = (
        rows.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a")
        .select("a", "block", F.col("a").alias("b"), "shingles")
    )
    task = candidates.union(queries).repartition("a", "block").sortWithinPartitions("a", "block")

    def search(group: list[tuple[int, bytes]], a: int) -> list[int]:
        query = next(np.frombuffer(s, np.uint64) for b, s in group if b == a)
        others = [(b, np.frombuffer(s, np.uint64)) for b, s in group if b != a]
        return [others[k][0] for k in divide_skip(query, [s for _, s in others], numerator, denominator)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            found = []
            for a, block, b, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, block) != now:
                    if group:
                        found += [(now[0], x) for x in search(group, now[0])]
                    now, group = (a, block), []
                group.append((b, shingles))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        if group:
            found = [(now[0], x) for x in search(group, now[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return task.mapInArrow(tidy(run), "a long, b long")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _leader_pairs(rows: DataFrame, first: Column, numerator: int, denominator: int) -> DataFrame:
    """Each list's members with the member that comes first, where they can link and are apart."""
    lead = rows.groupBy("token").agg(
        F.min_by(F.struct(F.col("node").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("other")),
                 F.struct(first, F.col("node"))).alias("lead")
    ).select("token", "lead.*")
    return (
        rows.join(lead, "token")
        .where((F.col("label") != F.col("other"))
               & _room(F.col("n"), F.col("i"), F.col("m"), F.col("j"), COMMON, numerator, denominator))
        .select("a", F.col("node").alias("b"), _need(F.col("n"), F.col("m"), numerator, denominator).alias("need"))
    )


def linked(docs: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """doc_id, n_shingles, component_id, key of the text, node of the component for every row, where sets of shingles of ``size`` words
    link from a similarity of ``numerator / denominator`` on.

    Null and empty texts have the empty set and link with nothing; so each is its own
    component (and has no node). Rows with equal sets are one component. A null id is never the smallest.
    """
    books = keep(described(docs, frequent(docs, size), size, numerator, denominator), "sets")
    reps = (
        books.where("n > 0").groupBy("sig")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("key", "n", "prefix")).alias("one"))
        .select("sig", "first_id", "one.*").withColumn("node", F.monotonically_increasing_id())
    )
    reps = keep(reps, "representatives")
    postings = reps.select("node", "n", F.posexplode("prefix").alias("i", "token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    postings = keep(postings.join(shared, "token", "left_semi"), "postings")

    own = _labelled(postings, None)
    stars = [_often(_leader_pairs(own, by, numerator, denominator)) for by in (F.col("i"), F.xxhash64("node"))]
    stars = keep(stars[0].union(stars[1]).distinct(), "stars")
    links = keep(verified(docs, reps, stars, size, numerator, denominator), "links")
    labels = components(links)

    apart = _labelled(postings, labels)
    split = apart.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    apart = keep(apart.join(split.select("token"), "token", "left_semi"), "apart")
    other = apart.select("token", *[F.col(c).alias(c2) for c, c2 in (("node", "a"), ("n", "m"), ("i", "j"), ("label", "other"))])
    # the first shingle that two sets share leaves the least room; the rest of what they share is counted once
    rest = (
        apart.join(other, "token")
        .where((F.col("a") < F.col("node")) & (F.col("label") != F.col("other"))
               & _room(F.col("n"), F.col("i"), F.col("m"), F.col("j"), 1, numerator, denominator))
        .select("a", F.col("node").alias("b"), _need(F.col("n"), F.col("m"), numerator, denominator).alias("need"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    begin = reps.select("node", "prefix")
    both = rest.join(begin.withColumnsRenamed({"node": "a", "prefix": "p"}), "a").join(
        begin.withColumnsRenamed({"node": "b", "prefix": "q"}), "b")
    enough = F.size(F.array_intersect("p", "q")) >= F.least(F.lit(COMMON), "need")
    rest = keep(both.where(enough).select("a", "b"), "rest")
    if rest.limit(1).count():
        labels = components(links.union(verified(docs, reps, rest, size, numerator, denominator)))

    named = reps.select("sig", "first_id", "node").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_sig = named.join(smallest, "label").select("sig", "component_id", F.col("label").alias("node"))
    return books.join(by_sig, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "key", "node",
    )


def op10_jaccard_join(docs: DataFrame) -> DataFrame:
    return linked(docs, SHINGLE, NUMERATOR, DENOMINATOR).drop("key", "node")
