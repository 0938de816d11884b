"""Removal of repeated passages by a distributed suffix array of the text that can repeat.

Equal documents are one. Anchors, places chosen by the bytes around them alone, are
dealt so that every string of 200 bytes has one of its own: the least of the
fingerprints inside it. Equal strings have equal anchors at the same place, so

1. text none of whose anchors' bytes occur twice cannot repeat and goes no further,
2. the suffixes at the other anchors are sorted by their bytes, as far as the strings
   of 200 bytes around them reach, and among equals by the bytes before them,
3. suffixes next to each other are compared, forwards and backwards: a string
   repeats if a neighbour shares its bytes after the anchor and before it.

A string whose bytes after the anchor are shared by more suffixes than are compared,
and that none of these settles, is looked up by its own 64-bit fingerprint.

``suffix_ranks`` ranks all suffixes of any strings of numbers (difference cover of 3).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import KEPT, digest, drop_kept, keep, texts, tidy
from obsweave.llm.jaccard_join import FILTER_BITS, _filter

LENGTH = 200
#: Bytes of an anchor as a share of ``LENGTH``. A longer anchor tells more text apart but needs more of them:
#: one is the least among the rest of ``LENGTH``.
ANCHOR_GRAM = 0.4
#: Suffixes on either side that one is compared with.
BESIDE = 16
#: Bytes of the texts whose anchors are chosen in one go.
PIECE = 1 << 16

_TABLE = np.random.default_rng(20_240_901).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; a task computes them for its longest text."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Prints:
    """64-bit polynomial fingerprints of substrings of one text."""

    def __init__(self, text: bytes):
        run = np.frombuffer(text, np.uint8)
        up, self.down = _powers(len(run) + 1)
        self.sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(_TABLE[run] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        at = np.arange(max(n, 0))
        return self.of(at, at + size)


def least(values: np.ndarray, among: int) -> np.ndarray:
    """The place of the least of every ``among`` consecutive values, the last of equals."""
    if len(values) < among:
        return np.zeros(0, np.int64)
    # by doubling: (value, -place) pairs compare by value first
    low, place, width = values.copy(), np.arange(len(values)), 1
    while width < among:
        step = min(width, among - width)
        n = len(low) - step
        later = low[step : step + n] <= low[:n]
        place = np.where(later, place[step : step + n], place[:n])
        low = np.where(later, low[step : step + n], low[:n])
        width += step
    return place


def chosen(values: np.ndarray, among: int) -> np.ndarray:
    """Places that hold the least of some ``among`` consecutive values, the last of equals."""
    on = np.zeros(len(values), bool)
    on[least(values, among)] = True
    return np.flatnonzero(on)


def anchors(bodies: list[bytes], length: int, share: float) -> tuple[np.ndarray, ...]:
    """Anchors of the strings of ``length`` bytes of some texts: the text's number, the place in it, how far after a
    string's start it lies at least and at most, its fingerprint."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    gram = max(1, int(length * share))
    values = Prints(b"".join(bodies)).windows(gram)
    at = least(values, length - gram + 1)
    row = np.repeat(np.arange(len(bodies)), sizes)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[row])  # strings lie in one text
    row, at = row[start], at[start]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at))[: len(first)] - 1
    row, at = row[first], at[first]
    return row, at - (ends - sizes)[row], at - start[last], at - start[first], values[at]


def together(bodies: Iterator[bytes], size: int = PIECE) -> Iterator[list[bytes]]:
    """Neighbouring texts, some ``size`` bytes at a time."""
    out, n = [], 0
    for body in bodies:
        out.append(body)
        n += len(body)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def anchor_rows(docs: DataFrame, length: int, share: float) -> DataFrame:
    """``gram``, ``doc`` (64 bits of the text's key; second places in one text get another), ``key``, ``spot``
    (place, least and greatest distance from a string's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, rows, spots, done = [], [], [], 0
            for part in together(texts(batch)):
                row, at, low, high, values = anchors(part, length, share)
                grams.append(values)
                rows.append(row + done)
                spots.append(at << 32 | low << 16 | high)
                done += len(part)
            if not sum(map(len, rows)):
                continue
            gram, row = np.concatenate(grams), np.concatenate(rows)
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)[::2][row]
            _, first = np.unique(gram ^ row.astype(np.uint64) * np.uint64(_BASE), return_index=True)
            again = np.ones(len(row), bool)
            again[first] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(own ^ again), batch.column(0).take(pa.array(row)),
                 pa.array(np.concatenate(spots))],
                ["gram", "doc", "key", "spot"],
            )

    return docs.select("key", "text").mapInArrow(tidy(run), "gram long, doc long, key binary, spot long")


def shared_anchors(docs: DataFrame, length: int, share: float) -> DataFrame:
    """``key``, ``spots`` of anchors whose bytes also stand elsewhere; rows of equal texts meet here."""
    rows = keep(anchor_rows(docs, length, share), "anchors")
    written = KEPT[-1]
    shared = rows.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
    spots = (
        rows.select("gram", "key", "spot").join(shared.select("gram"), "gram", "left_semi")
        .groupBy("key").agg(F.collect_set("spot").alias("spots"))
    )  # a text has at most one place per byte
    spots = keep(spots, "places")
    drop_kept(docs.sparkSession, [written])
    return spots


_SUFFIX = ["key", "at", "low", "high", "right", "left"]


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """``key``, ``at``, ``low``, ``high``, ``right``, ``left``: a row for every anchor whose bytes also stand elsewhere.

    ``right`` holds the bytes from ``at`` on and ``left`` those before it, backwards, as far as the strings of
    this anchor reach; they start ``low`` to ``high`` bytes before it. Of places in one text with the same
    strings one is sorted; all of them get a row without ``right``, as they repeat.
    """
    spots = shared_anchors(docs, length, ANCHOR_GRAM)
    bits = _filter(spots)
    slot = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(2).to_numpy()
            on = bits[slots // 8] >> (7 - slots % 8) & 1
            yield batch.take(pa.array(np.flatnonzero(on))).select(["key", "text"])

    read = docs.select("key", "text", slot.alias("slot")).mapInArrow(tidy(maybe), "key binary, text string")
    read = read.dropDuplicates(["key"]).join(spots, "key")
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(begin, 1000), []
                for key, spots_, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch)):
                    seen: dict[tuple[bytes, bytes], tuple | None] = {}
                    for spot in spots_:
                        at, low, high = spot >> 32, spot >> 16 & 0xFFFF, spot & 0xFFFF
                        sides = text[at : at + length - low], text[at - high : at][::-1]
                        if sides in seen:
                            for known in ((key, at, low, high), seen[sides]):
                                if known:
                                    out.append((*known, None, None))
                            seen[sides] = None
                        else:
                            seen[sides] = key, at, low, high
                            out.append((key, at, low, high, *sides))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _SUFFIX)

    return read.select("key", "text", "spots").mapInArrow(
        tidy(run), "key binary, at int, low int, high int, right binary, left binary")


# --- the suffix array of a collection of strings ---------------------------------


class Flat:
    """The names of a batch of strings in one array: which string each is in, its place, the string's length."""

    def __init__(self, batch: pa.RecordBatch, column: str = "names"):
        lists = batch.column(batch.schema.get_field_index(column))
        self.sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
        self.names = lists.flatten().to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.string = batch.column(0).to_numpy()[self.row]
        self.i = np.arange(len(self.names)) - self.starts[self.row]
        self.left = self.sizes[self.row] - self.i

    def after(self, values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Values ``k`` places after the places ``at``, 0 beyond the end of the string."""
        return np.where(k < self.left[at], values[np.minimum(at + k, len(values) - 1)], 0) if len(at) else at

    def lists(self, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([self.starts, [len(values)]]), pa.int32()), pa.array(values))


def _rows(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def less_than(rows: DataFrame, keys: list[str], kinds: int) -> DataFrame:
    """Adds ``less0``, ``less1``: how many rows of each ``kind`` have smaller keys, in one distributed sort.

    Equal keys may fill many partitions: ties are dealt by place, and the counts
    before a run of equal keys are carried from where it began. Per partition only
    its counts and its first and last key come to the driver.
    """
    spark = rows.sparkSession
    order = [*keys, "string", "i"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    less = [f"less{k}" for k in range(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, base, last = TaskContext.get().partitionId(), np.zeros(kinds, np.int64), np.zeros(kinds, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
            kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            fresh = np.ones(key.shape[1], bool)
            fresh[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            fresh[0] = last is None or bool((key[:, 0] != last).any())
            counts = []
            group = np.cumsum(fresh)
            for k in range(kinds):
                before = seen[k] + np.cumsum(kind == k) - (kind == k)
                starts = np.concatenate([[base[k]], before[fresh]])
                counts.append(starts[group])
                base[k] = starts[-1]
                seen[k] += int((kind == k).sum())
            last = key[:, -1].copy()
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in ("string", "i", "kind", *keys)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *(pa.array(c) for c in counts), pa.array(np.full(len(kind), part))],
                ["string", "i", "kind", *keys, *less, "part"],
            )

    schema = ", ".join(f"{c} long" for c in ("string", "i", "kind", *keys, *less, "part"))
    local = keep(ranged.mapInArrow(tidy(run), schema), "ranged")
    key = F.struct(*keys)
    summary = local.groupBy("part").agg(
        F.min(key).alias("first"), F.max(key).alias("last"),
        *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(kinds)],
        *[F.max(f"less{k}").alias(f"m{k}") for k in range(kinds)],
    ).orderBy("part").collect()  # a row per partition
    offsets, total, run_key, run_base = [], [0] * kinds, None, [0] * kinds
    for r in summary:
        # rows of the first key have less 0 here; their true count is where their run began
        same = run_key is not None and tuple(r["first"]) == run_key
        offsets.append((r["part"], *total, *(run_base if same else total), *r["first"]))
        if not (same and tuple(r["last"]) == run_key):
            run_base = [total[k] + r[f"m{k}"] for k in range(kinds)]
            run_key = tuple(r["last"])
        total = [total[k] + r[f"n{k}"] for k in range(kinds)]
    if not offsets:
        return local.select("string", "i", "kind", *less)
    columns = ["part", *(f"t{k}" for k in range(kinds)), *(f"b{k}" for k in range(kinds)), *(f"f_{k}" for k in keys)]
    table = F.broadcast(spark.createDataFrame(offsets, ", ".join(f"{c} long" for c in columns)))
    is_first = F.lit(True)
    for k in keys:
        is_first = is_first & (F.col(k) == F.col(f"f_{k}"))
    return local.join(table, "part").select(
        "string", "i", "kind",
        *[F.when(is_first, F.col(f"b{k}")).otherwise(F.col(f"t{k}") + F.col(f"less{k}")).alias(f"less{k}") for k in range(kinds)],
    )


def _gathered(rows: DataFrame, value: str, names: str) -> DataFrame:
    """Rows (string, i, value) as one array per string, in order of i."""
    both = F.array_sort(F.collect_list(F.struct("i", value)))
    return rows.groupBy("string").agg(F.transform(both, lambda x: x[value]).alias(names))


def suffix_ranks(strings: DataFrame, rounds: int) -> DataFrame:
    """``string``, ``ranks``: for each place, how many suffixes of all strings are smaller.

    ``strings`` has ``string`` and ``names`` (positive). Suffixes are told apart as
    far as 3^``rounds`` names; those equal so far share their rank. Strings without
    names have no row.
    """

    before = len(KEPT)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flat(batch)
            at = np.flatnonzero(f.i % 3 != 0)
            triple = [f.after(f.names, at, k) for k in range(3)]
            yield _rows([f.string[at], f.i[at], np.zeros(len(at)), *triple], ["string", "i", "kind", "x", "y", "z"])

    triples = strings.mapInArrow(sampled, "string long, i long, kind long, x long, y long, z long")
    named = less_than(triples, ["x", "y", "z"], 1).withColumn("name", F.col("less0") + 1)
    if rounds > 1:
        # the names at places 1, 4, 7 ... and at 2, 5, 8 ... are strings of their own
        shorter = _gathered(
            named.select((F.col("string") * 2 + F.col("i") % 3 - 1).alias("string"), F.expr("i div 3").alias("i"), "name"),
            "name", "names")
        deeper = suffix_ranks(keep(shorter, "names"), rounds - 1)
        named = deeper.select("string", F.posexplode("ranks").alias("k", "rank")).select(
            F.expr("string div 2").alias("string"),
            (3 * F.col("k") + F.col("string") % 2 + 1).cast("long").alias("i"), (F.col("rank") + 1).alias("name"))
    sample = _gathered(named, "name", "sample")
    whole = keep(strings.join(sample, "string", "left"), "merge")

    def with_sample(batch: pa.RecordBatch) -> tuple[Flat, np.ndarray]:
        """The strings, and at the sampled places their rank among the sampled suffixes (from 1)."""
        f = Flat(batch)
        rank = np.zeros(len(f.names), np.int64)
        rank[f.i % 3 != 0] = batch.column(batch.schema.get_field_index("sample")).flatten().to_numpy()
        return f, rank

    def against(step: int, width: int):
        """Places 0 and ``step`` of three by ``width`` names and the rank after them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, rank = with_sample(batch)
                at = np.flatnonzero((f.i % 3 == 0) | (f.i % 3 == step))
                keys = [f.after(f.names, at, k) for k in range(width)] + [f.after(rank, at, width)]
                yield _rows([f.string[at], f.i[at], f.i[at] % 3 != 0, *keys], ["string", "i", "kind", *"xy"[:width], "r"])

        return run

    parts = []
    for step, width in ((1, 1), (2, 2)):
        keys = [*"xy"[:width], "r"]
        rows = whole.mapInArrow(against(step, width), ", ".join(f"{c} long" for c in ("string", "i", "kind", *keys)))
        counted = less_than(rows, keys, 2)
        parts.append(counted.select("string", "i", F.lit(step).cast("long").alias("step"), "less0", "less1"))
    merged = (
        parts[0].union(parts[1]).groupBy("string")
        .agg(F.collect_list(F.struct("i", "step", "less0", "less1")).alias("counts"))
        .join(whole, "string").select("string", "names", "sample", "counts")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, rank = with_sample(batch)
            lists = batch.column(batch.schema.get_field_index("counts"))
            at, step, less0, less1 = (lists.flatten().field(c).to_numpy() for c in ("i", "step", "less0", "less1"))
            at = at + np.repeat(f.starts, np.diff(lists.offsets.to_numpy()))
            zero = f.i[at] % 3 == 0
            full = np.where(f.i % 3 != 0, rank - 1, 0)  # smaller among the sampled
            np.add.at(full, at, np.where(~zero | (step == 1), less0, 0))  # the remaining ones that are smaller
            np.add.at(full, at[zero], less1[zero])  # sampled ones that are smaller, by both sorts
            yield pa.RecordBatch.from_arrays([batch.column(0), f.lists(full)], ["string", "ranks"])

    ranks = keep(merged.mapInArrow(finish, "string long, ranks array<long>"), "ranks")
    drop_kept(strings.sparkSession, [p for p in KEPT[before:-1]])  # what led to the ranks
    return ranks


# --- what adjacent suffixes share -------------------------------------------------


def table_of(column: pa.Array, sizes: np.ndarray, width: int) -> np.ndarray:
    """The bytes of each row, filled up to ``width``."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros((len(column), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = data
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes rows share at their beginning."""
    unlike = a != b
    return np.where(unlike.any(axis=1), unlike.argmax(axis=1), a.shape[1])


def settled(
    right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, beside: int, first: bool, last: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of suffixes in order (a column per distance from their start to the anchor): those that
    repeat, those left open, those that repeat and may have to stand for others' open ones.

    Unless these are the ``first`` or the ``last`` suffixes, ``beside`` rows at that end lack neighbours and
    their answers do not count.
    """
    n, width, far = len(low), left.shape[1], 1 << 30
    before, after = np.zeros((2, n, width + 2), np.int16)  # where runs of repeats begin and end
    whole = np.zeros(n, bool)
    near = np.minimum(common(right[:-1], right[1:]), length - np.maximum(low[:-1], low[1:]))
    run, reach = near, {}
    for d in range(1, beside + 1):
        if d > 1:  # in sorted order the least on the way is what both share
            run = np.minimum(run[: max(n - d, 0)], near[d - 1 :])
        # suffixes further away share less: how much is not known at either end
        reach[d] = np.maximum(
            np.concatenate([np.full(min(d, n), far if first else 0), run[: max(n - d, 0)]]),
            np.concatenate([run[: max(n - d, 0)], np.full(min(d, n), far if last else 0)]))
        i = np.flatnonzero(run + np.minimum(high[: len(run)], high[d:]) >= length)
        i = i[~(whole[i] & whole[i + d])]
        if not len(i):
            continue
        least_, most = length - run[i], common(left[i], left[i + d])
        for x, side in ((i, after), (i + d, before)):
            a, b = np.maximum(least_, low[x]), np.minimum(np.minimum(most, high[i]), high[i + d])
            on = a <= b
            side[x[on], a[on]] += 1
            side[x[on], b[on] + 1] -= 1
            whole[x] |= (a == low[x]) & (b == high[x])
    at = np.arange(width + 1)
    own = (at >= low[:, None]) & (at <= high[:, None])
    by_before = np.cumsum(before, axis=1)[:, :-1] > 0
    known = by_before | (np.cumsum(after, axis=1)[:, :-1] > 0)
    crowd = lambda d: at >= (length - reach[d])[:, None]
    return known, own & ~known & crowd(beside), known & ~by_before & crowd(max(1, beside // 2))


def compared(rows: DataFrame, length: int, beside: int) -> DataFrame:
    """``key``, ``start``, ``end`` of bytes that repeat; with ``p`` (a fingerprint), a string that is ``open``, or
    one that repeats (``open`` 0)."""
    ordered = rows.repartitionByRange("right", "left", "key", "at").sortWithinPartitions("right", "left", "key", "at")
    gram = max(1, int(length * ANCHOR_GRAM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(table: pa.RecordBatch, skip: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            at, low, high = (table.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
            right, left = table_of(table.column(4), length - low, length), table_of(table.column(5), high, length - gram)
            marks = settled(right, left, low, high, length, beside, first, last)
            mine = np.zeros(len(at), bool)
            mine[skip : len(at) if last else len(at) - beside] = True
            known, open_, stands = (m & mine[:, None] for m in marks)
            edge = np.diff(known.astype(np.int8), axis=1, prepend=0, append=0)
            row, a = np.nonzero(edge == 1)
            b = np.nonzero(edge == -1)[1] - 1
            parts = [(row, at[row] - b, at[row] - a + length, None, None)]
            # the strings to look up, from the bytes on both sides of their anchors
            asked = np.flatnonzero((open_ | stands).any(axis=1))
            if len(asked):
                lefts, rights = table.column(5).take(pa.array(asked)).to_pylist(), table.column(4).take(pa.array(asked)).to_pylist()
                prints = Prints(b"".join(x[::-1] + y for x, y in zip(lefts, rights)))
                sizes = high[asked] + length - low[asked]
                anchor = np.cumsum(sizes) - sizes + high[asked]
                for marked, is_open in ((open_, 1), (stands, 0)):
                    k, back = np.nonzero(marked[asked])
                    p = prints.of(anchor[k] - back, anchor[k] - back + length).view(np.int64)
                    begin = at[asked[k]] - back
                    parts.append((asked[k], begin, begin + length, p, np.full(len(k), is_open)))
            for row, begin, end, p, is_open in parts:
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).take(pa.array(row)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.nulls(len(row), pa.int64()) if p is None else pa.array(p),
                     pa.nulls(len(row), pa.int32()) if is_open is None else pa.array(is_open.astype(np.int32))],
                    ["key", "start", "end", "p", "open"],
                )

        held, skip, first = None, 0, True
        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([x, y]) for x, y in zip(held.columns, batch.columns)], batch.schema.names)
            if batch.num_rows - skip > 3 * beside:
                yield from judge(batch, skip, first, False)
                batch, skip, first = batch.slice(batch.num_rows - 2 * beside), beside, False
            held = batch
        if held is not None and held.num_rows:
            yield from judge(held, skip, first, True)

    return ordered.mapInArrow(tidy(run), "key binary, start int, end int, p long, open int")


def repeated(docs: DataFrame, length: int = LENGTH, beside: int = BESIDE) -> DataFrame:
    """``key``, ``starts``, ``ends``: bytes covered by a string of ``length`` bytes that starts elsewhere,
    among distinct texts. Only texts with such bytes have a row."""
    rows = keep(suffixes(docs, length), "suffixes")
    marked = keep(compared(rows.where("right is not null").select(*_SUFFIX), length, beside), "marked")
    asked = marked.where("p is not null")
    twice = asked.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open")).where("n > 1 and open = 1")
    spans = (
        marked.where("p is null").select("key", "start", "end")
        .union(asked.where("open = 1").join(twice.select("p"), "p", "left_semi").select("key", "start", "end"))
        .union(rows.where("right is null").select("key", F.expr("at - high"), F.expr(f"at - low + {length}")))
        .groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [union(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(1), batch.column(2))]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in both], lists) for k in range(2))], ["key", "starts", "ends"])

    return spans.mapInArrow(tidy(run), "key binary, starts array<long>, ends array<long>")


def union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of intervals that overlap or touch."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


def without(text: bytes, starts: list[int], ends: list[int], whole_characters: bool) -> bytes:
    """The text without its spans; on demand a span gives up the characters it only partly holds."""
    out, at = [], 0
    for a, b in zip(starts, ends):
        if whole_characters:
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
        out.append(text[at:a])
        at = max(at, b)
    return b"".join([*out, text[at:]])


def deduplicated(
    docs: DataFrame, carry: list[str], length: int = LENGTH, whole_characters: bool = False
) -> DataFrame:
    """The carried columns, ``n_bytes``, ``starts``, ``ends`` and ``kept`` (binary) of every row.

    Null text is empty. Texts shorter than ``length`` repeat nothing. Of equal texts of
    at least that length every one goes whole, repeated rows too.
    """
    keyed = docs.select(*carry, *([] if "text" in carry else ["text"]), digest().alias("key"))
    copies = keep(
        docs.select(digest().alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    spans = keep(repeated(docs.select(digest().alias("key"), "text").where("text is not null"), length), "spans")
    facts = copies.select("key", F.lit(True).alias("copied")).join(spans, "key", "full")
    rows = keyed.join(facts, "key", "left")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(names.index(c)).to_pylist()  # noqa: B023, E731
            n, out = [], []
            for text, copied, a, b in zip(texts(batch), get("copied"), get("starts"), get("ends")):
                a, b = a or [], b or []
                if copied and len(text) >= length:
                    a, b = [0], [len(text)]
                n.append(len(text))
                out.append((a, b, without(text, a, b, whole_characters)))
            columns = list(zip(*out)) if out else [()] * 3
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in carry), pa.array(n, pa.int64()), pa.array(columns[0], lists),
                 pa.array(columns[1], lists), pa.array(columns[2], pa.binary())],
                [*carry, "n_bytes", "starts", "ends", "kept"],
            )

    schema = T.StructType([
        *(keyed.schema[c] for c in carry),
        *T.StructType.fromDDL("n_bytes long, starts array<long>, ends array<long>, kept binary").fields,
    ])
    return rows.mapInArrow(tidy(run), schema)


def op9_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return deduplicated(docs, ["doc_id"]).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
