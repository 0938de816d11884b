"""Periodic runs in a text's words: a suffix automaton whose last-occurrence paths are recoloured by link-cut access.

Appending a word makes every suffix of the text so far end here. In the tree of
suffix links these suffixes are one path to the root, and ``access`` of the
link-cut tree cuts it into segments of equal previous end. A segment of strings up
to length L whose previous end lies p words back says that the last L words equal
the L words p earlier; if p lies within the segment's lengths, a square of period p
ends here, p is its smallest period, and no longer match exists, so start and
period name the run and its last square gives the end.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import texts

POWER, LEAST = 4, 6
GRAM = 3
RUNS = "array<struct<start:long,length:long,period:long>>"
_SMALL = 1 << 15


class _Runs:
    """Suffix automaton of a growing word sequence, its suffix-link tree held as splay trees of paths.

    States have one transition in two arrays; only branching states own a
    dictionary. The last end of a path is stored at the root of its splay tree.
    """

    def __init__(self, n: int, power: int, least: int):
        size = 2 * n + 2
        new = (lambda: [0] * size) if n <= _SMALL else (lambda: array("i", bytes(4 * size)))
        self.longest, self.link, self.word, self.to = new(), new(), new(), new()
        self.left, self.right, self.up, self.end = new(), new(), new(), new()
        self.more: dict[int, dict[int, int]] = {}
        self.states, self.last, self.n = 2, 1, 0  # state 1 is the root, 0 none
        self.power, self.least = power, least
        self.found: dict[tuple[int, int], int] = {}

    def _step(self, state: int, word: int) -> int:
        """Target of a transition, 0 without one; ``word`` counts from 1."""
        if self.word[state] == word:
            return self.to[state]
        own = self.more.get(state)
        return own.get(word, 0) if own else 0

    def _set(self, state: int, word: int, target: int) -> None:
        at = self.word[state]
        if at == 0 or at == word:
            self.word[state], self.to[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; its path's end moves along."""
        left, right, up = self.left, self.right, self.up
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            turns = (x,)
            if inner:
                turns = (y, x) if (left[z] == y) == (left[y] == x) else (x, x)
            for a in turns:  # rotate a above its parent
                b = up[a]
                c = up[b]
                if left[b] == a:
                    kid = left[b] = right[a]
                    right[a] = b
                else:
                    kid = right[b] = left[a]
                    left[a] = b
                if kid:
                    up[kid] = b
                up[a], up[b] = c, a
                if c:
                    if left[c] == b:
                        left[c] = a
                    elif right[c] == b:
                        right[c] = a
                    else:
                        self.end[a] = self.end[b]
                else:
                    self.end[a] = self.end[b]

    def _extend(self, word: int) -> int:
        """Add a word; returns the state of the whole text."""
        longest, link = self.longest, self.link
        new = self.states
        self.states += 1
        longest[new] = self.n + 1
        p = self.last
        while p and not self._step(p, word):
            self._set(p, word, new)
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = self._step(p, word)
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                link[new] = self._split(p, word, q)
        self.up[new] = link[new]
        self.last = new
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter strings of ``q``; in the tree it goes between q and its parent, in q's path."""
        longest, link = self.longest, self.link
        copy = self.states
        self.states += 1
        longest[copy] = longest[p] + 1
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self._splay(q)
        above = self.left[q]
        self.left[copy] = above
        if above:
            self.up[above] = copy
        self.left[q], self.up[copy] = copy, q
        link[copy], link[q] = link[q], copy
        while p and self._step(p, word) == q:
            self._set(p, word, copy)
            p = link[p]
        return copy

    def append(self, word: int) -> None:
        """Add a word, note every long enough repetition that ends with it."""
        x = self._extend(word)
        i = self.n
        self.n += 1
        left, right, up, end, longest = self.left, self.right, self.up, self.end, self.longest
        below = 0
        while x:
            self._splay(x)
            cut = right[x]
            if cut:
                end[cut] = end[x]
            right[x] = below
            above = up[x]
            before = end[x]  # counts from 1
            if before:
                period = i + 1 - before
                length = longest[x]
                if longest[above] < period <= length and length + period >= max(self.least, self.power * period):
                    self.found[before - length, period] = i
            below, x = x, above
        end[below] = i + 1


def runs_of(words: Sequence[int], power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``power`` (2 or more) periods and ``least`` words, in order."""
    machine = _Runs(len(words), power, least)
    for w in words:
        machine.append(w + 1)
    return sorted((s, last - s + 1, p) for (s, p), last in machine.found.items())


def stretches(ids: np.ndarray, power: int = POWER, least: int = LEAST) -> list[tuple[int, int]]:
    """Disjoint stretches [from, to) that hold every run, and the words beside it, whole.

    After its first period a run of period q consists of grams of (mostly) three
    words that occurred at most q words before, at least (power - 1) q - 2 of them
    in a row. Where grams are new, or recur from too far back for the length of
    their row, there is no run, and most texts end here.
    """
    n = len(ids)
    if n < least:
        return []
    spare = min(max(least, power * q) - q for q in range(1, least + 1))  # words of the shortest run after its first period
    width = max(1, min(GRAM, spare))
    gram = ids
    for k in range(1, width):
        gram = np.unique(gram[:-1] * n + ids[k:], return_inverse=True)[1]  # numbers below n, as the words have
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    back = np.full(len(gram), n, dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    least_row = spare - width + 1
    good = back < n
    for _ in range(16):  # each round only removes what cannot be in a run
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        first, stop = edge[::2], edge[1::2]
        size = stop - first
        room = np.where(size >= least_row, (size + width - 1) // (power - 1), 0)
        limit = np.zeros(len(gram), dtype=np.int64)
        if len(first):
            limit[good] = np.repeat(room, size)
        fits = good & (back <= limit)
        if (fits == good).all():
            break
        good = fits
    out: list[tuple[int, int]] = []
    for a, b, r in zip(first.tolist(), stop.tolist(), room.tolist()):
        if not r:
            continue
        a, b = max(0, a - r - 1), min(n, b + width)
        while out and a <= out[-1][1]:  # a long row reaches back over several short ones
            a, b = min(a, out[-1][0]), max(b, out.pop()[1])
        out.append((a, b))
    return out


def text_runs(words: Sequence, power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs of one text's words, each stretch that can hold one by its own automaton."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    out = []
    for a, b in stretches(ids, power, least):
        own: dict[int, int] = {}
        part = [own.setdefault(w, len(own)) for w in ids[a:b].tolist()]
        out.extend((a + s, length, p) for s, length, p in runs_of(part, power, least))
    return sorted(out)


def kept_words(words: list, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words that no run repeats."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def periodic_runs(docs: DataFrame, text: str = "text", power: int = POWER, least: int = LEAST) -> DataFrame:
    """``docs`` without its text, plus ``n_words``, ``runs`` (array of start, length, period) and the ``collapsed`` text.

    A row is decided alone: no shuffle, and hot sources or copies change nothing.
    Time is n log n and memory linear in the words of the longest text.
    """
    others = [c for c in docs.columns if c != text]
    # own names cannot clash inside one struct
    wrapped = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    schema = f"row {wrapped.schema['row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, kept = [], [], []
            for body in texts(batch):
                words = body.split()
                runs = text_runs(words, power, least)
                counts.append(len(words))
                found.append([dict(zip(names, r)) for r in runs])
                kept.append(b" ".join(kept_words(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "runs", "collapsed"],
            )

    return wrapped.mapInArrow(run, schema).select("row.*", "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; by its id's checksum every tenth text repeats a stretch of its words up to its end."""
    gaps = F.lit(" \t\n\x0b\f\r")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changes = (h % 10 == 0) & (F.btrim("text", gaps) != "")
    n, a, g = F.size("words"), F.col("a"), F.col("g")
    times = F.ceil((n - a) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, F.col("p")), times))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), a), again), F.lit(1), n)
    return (
        docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.coalesce(changes, F.lit(False)).alias("changes"))
        .withColumn("words", F.when(F.col("changes"), F.split(F.btrim("text", gaps), r"[\x20\x09-\x0D]+")))
        .withColumn("a", F.pmod(g, n).cast("int"))
        .withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
        .select("doc_id", F.when(F.col("changes"), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
    )


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest exponent, and digests of all runs and of the text without repetitions.

    Null and empty texts have no words and no runs. Ties of the exponent go to the
    smallest start, then the smallest period; they are compared exactly, not by the
    rounded figure. Repeated rows each get their row, a null doc_id changes nothing
    in its text, other columns are not read, an empty table gives an empty result.
    """
    found = periodic_runs(planted(docs))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))

    def better(x: Column, y: Column) -> Column:
        one, two = x["length"] * y["period"], y["length"] * x["period"]
        return y["length"].isNotNull() & (x["length"].isNull() | (two > one))  # runs come by start, then period

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda x, y: F.when(better(x, y), y).otherwise(x))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
