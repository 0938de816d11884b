"""Quality classifier: an interpolated modified Kneser-Ney model over bytes.

Four-byte counts of trusted texts make the model. Every order is a table keyed
by its gram; contexts, discounts and lower orders come from joins on these keys.
The documents are then scored shard by shard: a shard holds a bounded number of
grams, chosen by their context, and adds the log probability of every position
whose context is its own. A document is kept when its perplexity lies between
quantiles of the trusted texts in its language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import keep, texts

ORDER = 4
#: Grams of the highest order in one shard, the bound of what a task holds of them (about 50 MB).
SHARD = 2_000_000
#: Rows of language bounds that are broadcast; more are joined by shuffle.
LANGUAGES = 10_000
#: Bytes of text handled at once.
AT_ONCE = 8_000_000
#: Quantiles of the trusted perplexities that bound what is kept, and the room beyond them.
LOW, HIGH, ROOM = 0.002, 0.998, 1.05


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte gram that ends at each byte of each text, and the texts' lengths.

    Three zero bytes stand before a text.
    """
    run = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(parts) + b"\0\0\0", np.uint8).astype(np.uint32)
    code = run[:-3] << 24 | run[1:-2] << 16 | run[2:-1] << 8 | run[3:]
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]]).astype(np.int64)
    inside = np.zeros(len(code) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    return code[np.cumsum(inside[:-1]) > 0], lengths


def _batched(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in parts of bounded size, with the place of each part's first."""
    part: list[bytes] = []
    size = first = 0
    for k, text in enumerate(texts(batch)):
        part.append(text)
        size += len(text)
        if size > AT_ONCE:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def counts(trusted: DataFrame) -> DataFrame:
    """Occurrences of each gram in the trusted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _batched(batch):
                code, n = np.unique(grams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["gram", "n"])

    return trusted.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def orders(top: DataFrame) -> dict[int, DataFrame]:
    """Counts per order: occurrences at the top, below it the number of different bytes before a gram."""
    out = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        short = F.col("gram") % F.lit(256**k)
        out[k] = keep(out[k + 1].groupBy(short.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"order{k}")
    return out


def discounts(tables: dict[int, DataFrame]) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order, from how many grams have count 1 to 4."""
    found = {}
    for k, table in tables.items():
        n = table.agg(*[F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4)]).first()
        y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] else 0.0
        found[k] = tuple(
            min(max(c - (c + 1) * y * n[f"n{c + 1}"] / n[f"n{c}"], 0.1), c - 0.05) if n[f"n{c}"] else 0.5 * c
            for c in (1, 2, 3)
        )
    return found


def probabilities(tables: dict[int, DataFrame], d: dict[int, tuple[float, float, float]]) -> dict[int, DataFrame]:
    """Per order: gram, p, and ``back``, the weight its context leaves to the order below."""
    out, below = {}, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = d[k]
        context = (F.expr("gram div 256")).alias("context")
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        sums = tables[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(taken).alias("taken"))
        rows = (
            tables[k].withColumn("context", F.expr("gram div 256")).join(sums, "context")
            .select("gram", ((F.col("n") - taken) / F.col("total")).alias("own"),
                    (F.col("taken") / F.col("total")).alias("back"))
        )
        if below is None:
            rows = rows.select("gram", (F.col("own") + F.col("back") / 256).alias("p"), "back")
        else:
            lower = below.select(F.col("gram").alias("short"), F.col("p").alias("p_below"))
            rows = (
                rows.withColumn("short", F.col("gram") % F.lit(256 ** (k - 1))).join(lower, "short")
                .select("gram", (F.col("own") + F.col("back") * F.col("p_below")).alias("p"), "back")
            )
        below = out[k] = keep(rows, f"p{k}")
    return out


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = rows.toArrow()
    gram = table["gram"].to_numpy()
    order = np.argsort(gram)
    return gram[order], table["p"].to_numpy()[order], table["back"].to_numpy()[order]


class Shard:
    """Log probabilities of positions whose context belongs to one shard.

    Orders 1 and 2 are dense tables; order 3 has at most 256^3 grams.
    """

    def __init__(self, low: dict[int, tuple], top: tuple):
        p1 = np.full(256, 1 / 256)
        if len(low[1][0]):
            p1 = np.full(256, low[1][2][0] / 256)
            p1[low[1][0]] = low[1][1]
        back2 = np.ones(256)
        back2[low[2][0] >> 8] = low[2][2]
        p2 = np.repeat(back2, 256) * np.tile(p1, 256)
        p2[low[2][0]] = low[2][1]
        back3 = np.ones(65536)
        back3[low[3][0] >> 8] = low[3][2]
        self.p2, self.back3 = p2, back3
        self.grams3, self.p3 = low[3][0], low[3][1]
        self.grams4, self.p4 = top[0], top[1]
        at = np.flatnonzero(np.diff(top[0] >> 8, prepend=-1)) if len(top[0]) else np.zeros(0, np.int64)
        self.contexts, self.back4 = top[0][at] >> 8, top[2][at]

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: np.ndarray) -> np.ndarray:
        if not len(keys):
            return missing
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """Of distinct grams."""
        gram = gram.astype(np.int64)
        three = gram & 0xFFFFFF
        p = self._found(self.grams3, self.p3, three, self.back3[three >> 8] * self.p2[gram & 0xFFFF])
        left = self._found(self.contexts, self.back4, gram >> 8, np.ones(len(gram)))
        return np.log(self._found(self.grams4, self.p4, gram, left * p))


def of_shard(gram, shards: int):
    """The shard of a gram's context; the same arithmetic for columns and arrays."""
    return (gram // 256 * 2654435761) % 1048573 % shards


def score(docs: DataFrame, model: dict[int, DataFrame], carry: list[str], shard: int = SHARD) -> DataFrame:
    """The carried columns, ``n_bytes`` and ``log_p`` (natural logarithm) of each whole text."""
    low = {k: _arrays(model[k]) for k in (1, 2, 3)}  # at most 256, 256^2 and 256^3 grams
    shards = max(1, math.ceil(model[ORDER].count() / shard))
    out = docs.select(*carry, "text", F.lit(0).cast("long").alias("n_bytes"), F.lit(0.0).alias("log_p"))
    for k in range(shards):
        part = model[ORDER].where(
            F.expr(f"(gram div 256 * 2654435761L) % 1048573 % {shards}") == k
        )
        out = _visit(out, Shard(low, _arrays(part)), k, shards)
    return out.drop("text")


def _visit(docs: DataFrame, shard: Shard, number: int, shards: int) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, part in _batched(batch):
                code, lengths = grams(part)
                distinct = pa.array(code).dictionary_encode()
                gram = distinct.dictionary.to_numpy()
                log_p = shard.logs(gram)
                if shards > 1:
                    log_p = np.where(of_shard(gram.astype(np.int64), shards) == number, log_p, 0.0)
                n_bytes[first : first + len(part)] = lengths
                total = np.concatenate([[0.0], np.cumsum(log_p[distinct.indices.to_numpy()])])
                ends = np.cumsum(lengths)
                sums[first : first + len(part)] = total[ends] - total[ends - lengths]
            before = batch.column(names.index("log_p")).to_numpy(zero_copy_only=False)
            new = {"n_bytes": pa.array(n_bytes), "log_p": pa.array(before + sums)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)


def classify(
    docs: DataFrame, trusted_ids: DataFrame, low: float = LOW, high: float = HIGH, room: float = ROOM
) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity per byte, the bounds of its language, kept.

    ``trusted_ids`` has one column, doc_id. Null and empty texts have no perplexity
    and are not kept. A language without trusted texts takes the bounds of all of
    them together; without any trusted text nothing is kept.
    """
    narrow = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    trusted_ids = trusted_ids.select("doc_id").dropna().distinct()
    # texts move once by id, whatever the number of trusted ones
    tables = orders(keep(counts(narrow.join(trusted_ids.hint("merge"), "doc_id", "left_semi")), "grams"))
    model = probabilities(tables, discounts(tables))
    scored = keep(score(narrow, model, ["doc_id", "lang"]), "scored")
    scored = scored.withColumn(
        "perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes")))
    )
    sample = scored.where("n_bytes > 0").join(trusted_ids, "doc_id", "left_semi")
    bounds = F.percentile_approx("perplexity", [low, high], 10_000).alias("bounds")
    whole = sample.agg(bounds).first()["bounds"] or [math.inf, -math.inf]
    by_lang = keep(sample.groupBy("lang").agg(bounds), "bounds")
    if by_lang.count() <= LANGUAGES:
        by_lang = F.broadcast(by_lang)
    lower, upper = F.coalesce(F.col("bounds")[0], F.lit(whole[0])), F.coalesce(F.col("bounds")[1], F.lit(whole[1]))
    return (
        scored.join(by_lang, "lang", "left")
        .select(
            "doc_id", "lang", "n_bytes", "perplexity", (lower / room).alias("lower"), (upper * room).alias("upper"),
            F.coalesce(F.col("perplexity").between(lower / room, upper * room), F.lit(False)).alias("kept"),
        )
    )


def op8_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trusted texts are those labelled of good quality."""
    return classify(docs, labels.where("quality = 1").select("doc_id"))
