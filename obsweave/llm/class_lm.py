"""Language-model scores by Brown classes.

``p(w | v) = p(class(w) | class(v)) * p(w | class(w))``. The corpus is encoded once
into chunks (word numbers and the chunk's own word list), so every later pass is
arithmetic on numbers. Exchange clustering runs over the counted pairs of the
most frequent words: each step asks for a share of the words which class would raise
the likelihood most, and moves them. Every other word then starts in the
class that its own neighbours make likeliest. From there all words are exchanged: in
each round one shuffle by word brings together how often every chunk has a word and
beside which classes, moves a share of the words, and sends each chunk
the counts and classes of its own words; nothing of the size of the vocabulary
is held in one place. Words travel in blocks: what one chunk has to say of one bucket of words is a row. A last pass counts the class pairs that the scores use.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import KEPT, LOWER, drop_kept, held, keep, texts, tidy
from obsweave.plans.session import small_batches

CLASSES = 48
#: Words exchanged among themselves first, most frequent first, so that all others start beside known classes.
EXCHANGED = 2000
#: Steps, and how many steps visit every word once: words that move together do not see each other move.
SWEEPS, SHARES = 8, 4
#: Rounds over all words, each moving one of as many shares of them.
ROUNDS = 2
#: Shares of the chunks that are joined to their answers one after the other, which bounds the shuffled bytes.
TOLD_PARTS = 4
CHUNK_TOKENS = 2_000_000
#: Words of chunks, and their neighbours, in half a bucket of the word table.
WORD_ROWS = 300_000
#: Bits of a chunk's number within its partition (33 billion tokens) and of a word's place within its chunk;
#: 25 remain for the partition.
CHUNK_BITS, PLACE_BITS = 14, 24
#: Words held as Python objects before they are packed.
PACK_WORDS = 100_000
#: Counts of neighbours in a bucket that are added up before more are taken in.
FOLD = 1_000_000
#: Weight of the class unigrams in the transitions.
PRIOR = 20.0


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return text.translate(LOWER).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def encoded(docs: DataFrame, modulus: int, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of whole documents: ids, held-out marks, words per document, word numbers, the
    64-bit hashes of the chunk's words, and how often each occurs in its training texts."""
    narrow = docs.select("doc_id", "text", held("doc_id", modulus).alias("held_out"))
    doc_type = narrow.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << CHUNK_BITS, 0
        ids: list = []
        held_out: list[bool] = []
        lengths: list[int] = []
        words: list[bytes] = []
        packed: list[pa.Array] = []

        def chunk(doc_arrow) -> pa.RecordBatch:
            coded = pa.concat_arrays([*packed, pa.array(words, pa.binary())]).dictionary_encode()
            tokens = coded.indices.to_numpy().astype(np.int32)
            # frequent words get small numbers, which store better
            n = np.bincount(tokens, minlength=len(coded.dictionary))
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            tokens = place[tokens]
            training = np.repeat(~np.array(held_out, bool), lengths)
            seen = np.bincount(tokens[training], minlength=len(order))
            names = _hashes(coded.dictionary.to_pylist())[order]
            row = {
                "chunk": pa.array([first + made]), "ids": pa.array([ids], pa.list_(doc_arrow)),
                "held_out": pa.array([held_out], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "tokens": pa.array([tokens.tobytes()], pa.binary()),
                "words": pa.array([names], pa.list_(pa.int64())),
                "seen": pa.array([seen], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        doc_arrow, n_words = None, 0
        for batch in batches:
            doc_arrow = batch.schema.field(0).type
            for doc_id, is_held, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch)):
                own = words_of(text)
                ids.append(doc_id)
                held_out.append(is_held)
                lengths.append(len(own))
                words += own
                n_words += len(own)
                if len(words) >= PACK_WORDS:
                    packed.append(pa.array(words, pa.binary()))
                    words = []
                if n_words >= chunk_tokens:
                    yield chunk(doc_arrow)
                    made += 1
                    ids, held_out, lengths, words, packed, n_words = [], [], [], [], [], 0
        if ids:
            yield chunk(doc_arrow)

    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(doc_type)),
        T.StructField("held_out", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("seen", T.ArrayType(T.LongType())),
    ])
    return narrow.mapInArrow(tidy(run), schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time, arrays as numpy."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                value = column[k]
                if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                    inner = value.values
                    row[name] = inner if name == "ids" or inner is None else inner.to_numpy(zero_copy_only=False)
                elif name == "tokens":
                    row[name] = np.frombuffer(value.as_buffer(), np.int32)
                else:
                    row[name] = value.as_py()
            yield row


def _with_ends(values: np.ndarray, lengths: np.ndarray, end) -> np.ndarray:
    """The documents' tokens, each followed by an end, and one end before the first."""
    stops = np.cumsum(lengths.astype(np.int64) + 1)
    out = np.empty(len(values) + len(lengths) + 1, values.dtype)
    inside = np.ones(len(out), bool)
    inside[0] = inside[stops] = False
    out[0] = out[stops] = end
    out[inside] = values
    return out


def _training(row: dict, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values and lengths of the training documents of a chunk."""
    on = ~row["held_out"].astype(bool)
    return values[np.repeat(on, row["lengths"])], row["lengths"][on]


def _lookup(sorted_names: np.ndarray, values: np.ndarray, names: np.ndarray, other: int) -> np.ndarray:
    """Value of each name, ``other`` where it is not listed."""
    if not len(sorted_names):
        return np.full(len(names), other, np.int64)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return np.where(sorted_names[at] == names, values[at], other)


def _counted(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(codes, minlength=size)
    at = np.flatnonzero(n)
    return at, n[at]


def frequent_pairs(chunks: DataFrame, names: np.ndarray) -> DataFrame:
    """Counts of neighbours in training texts; numbers are places in ``names``, then other words, then ends."""
    k = len(names)
    order = np.argsort(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            number = _lookup(names[order], order, row["words"], k).astype(np.int32)
            values, lengths = _training(row, row["tokens"])
            line = _with_ends(number[values], lengths, k + 1)
            codes, n = _counted(line[:-1].astype(np.int64) * (k + 2) + line[1:], 0)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    counts = chunks.select("held_out", "lengths", "tokens", "words").mapInArrow(tidy(run), "code long, n long")
    counts = counts.groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(F.expr(f"code div {k + 2}").alias("v"), F.expr(f"code % {k + 2}").alias("w"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(
    left: np.ndarray, right: np.ndarray, loops: np.ndarray, own: np.ndarray, between: np.ndarray, classes: int
) -> np.ndarray:
    """The class of each word that gives the class bigrams the greatest likelihood, all else as it is.

    ``left`` and ``right`` count a word's neighbours by class without itself, ``loops``
    counts it next to itself, ``own`` is its class now, ``between`` counts the classes'
    pairs. Classes from ``classes`` on are fixed and take no word.
    """
    out = own.copy()
    for i in range(len(own)):
        rest, a = between.astype(float), own[i]
        into, out_of, loop = left[i].astype(float), right[i].astype(float), float(loops[i])
        rest[a, :] -= out_of
        rest[:, a] -= into
        rest[a, a] -= loop
        total_in, total_out = into.sum() + loop, out_of.sum() + loop
        # the neighbours' sides of the word's pairs stay wherever it goes
        rows, columns = rest.sum(axis=1) + into, rest.sum(axis=0) + out_of
        gain = (_xlogx(rest + out_of[None, :]) - _xlogx(rest)).sum(axis=1)
        gain += (_xlogx(rest + into[:, None]) - _xlogx(rest)).sum(axis=0)
        corner = rest.diagonal()
        gain += (
            _xlogx(corner + into + out_of + loop) - _xlogx(corner + into) - _xlogx(corner + out_of) + _xlogx(corner)
        )
        gain -= _xlogx(rows + total_out) - _xlogx(rows) + _xlogx(columns + total_in) - _xlogx(columns)
        out[i] = int(np.argmax(gain[:classes]))
    return out


def exchange(pairs: DataFrame, k: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of ``k`` words; other words and ends are classes of their own (``classes``, ``classes`` + 1)."""
    spark = pairs.sparkSession
    c2 = classes + 2
    label = np.concatenate([np.arange(k) % max(1, min(classes, k)), [classes, classes + 1]]).astype(np.int64)
    for sweep in range(sweeps):
        known = F.broadcast(spark.createDataFrame(  # k + 2 rows
            [(i, int(c)) for i, c in enumerate(label)], "id long, c long"))
        by_class = (
            pairs.join(known.withColumnsRenamed({"id": "v", "c": "cv"}), "v")
            .join(known.withColumnsRenamed({"id": "w", "c": "cw"}), "w")
        )
        by_class = keep(by_class, "swept")
        between = np.zeros((c2, c2))
        for r in by_class.groupBy("cv", "cw").agg(F.sum("n").alias("n")).collect():  # classes squared
            between[r["cv"], r["cw"]] = r["n"]
        other = F.col("v") != F.col("w")
        sides = (
            by_class.where(other).select(F.col("w").alias("id"), F.lit(0).alias("side"), F.col("cv").alias("c"), "n")
            .union(by_class.where(other).select(F.col("v").alias("id"), F.lit(1), F.col("cw"), "n"))
            .union(by_class.where(~other).select(F.col("v").alias("id"), F.lit(2), F.lit(0).cast("long"), "n"))
            .where((F.col("id") < k) & (F.pmod(F.xxhash64("id"), F.lit(SHARES)) == sweep % SHARES))
            .groupBy("id", "side", "c").agg(F.sum("n").alias("n"))
        )

        def moved(batches: Iterator[pa.RecordBatch], label=label, between=between) -> Iterator[pa.RecordBatch]:
            found = [b for b in batches if b.num_rows]
            if not found:
                return
            table = pa.Table.from_batches(found)
            ids, row = np.unique(table["id"].to_numpy(), return_inverse=True)
            side, c, n = (table[x].to_numpy() for x in ("side", "c", "n"))
            around = np.zeros((3, len(ids), c2))
            np.add.at(around, (side, row, c), n)
            best = best_classes(around[0], around[1], around[2, :, 0], label[ids], between, classes)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["id", "c"])

        for r in sides.repartition("id").mapInArrow(moved, "id long, c long").collect():  # at most k rows
            label[r["id"]] = r["c"]
    return label


def best_by_neighbours(between: np.ndarray, classes: int):
    """One step of the exchange for words outside it, with the classes' statistics held fixed."""
    step = np.log((between + 1) / (between + 1).sum(axis=1, keepdims=True))  # from, to
    size = np.log(between.sum(axis=0)[:classes] + 1)

    def best(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        gain = left @ step[:, :classes] + right @ step[:classes].T
        return (gain - left.sum(axis=1, keepdims=True) * size).argmax(axis=1)

    return best


def places(chunk: int, n: int) -> np.ndarray:
    """Numbers of a chunk's words, unlike those of any other chunk."""
    return chunk << PLACE_BITS | np.arange(n)


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word, by the upper half of its hash; the lower bits choose its share."""
    return ((words.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _beside(own: np.ndarray, before: np.ndarray, after: np.ndarray, c2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each word stands between which classes. The code of a pair is ``before * c2 + after``. A word with
    more pairs than two sides have classes counts its sides apart: c2 * c2 + before, and c2 * c2 + c2 + after."""
    pairs, n = np.unique((own.astype(np.int64) * c2 + before) * c2 + after, return_counts=True)
    word, code = np.divmod(pairs, c2 * c2)
    hot = np.bincount(word) > 2 * c2
    if not hot.any():
        return word, code, n
    apart = hot[word]
    words, mine = np.flatnonzero(hot), np.cumsum(hot) - 1
    around = _around(mine[word[apart]], code[apart], n[apart], len(words), c2).ravel()
    at = np.flatnonzero(around)
    return (
        np.concatenate([word[~apart], words[at // (2 * c2)]]), np.concatenate([code[~apart], c2 * c2 + at % (2 * c2)]),
        np.concatenate([n[~apart], around[at].astype(np.int64)]),
    )


def _cells(own: np.ndarray, code: np.ndarray, n: np.ndarray, c2: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a table of the classes before and after each word, and the counts that belong there."""
    first, code = own.astype(np.int64) * (2 * c2), code.astype(np.int64) - c2 * c2
    pair = code < 0
    before, after = np.divmod(code[pair] + c2 * c2, c2)
    return (
        np.concatenate([first[pair] + before, first[pair] + c2 + after, first[~pair] + code[~pair]]),
        np.concatenate([n[pair], n[pair], n[~pair]]),
    )


def _around(own: np.ndarray, code: np.ndarray, n: np.ndarray, size: int, c2: int) -> np.ndarray:
    """For each of ``size`` words how often each class is before, then after it, from codes of ``_beside``."""
    at, n = _cells(own, code, n, c2)
    return np.bincount(at, n, size * 2 * c2).reshape(size, 2 * c2)


_BLOCK = "bucket int, chunk long, word binary, place binary, n binary, own binary, code binary, beside binary"
_BLOCK_TYPES = {"word": np.int64, "place": np.int64, "n": np.int64, "own": np.int32, "code": np.int16, "beside": np.int32}


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each of some consecutive pieces."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all pieces in a row, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data else np.zeros(0, kind)
    return values, np.diff(offsets) // np.dtype(kind).itemsize


def _blocks(row: dict, buckets: int, n: np.ndarray, own: np.ndarray, code: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
    """What a chunk says of each bucket: its words, their places and ``n``; and how often (``beside``) its word
    ``own``, by the place in the block, stands between which classes (``code``)."""
    words = row["words"]
    bucket = bucket_of(words, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    by = np.argsort(bucket[own], kind="stable")
    own, code, beside = own[by], code[by], beside[by]
    beside_sizes = np.bincount(bucket[own], minlength=buckets)
    own = rank[own] - (np.cumsum(sizes) - sizes)[bucket[own]]
    values = {"word": words[order], "place": places(row["chunk"], len(words))[order], "n": n[order], "own": own, "code": code, "beside": beside}
    on = np.flatnonzero(sizes)
    columns = {
        "bucket": pa.array(on.astype(np.int32)), "chunk": pa.array(np.full(len(on), row["chunk"], np.int64)),
        **{c: _packed(v.astype(_BLOCK_TYPES[c]), (sizes if k < 3 else beside_sizes)[on]) for k, (c, v) in enumerate(values.items())},
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class _Bucket:
    """All chunks' blocks of one bucket. Counts of neighbours are added up from time to time, so that
    a word of every chunk weighs no more than its classes."""

    def __init__(self, c2: int):
        self.c2, self.limit, self.size, self.pending = c2, FOLD, 0, 0
        self.parts: dict[str, list] = {c: [] for c in ("chunk", "sizes", *_BLOCK_TYPES)}

    def add(self, block: pa.RecordBatch) -> None:
        column = lambda c: block.column(block.schema.get_field_index(c))
        found = {c: _unpacked(column(c), kind) for c, kind in _BLOCK_TYPES.items()}
        sizes, beside_sizes = found["word"][1], found["own"][1]
        first = self.size + np.cumsum(sizes) - sizes
        new = {c: values for c, (values, _) in found.items()}
        new |= {"chunk": column("chunk").to_numpy(), "sizes": sizes, "own": new["own"] + np.repeat(first, beside_sizes)}
        for c, values in new.items():
            self.parts[c].append(values.copy())  # lets go of the batch
        self.size += len(new["word"])
        self.pending += len(new["own"])
        if self.pending > self.limit:
            self.fold()

    def values(self, c: str) -> np.ndarray:
        self.parts[c] = [np.concatenate(self.parts[c])]
        return self.parts[c][0]

    def fold(self) -> None:
        """A count per word and class on each side; a word is named by the first of its places."""
        _, first, row = np.unique(self.values("word"), return_index=True, return_inverse=True)
        at, n = _cells(first[row[self.values("own")]], self.values("code"), self.values("beside"), self.c2)
        cells, spot = np.unique(at, return_inverse=True)
        own, side = np.divmod(cells, 2 * self.c2)
        code = (self.c2 * self.c2 + side).astype(_BLOCK_TYPES["code"])
        self.parts |= {"own": [own], "code": [code], "beside": [np.bincount(spot, n).astype(np.int64)]}
        self.pending = len(own)
        self.limit = max(FOLD, 2 * len(own))

    def joined(self) -> dict:
        """``row`` and ``own`` are places in ``words`` (distinct, sorted)."""
        out = {c: self.values(c) for c in ("sizes", "place", "n", "own", "code", "beside")}
        out["words"], out["row"] = np.unique(self.values("word"), return_inverse=True)
        out["own"] = out["row"][out["own"]]
        out["chunks"] = pa.array(self.values("chunk"))
        return out


def _by_bucket(batches: Iterator[pa.RecordBatch], c2: int) -> Iterator[dict]:
    """One bucket at a time, all chunks' blocks in a row."""
    open_bucket, bucket = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for begin, end in zip(cuts, cuts[1:]):
            if open_bucket and of[begin] != bucket:
                found = open_bucket.joined()
                open_bucket = None
                yield found
                del found
            open_bucket, bucket = open_bucket or _Bucket(c2), of[begin]
            open_bucket.add(batch.slice(begin, end - begin))
    if open_bucket:
        yield open_bucket.joined()


_ANSWER = "chunk long, place binary, answer binary, n long"


def _answers(found: dict, answer: np.ndarray) -> pa.RecordBatch:
    """The answers to a bucket's words, a row per chunk."""
    columns = [found["chunks"], _packed(found["place"], found["sizes"]), _packed(answer[found["row"]].astype(np.int64), found["sizes"]),
               pa.array(np.zeros(len(found["sizes"]), np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "place", "answer", "n"])


def word_rows(chunks: DataFrame, names: np.ndarray, label: np.ndarray, classes: int, buckets: int) -> DataFrame:
    """Blocks: how often the training texts of a chunk have its words, and, for words outside the exchange,
    how often they stand between which classes."""
    k, c2 = len(names), classes + 2
    order = np.argsort(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = row["words"]
            number = _lookup(names[order], order, words, k)
            values, lengths = _training(row, row["tokens"])
            line = _with_ends(label[number].astype(np.int16)[values], lengths, classes + 1)
            at = np.flatnonzero(line == classes)
            word = _with_ends(values, lengths, -1)[at]
            yield _blocks(row, buckets, row["seen"], *_beside(word, line[at - 1], line[at + 1], c2))

    return chunks.select("chunk", "held_out", "lengths", "tokens", "words", "seen").mapInArrow(tidy(run), _BLOCK)


#: Kinds of statistics that the word table reports beside its answers, as negative chunks.
TYPES, ONCE, TWICE, IN_CLASS = range(1, 5)


def gathered(rows: DataFrame, buckets: int) -> DataFrame:
    """The blocks of each bucket next to each other."""
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def answered(rows: DataFrame, buckets: int, names: np.ndarray, label: np.ndarray, best, classes: int) -> DataFrame:
    """``place`` and ``answer`` (training count times 256, class) for every word of every chunk, in blocks."""
    c2, order = classes + 2, np.argsort(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_bucket(batches, c2):
            words, row = found["words"], found["row"]
            total = np.bincount(row, found["n"], minlength=len(words)).astype(np.int64)
            c = _lookup(names[order], label[: len(names)][order], words, -1)
            # words outside the exchange, some thousands at a time
            others = np.flatnonzero(c < 0)
            spot = np.full(len(words), -1)
            spot[others] = np.arange(len(others))
            mine = spot[found["own"]]
            by = np.argsort(mine)
            mine, code, m = mine[by], found["code"][by], found["beside"][by]
            for first in range(0, len(others), 8192):
                part = others[first : first + 8192]
                low, high = np.searchsorted(mine, [first, first + 8192])
                around = _around(mine[low:high] - first, code[low:high], m[low:high], len(part), c2)
                c[part] = best(around[:, :c2].copy(), around[:, c2:].copy())
            yield _answers(found, total * 256 + np.maximum(c, 0))

    return gathered(rows, buckets).mapInArrow(tidy(run), _ANSWER)


def best_of_many(
    left: np.ndarray, right: np.ndarray, loops: np.ndarray, own: np.ndarray, between: np.ndarray, classes: int
) -> np.ndarray:
    """``best_classes`` for many words at once, in time that grows with the classes beside them."""
    each = np.arange(len(own))
    total_in, total_out = left.sum(axis=1) + loops, right.sum(axis=1) + loops
    rows, columns = (np.tile(between.sum(axis=k).astype(float), (len(own), 1)) for k in (1, 0))
    rows[each, own] -= total_out
    columns[each, own] -= total_in
    gain = _xlogx(rows) - _xlogx(rows + total_out[:, None]) + _xlogx(columns) - _xlogx(columns + total_in[:, None])
    for side, other, counts in ((right, left, between.T), (left, right, between)):
        word, c = np.nonzero(side)
        if not len(word):
            continue
        n, a = side[word, c], own[word]
        rest = counts[c].astype(float)
        rest[np.arange(len(word)), a] -= n
        same = np.flatnonzero(c == a)
        rest[same] -= other[word[same]]
        rest[same, a[same]] -= loops[word[same]]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[first]] += np.add.reduceat(_xlogx(rest + n[:, None]) - _xlogx(rest), first, axis=0)
    corner = np.tile(between.diagonal().astype(float), (len(own), 1))
    corner[each, own] -= left[each, own] + right[each, own] + loops
    gain += (
        _xlogx(corner + left + right + loops[:, None]) - _xlogx(corner + left) - _xlogx(corner + right) + _xlogx(corner)
    )
    return gain[:, :classes].argmax(axis=1)


def _told(row: dict) -> np.ndarray:
    """The answers of a chunk's words, in their order."""
    if row["known"] is None:
        return np.zeros(0, np.int64)
    known = np.frombuffer(b"".join(row["known"]), np.int64)
    out = np.zeros(len(known), np.int64)
    out[np.frombuffer(b"".join(row["at"]), np.int64) & (1 << PLACE_BITS) - 1] = known
    return out


def _part(chunk: str) -> Column:
    return F.pmod(F.xxhash64(chunk), F.lit(TOLD_PARTS)).cast("int")


def told(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks next to the answers to their words, written once; a share of the chunks is shuffled at a time.

    A file holds one chunk, and a chunk's ``part`` says in which share it is: no task holds, and no share reads, more than its own.
    """
    out = []
    if "part" not in chunks.columns:
        chunks = chunks.withColumn("part", _part("chunk"))
    for part in range(TOLD_PARTS):
        by_chunk = answers.where("chunk >= 0").where(_part("chunk") == part).groupBy("chunk").agg(
            F.collect_list("place").alias("at"), F.collect_list("answer").alias("known"))
        own = chunks.where(F.col("part") == part).drop("seen", "at", "known", "part")
        out.append(keep(own.join(by_chunk, "chunk", "left"), "told", 1).withColumn("part", F.lit(part)))
    return functools.reduce(DataFrame.unionAll, out)


def class_pairs(known: DataFrame, classes: int) -> np.ndarray:
    """Counts of class pairs in training texts: rows and columns are classes, then words seen once
    (a row of their own beside their class's; no column), then ends."""
    c2 = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            answer = _told(row)
            values, lengths = _training(row, row["tokens"])
            line = _with_ends((answer & 0xFF).astype(np.int16)[values], lengths, classes + 1)
            once = _with_ends((answer >> 8 == 1)[values], lengths, False)[:-1]
            codes = line[:-1].astype(np.int32) * c2 + line[1:]
            at, n = _counted(np.concatenate([codes, classes * c2 + line[1:][once]]), 0)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["code", "n"])

    counts = known.select("held_out", "lengths", "tokens", "at", "known").mapInArrow(tidy(run), "code long, n long")
    out = np.zeros(c2 * c2)
    for r in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():  # classes squared
        out[r["code"]] = r["n"]
    return out.reshape(c2, c2)


def neighbour_rows(known: DataFrame, share: int, shares: int, classes: int, buckets: int) -> DataFrame:
    """Blocks: the answers so far to a chunk's words, and, for the words of one share, how often they stand
    between which classes. Class ``classes`` stands for the word itself."""
    c2 = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, answer = row["words"], _told(row)
            values, lengths = _training(row, row["tokens"])
            line = _with_ends((answer & 0xFF).astype(np.int16)[values], lengths, classes + 1)
            word = _with_ends(values, lengths, -1)
            visited = np.append(words.view(np.uint64) % np.uint64(shares) == share, False)  # -1 is an end
            at = np.flatnonzero(visited[word])
            own = word[at]
            before = np.where(word[at - 1] == own, classes, line[at - 1])
            after = np.where(word[at + 1] == own, classes, line[at + 1])
            yield _blocks(row, buckets, answer, *_beside(own, before, after, c2))

    return known.select("chunk", "held_out", "lengths", "tokens", "words", "at", "known").mapInArrow(tidy(run), _BLOCK)


def exchanged_words(rows: DataFrame, buckets: int, between: np.ndarray, classes: int) -> DataFrame:
    """``place`` and ``answer`` after the words that came with neighbours moved, in blocks, and counts of words
    (``n``) under negative chunks: kind * 65536 + class."""
    c2 = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_bucket(batches, c2):
            answer = np.zeros(len(found["words"]), np.int64)
            answer[found["row"]] = found["n"]  # every chunk was told the same
            total, c = answer >> 8, answer & 0xFF
            by = np.argsort(found["own"])
            mine, code, m = found["own"][by], found["code"][by], found["beside"][by]
            begins = np.flatnonzero(np.diff(mine, prepend=-1))
            visited, ends = mine[begins], np.append(begins, len(mine))
            for first in range(0, len(visited), 1024):  # each may stand beside all classes
                part = visited[first : first + 1024]
                low, high = ends[first], ends[first + len(part)]
                spot = np.searchsorted(part, mine[low:high])
                around = _around(spot, code[low:high], m[low:high], len(part), c2)
                left, right = around[:, :c2].copy(), around[:, c2:].copy()
                loops = left[:, classes].copy()
                left[:, classes] = right[:, classes] = 0
                c[part] = best_of_many(left, right, loops, c[part], between, classes)
            yield _answers(found, total * 256 + c)
            stats = {TYPES << 16: (total > 0).sum(), ONCE << 16: (total == 1).sum(), TWICE << 16: (total == 2).sum()}
            in_class = np.bincount(c[total > 0], minlength=classes)
            keys = np.concatenate([list(stats), (IN_CLASS << 16) + np.arange(classes)]).astype(np.int64)
            sums = np.concatenate([list(stats.values()), in_class]).astype(np.int64)
            nothing = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(-keys), nothing, nothing, pa.array(sums)], ["chunk", "place", "answer", "n"])

    return gathered(rows, buckets).mapInArrow(tidy(run), _ANSWER)


class Scores:
    """Log10 probabilities of the fitted model.

    Every class keeps a share of its emissions for one unknown word (absolute
    discounting), so words, the unknown word and the end sum to 1 in each state.
    """

    def __init__(self, moves: np.ndarray, types: np.ndarray, singles: float, doubles: float, classes: int):
        totals = moves[: classes + 1].sum(axis=0)
        unigram = (totals + 1e-9) / (totals + 1e-9).sum()
        self.step = np.log10((moves + PRIOR * unigram) / (moves.sum(axis=1, keepdims=True) + PRIOR))
        self.discount = singles / (singles + 2 * doubles) if singles else 0.5
        self.size = np.maximum(totals[:classes], 1e-9)
        unknown = self.discount * types / self.size
        unknown[types == 0] = 1.0  # a class without words says the unknown word
        self.unknown = np.log10(np.maximum((10.0 ** self.step[:, :classes]) @ unknown, 1e-300))
        self.classes = classes

    def of(self, n: np.ndarray, c: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each document, its end included."""
        end = self.classes
        word = np.where(n > 0, np.log10(np.maximum(n - self.discount, 1e-9) / self.size[np.maximum(c, 0)]), 0.0)
        line = _with_ends(np.where(n > 0, c, end + 1).astype(np.int16)[tokens], lengths, end)
        emitted = _with_ends(word[tokens], lengths, 0.0)
        state, to = line[:-1], line[1:]
        p = np.where(to == end + 1, self.unknown[state], self.step[state, np.minimum(to, end)] + emitted[1:])
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        return np.bincount(owner, p, minlength=len(lengths))


def fit_and_score(docs: DataFrame, modulus: int = 7, classes: int = CLASSES, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. Repeated rows each train and get a row.
    Without training texts every token has probability 1 of being the unknown word.
    """
    with small_batches(docs.sparkSession):  # a chunk is a batch
        return _fit_and_score(docs, modulus, classes, exchanged, rounds)


def _fit_and_score(docs: DataFrame, modulus: int, classes: int, exchanged: int, rounds: int) -> DataFrame:
    doc_field = docs.schema["doc_id"]
    before = set(KEPT)
    chunks = keep(encoded(docs, modulus).withColumn("part", _part("chunk")), "chunks", 1, ("part",))
    sizes = chunks.agg(
        F.sum(F.size(F.filter("held_out", lambda h: ~h))).alias("ends"),
        F.sum(F.aggregate("seen", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words"),
        F.sum(F.size("words")).alias("rows"),
    ).first()
    ends = sizes["ends"] or 0
    n_all = (sizes["words"] or 0) + ends
    # chunks list their words by frequency: a frequent word is among the first of many
    heads = chunks.select(F.explode(F.arrays_zip(F.slice("words", 1, 10 * exchanged).alias("w"), F.slice("seen", 1, 10 * exchanged).alias("n"))).alias("x"))
    top = (
        heads.select("x.w", "x.n").where("n > 0").groupBy("w").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "w").limit(exchanged).collect()
    )
    names = np.array([r["w"] for r in top], np.int64)
    pairs = keep(frequent_pairs(chunks, names), "pairs")
    label = exchange(pairs, len(names), classes)
    between = _between(pairs, label, classes)
    buckets = max(8, 2 * (sizes["rows"] or 0) // WORD_ROWS)
    rows = word_rows(chunks, names, label, classes, buckets)
    spark = docs.sparkSession
    answers = keep(answered(rows, buckets, names, label, best_by_neighbours(between, classes), classes), "answers")
    for share in range(rounds):
        stale = [p for p in KEPT if p not in before]
        chunks = told(chunks, answers)
        drop_kept(spark, stale)  # the chunks are written anew
        rows = neighbour_rows(chunks, share, rounds, classes, buckets)
        pairs_now = class_pairs(chunks, classes)
        pairs_now[classes] = 0  # words seen once are in their classes
        answers = keep(exchanged_words(rows, buckets, pairs_now, classes), "answers")
    sums: dict[int, dict[int, int]] = {}
    for r in answers.where("chunk < 0").groupBy("chunk").agg(F.sum("n").alias("n")).collect():  # kinds times classes
        kind, key = divmod(-r["chunk"], 65536)
        sums.setdefault(kind, {})[key] = r["n"]
    count = lambda kind: sums.get(kind, {}).get(0, 0)
    n_types = count(TYPES) + (ends > 0)
    types = np.array([sums.get(IN_CLASS, {}).get(c, 0) for c in range(classes)], float)
    stale = [p for p in KEPT if p not in before]
    known = told(chunks, answers)
    drop_kept(spark, stale)
    counted = class_pairs(known, classes)
    # from a class, an end or a word seen once; to a class or an end
    moves = counted[[*range(classes), classes + 1, classes]][:, [*range(classes), classes + 1]]
    scores = Scores(moves, types, count(ONCE), count(TWICE), classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            answer = _told(row)
            n, c = answer >> 8, answer & 0xFF
            tokens, lengths = row["tokens"], row["lengths"].astype(np.int64)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            floor = -np.log10(n_all + n_types + 1)
            base = np.bincount(owner, np.log10(n + 1.0)[tokens], minlength=len(lengths)) + np.log10(ends + 1.0)
            base += (lengths + 1) * floor
            n_known = np.bincount(owner, (n > 0)[tokens], minlength=len(lengths)) + (ends > 0)
            score = scores.of(n, c, tokens, lengths) if ends else np.zeros(len(lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    row["ids"], pa.array(row["held_out"]), pa.array(lengths + 1), pa.array(n_known.astype(np.int64)),
                    pa.array(np.full(len(lengths), n_all, np.int64)), pa.array(base), pa.array(score),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = T.StructType([doc_field, *T.StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    columns = known.select("ids", "held_out", "lengths", "tokens", "at", "known")
    stale = [p for p in KEPT if p not in before]
    out = keep(columns.mapInArrow(tidy(run), schema), "scores")
    drop_kept(spark, stale)
    return out


def _between(pairs: DataFrame, label: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class pairs, other words and ends as classes of their own."""
    spark = pairs.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, c long"))
    rows = (
        pairs.join(known.withColumnsRenamed({"id": "v", "c": "cv"}), "v")
        .join(known.withColumnsRenamed({"id": "w", "c": "cw"}), "w")
        .groupBy("cv", "cw").agg(F.sum("n").alias("n")).collect()
    )
    out = np.zeros((classes + 2, classes + 2))
    for r in rows:
        out[r["cv"], r["cw"]] = r["n"]
    return out


def op4_class_lm(docs: DataFrame) -> DataFrame:
    """``fit_and_score`` of every row; repeated rows each train and get a row, ties of frequency follow the word's hash."""
    return fit_and_score(docs)
