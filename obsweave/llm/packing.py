"""Best-fit packing by minimum bin slack.

Token sequences are cut into pieces no longer than a sequence, and only how many
pieces have each length (at most 2048 numbers, however many documents) decides
the bins: a bin starts with the longest length left, a bitset subset-sum over the
lengths still available finds the fullest feasible combination, and that is
removed, as often as its lengths last. Pieces then take their places by their
number within their length, in parallel.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import give_back, keep, numbered

TOKENS = 2048
END = 0
#: Bytes of text that a task encodes at once; a speed and memory setting, any value gives the same ids.
AT_ONCE = 6_000_000
#: Words in one call of the tokenizer.
JOINED = 2000
#: Between a visible character and a space before one: no token of a byte-level vocabulary crosses it.
SEAM = re.compile(r"(?<=\S)(?= \S)")


#: Printable ASCII and Latin letters: every library agrees on what is a letter there.
LATIN = re.compile(r"[\n!-~\u00c0-\u024f]*")
#: How byte-level vocabularies split a text before they merge. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _token_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary by the bytes its characters stand for: visible Latin-1 ones for themselves,
    the other bytes, in order, for the characters from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t)}


def _merger(path: str):
    """The file's merges in tiktoken, which is several times as fast; None where ids are not in merge order."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    vocabulary, merges = model["vocab"], model["merges"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
    if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    ranks = _token_bytes({t: i for t, i in vocabulary.items() if i < 256 + len(pairs)})
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts from the tokenizer file, each distinct word of a batch encoded once.

    A token holds a space at its start only, so a text falls into its words, each
    with the space before it, and distinct words can be encoded in one joined text:
    a token that starts with the space begins the next word. Latin words are
    merged by tiktoken from the same file, all others by tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.latin = _merger(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _each(self, parts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in done]

    def _after_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words with a space before them; how many each has, and where they begin."""
        latin = np.array([self.latin is not None and LATIN.fullmatch(w) is not None for w in words], bool)
        ids, counts = [], np.zeros(len(words), np.int64)
        for chosen in (np.flatnonzero(latin), np.flatnonzero(~latin)):
            joined = [" " + " ".join([words[w] for w in chosen[k : k + JOINED]]) for k in range(0, len(chosen), JOINED)]
            if latin[chosen].all():
                done = [np.array(self.latin.encode_ordinary(t), "<u4") for t in joined]
            else:
                done = self._each(joined)
            own = np.concatenate([np.zeros(0, "<u4"), *done])
            ids.append(own)
            counts[chosen] = np.diff(np.append(np.flatnonzero(self.begins[own]), len(own)))
        order = np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)])
        sizes = counts[order]
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sizes) - sizes
        return np.concatenate(ids), counts, first

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        split = pc.split_pattern(column, " ")
        coded = split.flatten().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        offsets = np.diff(split.offsets.to_numpy()).cumsum()
        firsts = np.concatenate([[0], offsets[:-1]]) if len(column) else np.zeros(0, np.int64)
        # white space beside a space joins it in one token: such texts are split at other seams
        odd = np.array([not w or w != w.strip() for w in words], bool)[place]
        odd_text = np.add.reduceat(odd, firsts) > 0 if len(firsts) else np.zeros(0, bool)
        plain = np.repeat(~odd_text, np.diff(np.append(firsts, len(place))))
        rest = plain.copy()
        rest[firsts] = False
        used = _present(place[rest], len(words))
        ids, n, begin = self._after_space([words[k] for k in used])
        alone = _present(place[firsts[~odd_text]], len(words))
        odd_parts = [SEAM.split(column[int(k)].as_py()) for k in np.flatnonzero(odd_text)]
        odd_words = sorted({p for parts in odd_parts for p in parts})
        more = self._each([words[k] for k in alone] + odd_words)
        # one table: words after a space, words at the start, parts of odd texts
        table = np.concatenate([ids, *more]) if more else ids
        more_count = np.array([len(x) for x in more], np.int64)
        count = np.concatenate([n, more_count])
        begin = np.concatenate([begin, len(ids) + np.cumsum(more_count) - more_count])
        entry = np.zeros(len(place), np.int64)
        number = np.zeros(len(words), np.int64)
        number[used] = np.arange(len(used))
        entry[rest] = number[place[rest]]
        entry[firsts[~odd_text]] = len(used) + np.searchsorted(alone, place[firsts[~odd_text]])
        spot = {p: len(used) + len(alone) + k for k, p in enumerate(odd_words)}
        lines, text_sizes = [], np.diff(np.append(firsts, len(place)))
        if odd_text.any():
            odd_iter = iter(odd_parts)
            for k, at in enumerate(firsts):
                lines.append(
                    np.array([spot[p] for p in next(odd_iter)], np.int64) if odd_text[k] else entry[at : at + text_sizes[k]]
                )
            entry, text_sizes = np.concatenate(lines), np.array([len(x) for x in lines])
        size = count[entry]
        first = begin[entry]
        take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        stops = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(text_sizes)
        return table[take], stops[ends] - stops[ends - text_sizes]


def _present(numbers: np.ndarray, size: int) -> np.ndarray:
    """The distinct numbers below ``size``, in order."""
    seen = np.zeros(size, bool)
    seen[numbers] = True
    return np.flatnonzero(seen)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def lengths_of(n: int, tokens: int) -> list[int]:
    """Lengths of the pieces of a sequence of ``n`` tokens; only the first may be shorter."""
    if n <= tokens:
        return [n]
    return [n % tokens or tokens] + [tokens] * ((n - 1) // tokens)


def pieces(docs: DataFrame, path: str, tokens: int = TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        give_back()
        encoder, last = Encoder(path), np.array([end], "<u4").tobytes()
        give_back()
        for batch in batches:
            for part in by_bytes(batch, 1, AT_ONCE):
                flat, sizes = encoder.encode(part.column(1))
                raw, at, take, rows = memoryview(flat.astype("<u4").tobytes()), 0, [], []
                for k, size in enumerate(sizes.tolist()):
                    ids, start = bytes(raw[at : at + 4 * size]) + last, 0
                    at += 4 * size
                    for piece, n in enumerate(lengths_of(size + 1, tokens)):
                        own = ids[4 * start : 4 * (start + n)]
                        take.append(k)
                        rows.append((piece, start, n, zlib.crc32(own), own if with_ids else None))
                        start += n
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)][: 5 if with_ids else 4]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays) + 1]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), *arrays], names)

    narrow = docs.select("doc_id", "text")
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    return narrow.mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, no more of each than counted, with the greatest sum up to ``room``.

    Bit s of ``reach`` is set when some choice sums to s. Lengths go in from the
    longest; the states in between lead back to the choice.
    """
    reach, states, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            use = min(size, left)
            after = (reach | reach << (use * length)) & full
            if after != reach:
                states.append((reach, length, use))
                reach = after
            left -= use
            size *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for before, length, use in reversed(states):
        if not before >> at & 1:
            out += [length] * use
            at -= use * length
    return out


def minimum_slack(counts: dict[int, int], tokens: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins look like that)."""
    counts, bins = dict(counts), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = [longest, *fullest(counts, tokens - longest)]
        counts[longest] += 1
        need = {x: chosen.count(x) for x in chosen}
        times = min(counts[x] // n for x, n in need.items())
        bins.append((sorted(chosen, reverse=True), times))
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return bins


def places(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, copies in a bin, first offset), ordered by length and rank.

    Copies of a length lie side by side in a bin, so its ranks fill bin after bin.
    """
    rows, used, bin_id = [], {}, 0
    for chosen, times in bins:
        offset = 0
        for length in dict.fromkeys(chosen):
            n = chosen.count(length)
            rows.append((length, used.get(length, 0), bin_id, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        bin_id += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(made: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """``sequence_id`` and ``offset`` for each row of ``pieces``; every piece is placed once."""
    made = keep(made, "pieces")  # numbers and counts must see the same rows
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `tokens` rows
    table = places(minimum_slack(counts, tokens))
    salts = max(64, sum(counts.values()) // 1_000_000)
    salted = made.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    ranked = numbered(salted, "length", "rank", ["doc_id", "start", "ids_crc32"], "__salt")
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            row = table[np.searchsorted(order, length << 44 | rank, "right") - 1]
            bin_step, slot = np.divmod(rank - row[:, 1], row[:, 3])
            arrays = [batch.column(i) for i, c in enumerate(names) if c != "rank"]
            arrays += [pa.array(row[:, 2] + bin_step), pa.array(row[:, 4] + slot * length)]
            yield pa.RecordBatch.from_arrays(arrays, [c for c in names if c != "rank"] + ["sequence_id", "offset"])

    schema = T.StructType([
        *(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ])
    return ranked.mapInArrow(run, schema)


def op3_best_fit_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's pieces with their places; null text is empty and packs its end token."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(pieces(docs, path)).select(*columns)
