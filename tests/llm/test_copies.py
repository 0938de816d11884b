"""Packing, suffix-array dedup, Jaccard join and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from obsweave.llm import common, jaccard_join, packing, suffix_dedup
from tests.llm import fixtures

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_packing_is_whole_and_tight(spark):
    rows = packing.op3_best_fit_packing(fixtures.documents(spark)).collect()
    t = tokenizer()
    expected = Counter()
    for doc_id, text, *_ in fixtures.rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        start = piece = 0
        while start < len(ids):
            n = first if piece == 0 else 2048
            raw = np.array(ids[start : start + n], "<u4").tobytes()
            expected[doc_id, piece, start, n, zlib.crc32(raw)] += 1
            start, piece = start + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.op3_best_fit_packing(fixtures.no_documents(spark)).count() == 0


def test_pieces_carry_their_ids(spark):
    import public_tokenizers

    made = packing.pieces(fixtures.documents(spark), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    for r in made.collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 8)))
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        got = packing.fullest(dict(counts), room)
        assert sum(got) == max(sums) and not Counter(got) - counts
        bins = packing.minimum_slack(dict(counts), 30)
        assert sum((Counter({k: v * m for k, v in Counter(b).items()}) for b, m in bins), Counter()) == counts
        assert all(sum(b) <= 30 for b, _ in bins)


def removed(texts, length):
    """Masks of covered bytes, by counting every string."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        on = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                on[k] += 1
                on[k + length] -= 1
        yield np.cumsum(on[:-1]) > 0


def test_suffix_dedup_equals_brute_force(spark):
    rows = fixtures.rows()
    texts = [(r[1] or "").encode() for r in rows]
    expected = Counter()
    for r, t, on in zip(rows, texts, removed(texts, 200)):
        left = np.frombuffer(t, np.uint8)[~on].tobytes()
        spans = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        expected[r[0], len(t), int(on.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    got = suffix_dedup.op9_suffix_array_dedup(fixtures.documents(spark))
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert suffix_dedup.op9_suffix_array_dedup(fixtures.no_documents(spark)).count() == 0


def edited(rng, text):
    """The text with a few bytes changed, dropped or put in."""
    out = bytearray(text)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 2)] = bytes(rng.choices(b"abcd", k=rng.randint(0, 2)))
    return bytes(out)


@pytest.fixture
def small_pieces(spark):
    """Partitions that stay apart, and batches of 40 rows."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "40"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("beside", [1, 2, 16])
def test_repeats_of_many_near_copies(spark, small_pieces, beside):
    """Crowds larger than the suffixes compared, periods, and passages that repeat inside one text, all of them
    across partitions and batches."""
    rng = random.Random(beside)
    base = bytes(rng.choices(b"abcd", k=400))
    texts = {edited(rng, base) for _ in range(60)} | {b"ab" * 150, b"a" * 333, base[:90] * 3 + b"x", base[:29], base[:30], base[50:81]}
    texts |= {bytes(rng.choices(b"abcd", k=200)) + base[k : k + rng.randint(20, 50)] for k in range(0, 300, 11)}
    texts = sorted(texts)
    docs = spark.createDataFrame([(k.to_bytes(16, "little"), t.decode()) for k, t in enumerate(texts)], "key binary, text string")
    got = {int.from_bytes(r["key"], "little"): list(zip(r["starts"], r["ends"])) for r in suffix_dedup.repeated(docs, 30, beside).collect()}
    for k, on in enumerate(removed(texts, 30)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
        assert got.get(k, []) == list(zip(edge[::2], edge[1::2]))


def test_two_near_copies_need_no_fingerprints(spark, monkeypatch):
    """Suffixes next to each other decide every string, edges of repeats too, and few tables are written on the way."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        base = bytes(rng.choices(b"abcdefgh ", k=1500))
        rows += [((2 * k + i).to_bytes(16, "little"), edited(rng, base).decode()) for i in range(2)]
    kept, keep = {}, common.keep

    def noted(df, name):
        kept.setdefault(name, []).append(keep(df, name))
        return kept[name][-1]

    monkeypatch.setattr(suffix_dedup, "keep", noted)
    assert suffix_dedup.repeated(spark.createDataFrame(rows, "key binary, text string").repartition(1)).count() > 60
    assert sum(map(len, kept.values())) <= 4
    (marked,) = kept["marked"]
    known = marked.where("p is null").select((marked["end"] - marked["start"] - 199).alias("n")).groupBy().sum("n").first()[0]
    assert marked.where("p is not null").count() < known / 20


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_suffix_ranks_follow_the_order(spark, rounds):
    rng = random.Random(rounds)
    strings = [(k, [rng.randint(1, 3) for _ in range(rng.randint(0, 30))]) for k in range(25)] + [(90, [2] * 40), (91, [2] * 37)]
    df = spark.createDataFrame(strings, "string long, names array<long>")
    ranks = {r["string"]: r["ranks"] for r in suffix_dedup.suffix_ranks(df, rounds).collect()}
    far = 3**rounds
    order = sorted((ranks[k][i], tuple(n[i : i + far])) for k, n in strings for i in range(len(n)))
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:]))
    assert {k: len(r) for k, r in ranks.items()} == {k: len(n) for k, n in strings if n}


def test_chosen_places_depend_on_the_bytes_around_only():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 400).astype(np.uint64)
    expected = {k + 15 - int(np.argmin(values[k : k + 16][::-1])) for k in range(400 - 15)}
    assert suffix_dedup.chosen(values, 16).tolist() == sorted(expected)


def test_whole_characters_stay_valid():
    text = ("ä" * 10).encode()
    assert suffix_dedup.without(text, [1], [6], True).decode() == "ä" * 8
    assert suffix_dedup.without(text, [1], [6], False) == text[:1] + text[6:]


def joined(rows):
    """Set size and smallest linked id of each row, comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(LOW).split()
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [(r[0], len(s), least.get(root(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join_equals_all_pairs(spark, seed):
    got = jaccard_join.op10_jaccard_join(fixtures.documents(spark, seed))
    assert Counter(tuple(r) for r in got.collect()) == Counter(joined(fixtures.rows(seed)))
    assert jaccard_join.op10_jaccard_join(fixtures.no_documents(spark)).count() == 0


def test_chains_of_near_copies_stay_linked(spark):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(80):  # each changes one word of the one before
        words[rng.randrange(60)] = f"n{k}"
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    got = jaccard_join.op10_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(joined(rows))


def test_divide_skip_equals_intersections():
    rng = np.random.default_rng(7)
    for _ in range(50):
        query = np.unique(rng.integers(0, 80, 40)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(query)) < 0.1, rng.integers(0, 80, len(query)), query)).astype(np.uint64) for _ in range(12)]
        need = [jaccard_join.overlap_needed(len(query), len(s)) for s in sets]
        expected = [k for k, s in enumerate(sets) if len(np.intersect1d(query, s)) >= need[k]]
        assert jaccard_join.divide_skip(query, sets) == expected


def test_components_of_a_path(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 105), (105, 103)]
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 103: 100, 105: 100}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from obsweave.llm import decontaminate, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    labels, bench = common.read(spark, sf_dir, "labels"), common.read(spark, sf_dir, "benchmark")
    bad = {r["doc_id"] for r in toxicity.op1_toxicity(docs, labels).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad}
    rows = {k: rows[k] for k, _, c in joined(list(rows.items())) if c == k}
    left = {}
    for (k, t), on in zip(rows.items(), removed([t.encode() for t in rows.values()], 200)):
        raw, edge = t.encode(), np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
        out = suffix_dedup.without(raw, edge[::2].tolist(), edge[1::2].tolist(), True).decode()
        if out or not raw:
            left[k] = out
    after = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    hit = {r["doc_id"] for r in decontaminate.op5_decontamination(after, bench).where("contaminated").collect()}
    t, expected = tokenizer(), Counter()
    for k, text in left.items():
        if k not in hit:
            ids = t.encode(text, add_special_tokens=False).ids + [0]
            start = 0
            for n in packing.lengths_of(len(ids), 2048):
                expected[k, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
                start += n
    got = p.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == expected


def test_stages_take_nulls_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as p

    for docs in (fixtures.documents(spark), fixtures.no_documents(spark)):
        for name, stage in p.STAGES:
            columns, before = docs.columns, docs.count()
            docs = common.keep(stage(spark, docs, sf_dir), "test")
            if name != "best-fit packing":
                assert docs.columns == columns and docs.count() <= before


def groups(rows, size, percent):
    """Smallest id of each row's group, comparing all pairs on shingles of ``size`` words."""
    sets = []
    for _, text in rows:
        w = text.encode().translate(LOW).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)})
    least = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                least = [least[b] if x == least[a] else x for x in least]
    smallest = {}
    for k, r in enumerate(rows):
        smallest[least[k]] = min(smallest.get(least[k], r[0]), r[0])
    return [smallest[x] for x in least]


def test_near_duplicates_share_five_words_at_80(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    rows = []
    for k in range(30):
        words = [f"d{k}w{i}" for i in range(124)]
        rows.append((2 * k, " ".join(words)))
        if k % 2:  # a block of words that differ
            at, n = rng.randrange(10, 80), rng.randint(6, 12)
            words[at : at + n] = [f"e{i}" for i in range(n)]
        else:  # words that differ here and there
            for at in range(9, 9 + 20 * rng.randint(1, 4), 20):
                words[at] = "edit"
        rows.append((2 * k + 1, " ".join(words)))
    expected = {k for (k, _), g in zip(rows, groups(rows, 5, 80)) if g == k}
    assert expected != {k for (k, _), g in zip(rows, groups(rows, 4, 85)) if g == k}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect()} == expected
    got = jaccard_join.linked(docs, 5, 80, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: g for (k, _), g in zip(rows, groups(rows, 5, 80))}


def test_prefixes_and_overlaps_follow_the_threshold():
    rng = np.random.default_rng(8)
    for _ in range(50):
        query = np.unique(rng.integers(0, 80, 40)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(query)) < 0.12, rng.integers(0, 80, len(query)), query)).astype(np.uint64) for _ in range(12)]
        expected = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 80 * len(np.union1d(query, s))]
        assert jaccard_join.divide_skip(query, sets, 80, 100) == expected
    assert jaccard_join.prefix_length(100, 80, 100) == 20 + jaccard_join.COMMON


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline as p

    texts = {c: [f"{c}{k}" for k in range(150)] for c in "abcd"}
    near = {c: " ".join([*w[:70], "edit", *w[71:]]) for c, w in texts.items()}
    texts = {c: " ".join(w) for c, w in texts.items()}
    rows = [(1, texts["a"]), (2, near["a"]), (2, texts["b"]), (None, texts["c"]), (None, texts["c"]), (None, near["c"]),
            (3, texts["d"]), (3, texts["d"]), (None, near["d"]), (4, ""), (4, None), (5, ""), (6, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], (r["text"] or "").strip()) for r in p.near_duplicates(spark, docs, "").collect())
    one = min(texts["c"], near["c"], key=lambda t: hashlib.sha256(t.encode()).digest()[:16])
    assert got == Counter([(1, texts["a"]), (2, texts["b"]), (None, one), (3, texts["d"]), (4, ""), (5, ""), (6, "")])


def test_two_runs_can_be_read_one_after_the_other(spark, sf_dir):
    import corpus_pipeline as p

    first, second = p.run(spark, sf_dir), p.run(spark, sf_dir)
    rows = [sorted(map(tuple, r.collect())) for r in (first, second)]
    assert rows[0] == rows[1]
    # every sequence is filled from 0 without gaps, and no further than it may be
    by = {}
    for r in first.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048


def test_near_duplicates_keep_every_column(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a", "b", "c"), (2, text, "d", "e", "f"), (3, None, "g", "h", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, row string, all string")
    got = p.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
