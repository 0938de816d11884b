"""The trained operators: learning, held-out gain, proper probabilities, empty inputs."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from obsweave.llm import class_lm, common, kneser_ney, toxicity
from tests.llm import fixtures


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(5)
    out = []
    for k in range(500):
        words = fixtures.prose(rng, rng.choice([20, 60, 150])).split(" ")
        bad = k % 3 == 0
        if bad:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["moron", "idiot", "scum"])
        out.append((k, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_texts(spark, insults):
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in insults], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in insults], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.op1_toxicity(docs, labels).collect()}
    assert len(rows) == len(insults)
    held = [(rows[k], y) for k, _, y in insults if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held) and len(held) > 80
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    good = [r["score"] for r, y in held if y]
    rest = [r["score"] for r, y in held if not y]
    assert np.mean([a > b for a in good for b in rest]) > 0.95


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.op1_toxicity(fixtures.documents(spark), none).collect()
    assert len(got) == len(fixtures.rows()) and all(r["score"] == 0 for r in got)
    assert toxicity.op1_toxicity(fixtures.no_documents(spark), none).count() == 0


def test_network_gradient_by_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network(5, 1)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    words = [b"one", b"two", b"three", b"x", b"yy", b"two2"]
    pairs, starts = toxicity.pair_segments(words)
    spelled = (pairs, np.append(starts[1:], len(pairs)) - starts)
    own_rows = np.array([0, 1, 2, 3, 5, 5])
    rows = rng.integers(0, 6, (3, 9))
    rows[1, 6:] = -1
    inside = (rows >= 0) & (np.arange(9) > 1) & (np.arange(9) < 7)
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        logit = net.forward(net.project(toxicity.word_inputs(net, own_rows, spelled)), rows, inside)
        return (weight * (np.logaddexp(0, logit) - label * logit)).sum()

    g = toxicity.gradients(net, rows, inside, own_rows, spelled, label, weight)
    assert set(g) == set(net.w)
    for name, grad in g.items():
        near = np.argsort(-np.abs(grad).ravel())[:4]  # the steepest, which differences can tell from rounding
        for at in [np.unravel_index(k, grad.shape) for k in (*near, rng.integers(grad.size))]:
            kept = net.w[name][at]
            ends = []
            for d in (1e-2, -1e-2):
                net.w[name][at] = kept + d
                ends.append(loss())
            net.w[name][at] = kept
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(grad[at], rel=0.03, abs=2e-3), name


def test_every_window_by_reading_each():
    rng = np.random.default_rng(4)
    net = toxicity.Network(5, 1)
    net.w["query"] *= 4
    net.w["out"] *= 10
    gates = np.concatenate([toxicity.NOTHING, net.project(rng.standard_normal((6, toxicity.SIZE)).astype(np.float32))])
    texts = [rng.integers(1, 7, n) for n in (0, 1, 30, 47, 48, 49, 64)]
    best, at = net.every_window(gates, texts)
    for ids, got, first in zip(texts, best, at):
        tried = []
        for s in toxicity.windows_of(len(ids), stride=1):
            inside = (np.arange(len(ids)) >= s) & (np.arange(len(ids)) < s + toxicity.WINDOW)
            tried.append(net.forward(gates, ids[None], inside[None])[0] if len(ids) else net.w["out_bias"][0])
        assert got == pytest.approx(max(tried), abs=1e-4)
        assert tried[first] == pytest.approx(max(tried), abs=1e-4)
    # a passage scores alike wherever it stands in a long text, but for what the passes still hold of words far before
    passage = rng.integers(1, 7, 100)
    quiet = np.ones(400, np.int64)
    scores = [net.every_window(gates, [np.concatenate([quiet[: 100 + k], passage, quiet])])[0][0] for k in range(0, 70, 7)]
    assert max(scores) - min(scores) < 0.02


def test_sliding_sums():
    x = np.random.default_rng(2).random((2, 90))
    for window in (1, 5, 48, 64, 100):
        padded = np.concatenate([x, np.zeros((2, window))], axis=1)
        brute = np.stack([padded[:, k : k + window].sum(axis=1) for k in range(90)], axis=1)
        assert np.allclose(toxicity.sliding(x, window), brute)


def test_windows_cover_every_word():
    for n in (0, 1, 48, 49, 100, 1000):
        starts = toxicity.windows_of(n)
        assert {i for s in starts for i in range(s, min(s + 48, n))} == set(range(n))


def test_class_model_base_columns(spark):
    got = class_lm.op4_class_lm(fixtures.documents(spark))
    words = [(r[0], [*class_lm.words_of((r[1] or "").encode()), None]) for r in fixtures.rows()]
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in words}
    count = Counter(w for k, ws in words if not held[k] for w in ws)
    total, types = sum(count.values()), len(count)
    expected = Counter(
        (k, held[k], len(ws), sum(count[w] > 0 for w in ws), total,
         round(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ws), 6)) for k, ws in words)
    assert expected == Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect())
    rows = got.where("held_out").collect()
    assert all(r["score"] <= 0 for r in rows)
    assert class_lm.op4_class_lm(fixtures.no_documents(spark)).count() == 0


def test_class_model_places_of_late_partitions():
    chunks = [part << class_lm.CHUNK_BITS | made for part in (0, 40_000, 2**25 - 1) for made in (0, 2**class_lm.CHUNK_BITS - 1)]
    seen = [p for c in chunks for p in (class_lm.places(c, 3)[0], class_lm.places(c, 3)[-1])]
    assert min(seen) >= 0 and len(set(seen)) == len(seen)
    assert [int(p) >> class_lm.PLACE_BITS for p in seen[::2]] == chunks


def test_class_model_sums_to_one():
    rng = np.random.default_rng(2)
    classes, words = 4, 40
    label, n = rng.integers(0, classes, words), rng.integers(1, 30, words)
    moves = rng.integers(0, 50, (classes + 2, classes + 1)).astype(float)
    moves[: classes + 1, :classes] *= np.bincount(label, n, classes) / moves[: classes + 1, :classes].sum(axis=0)
    types = np.bincount(label, minlength=classes).astype(float)
    scores = class_lm.Scores(moves, types, 12, 6, classes)
    for state in range(classes + 2):
        known = sum(10 ** scores.step[state, c] * (k - scores.discount) / scores.size[c] for c, k in zip(label, n))
        assert abs(known + 10 ** scores.unknown[state] + 10 ** scores.step[state, classes] - 1) < 1e-6


def information(pairs, label):
    """Mutual information of neighbouring classes."""
    n = np.zeros((label.max() + 1,) * 2)
    for (v, w), c in pairs.items():
        n[label[v], label[w]] += c
    p = n / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(p * np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0))))


def test_exchange_raises_the_likelihood(spark):
    rng = np.random.default_rng(3)
    size = 60  # three groups of words take turns, in words of uneven frequency
    group = rng.permutation(np.arange(size) % 3)
    weight = 1 / (1 + np.arange(size))
    draw = [weight * (group == g) / (weight * (group == g)).sum() for g in range(3)]
    line = [int(rng.choice(size, p=draw[k % 3])) for k in range(6000)]
    pairs = Counter(zip(line[:-1], line[1:]))
    df = spark.createDataFrame([(v, w, n) for (v, w), n in pairs.items()], "v long, w long, n long")
    label = class_lm.exchange(df, size, classes=3, sweeps=12)[:size]
    best, first = information(pairs, group), information(pairs, np.arange(size) % 3)
    assert information(pairs, label) > 0.9 * best > first


def test_best_class_by_trying_all():
    rng = np.random.default_rng(9)
    size, classes = 10, 3
    n = rng.integers(0, 9, (size, size))
    label = rng.integers(0, classes, size)

    def likelihood(label):
        m = np.zeros((classes, classes))
        np.add.at(m, (label[:, None].repeat(size, 1), label[None, :].repeat(size, 0)), n)
        return class_lm._xlogx(m).sum() - class_lm._xlogx(m.sum(axis=0)).sum() - class_lm._xlogx(m.sum(axis=1)).sum()

    between = np.zeros((classes, classes))
    np.add.at(between, (label[:, None].repeat(size, 1), label[None, :].repeat(size, 0)), n)
    off = n * (1 - np.eye(size, dtype=int))
    left, right = np.zeros((2, size, classes))
    for c in range(classes):
        left[:, c], right[:, c] = off[label == c].sum(axis=0), off[:, label == c].sum(axis=1)
    got = class_lm.best_classes(left, right, np.diag(n), label, between, classes)
    for w in range(size):
        tried = []
        for c in range(classes):
            other = label.copy()
            other[w] = c
            tried.append(likelihood(other))
        assert tried[got[w]] == pytest.approx(max(tried))


def test_kneser_ney_probabilities_sum_to_one(spark):
    docs = fixtures.documents(spark).where("text is not null")
    tables = kneser_ney.orders(kneser_ney.counts(docs))
    model = kneser_ney.probabilities(tables, kneser_ney.discounts(tables))
    low = {k: kneser_ney._arrays(model[k]) for k in (1, 2, 3)}
    shard = kneser_ney.Shard(low, kneser_ney._arrays(model[4]))
    for context in (b"the", b"w1a", b"zzz", b"\0\0\0"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert abs(np.exp(shard.logs(codes)).sum() - 1) < 1e-6


def test_kneser_ney_shards_add_up(spark):
    docs = fixtures.documents(spark)
    tables = kneser_ney.orders(kneser_ney.counts(docs.where("text is not null")))
    model = kneser_ney.probabilities(tables, kneser_ney.discounts(tables))
    one = Counter((r["doc_id"], r["n_bytes"], round(r["log_p"], 6)) for r in kneser_ney.score(docs, model, ["doc_id"]).collect())
    many = Counter((r["doc_id"], r["n_bytes"], round(r["log_p"], 6)) for r in kneser_ney.score(docs, model, ["doc_id"], 900).collect())
    assert one == many


def test_classifier_keeps_prose_and_drops_junk(spark):
    rng = random.Random(8)
    rows = [(k, fixtures.prose(rng, 120), None if k % 5 else "en") for k in range(200)]
    rows += [(1000 + k, "".join(rng.choice("#%&*!QXZ@") for _ in range(400)), "xx") for k in range(20)] + [(2000, None, "en"), (2001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(k,) for k in range(0, 200, 2)], "doc_id long")
    kept = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(docs, ids).collect()}
    assert len(kept) == len(rows)
    assert sum(kept[k] for k in range(200)) > 190
    assert not any(kept[k] for k in kept if k >= 1000)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert kneser_ney.op8_quality_classifier(docs, labels).where("kept").count() == 0
    assert kneser_ney.op8_quality_classifier(fixtures.no_documents(spark), labels).count() == 0


def test_best_of_many_is_best_class_of_each():
    rng = np.random.default_rng(8)
    size, classes = 40, 4
    n = rng.integers(0, 4, (size, size)).astype(float)
    label = np.concatenate([np.arange(size - 2) % classes, [classes, classes + 1]])
    one = np.eye(classes + 2)[label]
    between = one.T @ n @ one
    off = n - np.diag(np.diag(n))
    own = np.arange(size - 2)
    left, right = (off.T @ one)[own], (off @ one)[own]
    got = class_lm.best_of_many(left, right, np.diag(n)[own], label[own], between, classes)
    assert list(got) == list(class_lm.best_classes(left, right, np.diag(n)[own], label[own], between, classes))


def test_words_outside_the_first_exchange_are_exchanged(spark):
    """Two kinds of words in turn; only four words are exchanged first, the rounds have to sort the rest."""
    rng = random.Random(3)
    kinds = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(kinds[i % 2]) for i in range(60))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def total(rounds):
        got = class_lm.fit_and_score(docs, classes=4, exchanged=4, rounds=rounds).collect()
        return sum(r["score"] for r in got if not r["held_out"]) / sum(r["n_tokens"] for r in got if not r["held_out"])

    assert total(2) > total(1) - 1e-9
    # a word of 40 after each: a class for either kind knows the next one's kind
    assert total(2) > -math.log10(40) - 0.1


def test_words_travel_in_blocks(spark):
    """A row per chunk and bucket, not per word; blocks hold every word of the chunks once, with its answers."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.3))}" for _ in range(100))) for k in range(120)]
    chunks = class_lm.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 7).cache()
    names, label = np.zeros(0, np.int64), np.array([4, 5])
    blocks = class_lm.word_rows(chunks, names, label, 4, 8).cache()
    words = {(r["chunk"], w): n for r in chunks.collect() for w, n in zip(r["words"], r["seen"])}
    assert blocks.count() <= 8 * 3 < len(words)
    total = Counter()
    for (_, w), n in words.items():
        total[w] += n
    pick = lambda left, right: left.sum(axis=1).astype(int) % 4
    answers = class_lm.answered(blocks, 8, names, label, pick, 4)
    for r in class_lm.told(chunks, answers).collect():
        row = {"known": r["known"], "at": r["at"]}
        assert class_lm._told(row).tolist() == [total[w] * 256 + total[w] % 4 for w in r["words"]]
    chunks.unpersist()
    blocks.unpersist()


def test_frequent_words_travel_by_side(spark, monkeypatch):
    """A word beside all classes in every chunk weighs two rows of classes a chunk, and once for all chunks when blocks meet."""
    rng = random.Random(6)
    rows = [(k, " ".join(x for _ in range(400) for x in ("the", f"w{rng.randrange(60)}"))) for k in range(42)]
    chunks = class_lm.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 7).collect()
    classes, c2 = 12, 14
    label = lambda word: (word & 0xFFFF) % classes
    blocks, expected, entries = [], Counter(), 0
    for r in chunks:
        words = np.array(r["words"], np.int64)
        line = np.concatenate([[-1], *(np.append(part, -1) for part in np.split(
            np.frombuffer(r["tokens"], np.int32), np.cumsum(r["lengths"])[:-1]))]).astype(int)
        state = np.append(label(words), classes + 1)[line]
        at = np.flatnonzero(line >= 0)
        own, code, n = class_lm._beside(line[at], state[at - 1], state[at + 1], c2)
        assert np.bincount(own).max() <= 2 * c2 < len({*zip(state[at - 1][line[at] == 0], state[at + 1][line[at] == 0])})
        entries += len(own)
        for i in at:
            expected[int(words[line[i]]), int(state[i - 1])] += 1
            expected[int(words[line[i]]), int(c2 + state[i + 1])] += 1
        row = {"chunk": r["chunk"], "words": words}
        blocks.append(class_lm._blocks(row, 1, np.array(r["seen"]), own, code, n))
    for fold in (1_000_000, 50):
        monkeypatch.setattr(class_lm, "FOLD", fold)
        (found,) = class_lm._by_bucket(iter(blocks), c2)
        assert len(found["own"]) <= entries if fold > 50 else len(found["own"]) < 3 * len(expected)
        around = class_lm._around(found["own"], found["code"], found["beside"], len(found["words"]), c2)
        assert {(int(found["words"][w]), int(c)): n for (w, c), n in np.ndenumerate(around) if n} == expected
        assert found["words"][found["row"]].tolist() == [w for r in chunks for w in r["words"]]


def test_a_file_holds_one_chunk(spark, monkeypatch):
    """However many chunks a task makes, a reader of the kept table holds one at a time."""
    monkeypatch.setattr(class_lm, "PACK_WORDS", 7)
    before = set(common.KEPT)
    rows = [(k, " ".join(f"w{k * j % 11}" for j in range(k % 5))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = common.keep(class_lm.encoded(docs, 7, 20), "chunks", 1)
    made = kept.collect()
    assert len(made) > 4 and len(kept.inputFiles()) == len(made)
    assert [(d, n) for r in sorted(made, key=lambda r: r["chunk"]) for d, n in zip(r["ids"], r["lengths"])] == [
        (k, len(t.split())) for k, t in rows]
    for r in made:
        words = [w for k in r["ids"] for w in rows[k][1].split()]
        names = class_lm._hashes([w.encode() for w in words])
        assert np.array(r["words"])[np.frombuffer(r["tokens"], np.int32)].tolist() == names.tolist()
    common.drop_kept(spark, [p for p in common.KEPT if p not in before])
