"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as the sum of its own vector (words of the training texts) and
the mean vector of its byte pairs, so unknown words have an input too. Two
recurrent passes read the text, attention pools the states of a window of words,
and a text scores as its highest of all overlapping windows, one from every word on.
The windows share the passes: a word's state and attention are found once, and each
window adds up those of its words. Training runs in numpy on a bounded sample of
labelled texts; scoring runs in every task on whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import alnum_words, digest, held, keep, texts, tidy

WINDOW = 48
#: Words between the windows of the first training pass; later passes and every score use all windows.
STRIDE = 24
#: Long texts are read in segments; both passes start ``WARM`` words before the words they are wanted for.
SEGMENT, WARM = 64, 24
SIZE, HIDDEN, PAIRS = 16, 8, 1024
#: Labelled texts per class that training may see, drawn by a hash of the text; the bound of what the driver holds.
SAMPLE = 800
#: A word gets a vector of its own when so many training texts have it; rarer ones enter by their byte pairs.
SPREAD = 8
#: Texts of each kind that a word's first leaning is shrunk by.
SHRINK = 20
#: Passes over the sample at least, and steps at least: a small sample is read more often.
EPOCHS, STEPS = 5, 100
BATCH, RATE, SEED = 256, 0.01, 7
#: Words learn more slowly, or they learn texts by heart.
RATES = {"word": 0.002}
THRESHOLD = 0.3
#: Words whose input a task remembers; a speed setting, any value gives the same scores.
REMEMBERED = 150_000


def windows_of(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of overlapping windows that cover ``n`` words; one window for fewer."""
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


def laid_out(texts_: list[np.ndarray], owner: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word rows of windows with the words read before and after them (-1: none)."""
    lengths = np.array([len(t) for t in texts_], np.int64)
    base = np.cumsum(lengths) - lengths
    at = starts[:, None] + np.arange(-WARM, WINDOW + WARM)
    there = (at >= 0) & (at < lengths[owner][:, None])
    flat = np.concatenate([*texts_, np.zeros(1, np.int64)])
    return np.where(there, flat[np.where(there, base[owner][:, None] + at, 0)], -1)


def window_mask(rows: np.ndarray) -> np.ndarray:
    """Which words of ``laid_out`` rows belong to the window."""
    inside = rows >= 0
    inside[:, :WARM] = inside[:, WARM + WINDOW :] = False
    return inside


def sliding(x: np.ndarray, window: int) -> np.ndarray:
    """Sums of ``window`` neighbours from each place of the last axis on, as sums of powers of two: no
    differences, so small windows beside large ones keep their digits. Past the end stands 0."""
    n = x.shape[-1]
    block = np.concatenate([x, np.zeros((*x.shape[:-1], window))], axis=-1)
    out, at, size = np.zeros_like(x), 0, 1
    while window:
        if window & 1:
            out += block[..., at : at + n]
            at += size
        window >>= 1
        if window:
            block[..., :-size] += block[..., size:].copy()
            size *= 2
    return out


def pair_segments(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte pairs of the words, spaces around each included, and where each word's begin."""
    run = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    return (run[:-1] * 251 + run[1:]) % PAIRS, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def summed(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``n`` rows of sums of the values that go to each."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.add.reduceat(values[order], first)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


#: Gate inputs of no word: the update gate keeps the whole state.
NOTHING = np.zeros((1, 2, 3 * HIDDEN), np.float32)
NOTHING[:, :, :HIDDEN] = 100.0


class Network:
    """Weights by name; ``gates`` order is update, reset, candidate; axis 0 is the direction."""

    def __init__(self, n_words: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        h = HIDDEN
        self.w = {
            "word": draw(n_words + 1, SIZE, scale=0.05),  # the last row: no word of the training texts
            "pair": draw(PAIRS, SIZE, scale=0.1),
            "input": draw(2, SIZE, 3 * h, scale=SIZE**-0.5),
            "bias": np.zeros((2, 1, 3 * h), np.float32),
            "state": draw(2, h, 3 * h, scale=h**-0.5),
            "attend": draw(2 * h, h, scale=(2 * h) ** -0.5),
            "query": draw(h, scale=h**-0.5),
            "out": draw(2 * h, scale=0.1),
            "out_bias": np.zeros(1, np.float32),
        }

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of word inputs: (words, 2, 3h)."""
        return (x @ self.w["input"] + self.w["bias"]).transpose(1, 0, 2)

    def forward(self, gates: np.ndarray, rows: np.ndarray, inside: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logit of each row; ``gates`` are projected words, ``rows`` index them (-1: none), ``inside``
        marks the words that attention pools."""
        b, t = rows.shape
        h, w = HIDDEN, self.w
        states = np.zeros((2, t, b, h), np.float32)
        now = np.zeros((2, b, h), np.float32)
        # the second direction reads from the end
        order = np.stack([rows, rows[:, ::-1]])
        for k in range(t):
            at = order[:, :, k]
            x = np.stack([gates[at[0], 0], gates[at[1], 1]])
            on = (at >= 0)[:, :, None]
            u = now @ w["state"]
            zr = _sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(x[:, :, 2 * h :] + r * u[:, :, 2 * h :])
            new = np.where(on, c + z * (now - c), now)
            if tape is not None:
                tape.append((at, now, u[:, :, 2 * h :], z, r, c, on))
            now = new
            states[:, k] = now
        both = np.concatenate([states[0], states[1, ::-1]], axis=2)  # (t, b, 2h)
        keyed = np.tanh(both @ w["attend"])
        weight = np.where(inside.T, keyed @ w["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight = weight * inside.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        if tape is not None:
            tape.append((both, keyed, weight, pooled))
        return pooled @ w["out"] + w["out_bias"][0]

    def states(self, own: np.ndarray, rows: np.ndarray, side: int, first: int) -> np.ndarray:
        """One direction's states from column ``first`` on (from the last but ``first`` back): (words, rows, h).

        ``own`` are that direction's gate inputs; row 0 is ``NOTHING``, no word, and leaves the state as it is.
        """
        h, state = HIDDEN, self.w["state"][side]
        columns = np.ascontiguousarray(rows.T[::-1] if side else rows.T)
        now = np.zeros((len(rows), h), np.float32)
        out = np.empty((len(columns) - first, len(rows), h), np.float32)
        for k, column in enumerate(columns):
            x = own.take(column, axis=0)
            u = now @ state
            zr = x[:, : 2 * h]
            zr += u[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = u[:, 2 * h :] * zr[:, h:]
            c += x[:, 2 * h :]
            np.tanh(c, out=c)
            now = now - c
            now *= zr[:, :h]
            now += c
            if k >= first:
                out[k - first] = now
        return out[::-1] if side else out

    def every_window(self, gates: np.ndarray, texts_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of each text over all its windows, and where the first such window starts.

        A text of fewer words is one window; that of an empty text pools nothing.
        """
        w = self.w
        lengths = np.array([len(t) for t in texts_], np.int64)
        segments = -(-lengths // SEGMENT)
        room = segments * SEGMENT + 2 * WARM
        base = np.cumsum(room) - room
        flat = np.zeros(room.sum(), np.int64)
        for at, ids in zip(base + WARM, texts_):
            flat[at : at + len(ids)] = ids
        before = np.cumsum(segments) - segments
        places = np.repeat(base - before * SEGMENT, segments) + np.arange(segments.sum()) * SEGMENT
        pooled = np.zeros((2, len(places), SEGMENT))
        there, back = (np.ascontiguousarray(gates[:, side]) for side in (0, 1))
        for k in range(0, len(places), 1024):
            rows = flat[places[k : k + 1024, None] + np.arange(SEGMENT + 2 * WARM)]
            both = np.concatenate([
                self.states(there, rows[:, : WARM + SEGMENT], 0, WARM), self.states(back, rows[:, WARM:], 1, WARM),
            ], axis=2)
            weight = np.exp((np.tanh(both @ w["attend"]) @ w["query"]).astype(float))
            weight *= rows[:, WARM : WARM + SEGMENT].T > 0
            pooled[0, k : k + 1024], pooled[1, k : k + 1024] = weight.T, (weight * (both @ w["out"])).T
        weights, values = sliding(np.pad(pooled.reshape(2, -1), ((0, 0), (0, 1))), WINDOW)
        starts = np.maximum(lengths - WINDOW, 0) + 1
        first = np.cumsum(starts) - starts
        own = np.arange(starts.sum()) - np.repeat(first, starts)
        at = np.repeat(before * SEGMENT, starts) + own
        logits = np.where(np.repeat(lengths > 0, starts), values[at] / np.maximum(weights[at], 1e-300), 0) + w["out_bias"][0]
        best = np.maximum.reduceat(logits, first) if len(first) else np.zeros(0)
        top = np.flatnonzero(logits == np.repeat(best, starts))
        _, pick = np.unique(np.repeat(np.arange(len(texts_)), starts)[top], return_index=True)
        return best, own[top[pick]]

    def backward(self, d_logit: np.ndarray, n_gates: int, tape: list) -> tuple[dict, np.ndarray]:
        """Gradients of the weights after the word inputs, and of the projected words."""
        h, w = HIDDEN, self.w
        both, keyed, weight, pooled = tape.pop()
        t, b = weight.shape
        g = {"out": d_logit @ pooled, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * w["out"]
        d_weight = np.einsum("tbh,bh->tb", both, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tb,tbk->k", d_score, keyed)
        d_key = d_score[:, :, None] * w["query"] * (1 - keyed**2)
        g["attend"] = np.einsum("tbh,tbk->hk", both, d_key)
        d_both = weight[:, :, None] * d_pool + d_key @ w["attend"].T
        d_states = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]])
        d_words = np.zeros((2, t, b, 3 * h), np.float32)
        g["state"] = np.zeros_like(w["state"])
        d_now = np.zeros((2, b, h), np.float32)
        for k in range(t - 1, -1, -1):
            at, before, uc, z, r, c, on = tape[k]
            d = d_now + d_states[:, k]
            live = np.where(on, d, 0)
            d_c = live * (1 - z) * (1 - c**2)
            d_z = live * (before - c) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], axis=2)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=2)
            g["state"] += before.transpose(0, 2, 1) @ d_u
            d_now = np.where(on, live * z, d) + d_u @ w["state"].transpose(0, 2, 1)
            d_words[:, k] = d_x
        at = np.stack([step[0] for step in tape], axis=1).reshape(2, -1)
        d_words = d_words.reshape(2, -1, 3 * h)
        return g, np.stack([summed(n_gates, at[s][at[s] >= 0], d_words[s][at[s] >= 0]) for s in (0, 1)])


class Vocabulary:
    """Rows of word vectors, and the byte pairs of any word."""

    def __init__(self, words: list[bytes]):
        self.row = {w: k for k, w in enumerate(words)}

    def inputs(self, net: Network, words: list[bytes], rows: np.ndarray | None = None) -> np.ndarray:
        """Input vector of each distinct word."""
        if not words:
            return np.zeros((0, SIZE), np.float32)
        rows = self.rows(words) if rows is None else rows
        pairs, starts = pair_segments(words)
        ends = np.append(starts[1:], len(pairs))
        means = np.add.reduceat(net.w["pair"][pairs], starts) / (ends - starts)[:, None]
        return (net.w["word"][rows] + means).astype(np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.row.get(w, len(self.row)) for w in words], np.int64)


class Trained:
    """What a task needs to score."""

    def __init__(self, net: Network, vocabulary: Vocabulary, scale: float, shift: float):
        self.net, self.vocabulary, self.scale, self.shift = net, vocabulary, scale, shift


def _numbered(documents: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words and each document as their numbers."""
    seen: dict[bytes, int] = {}
    out = [np.array([seen.setdefault(w, len(seen)) for w in d], np.int64) for d in documents]
    return list(seen), out


def _leaning(documents: list[list[bytes]], y: np.ndarray, used: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Where each word's vector starts: how much oftener texts of label 1 have it, shrunk for rare words."""
    n = np.zeros((2, len(vocabulary.row)))
    for d, label, on in zip(documents, y, used):
        if on:
            rows = vocabulary.rows(list(set(d)))
            n[int(label), rows[rows < n.shape[1]]] += 1
    size = np.array([((y == k) & used).sum() for k in (0, 1)], float)
    share = size / size.sum()
    return np.log((n[1] + SHRINK * share[1]) / (n[0] + SHRINK * share[0])) - np.log(size[1] / size[0])


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, a little regularised; Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * logits).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        hess = np.array([[(v * logits**2).sum() + 0.1, (v * logits).sum()], [(v * logits).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(float(a), 0.05), float(b)


def train(sample: list[tuple[bytes, int]], odds: float | None = None, seed: int = SEED) -> Trained | None:
    """Fit on labelled texts; ``odds`` of label 1 in the population correct those of the sample. The label belongs to the text, so of a toxic text only its most
    toxic window counts after the first pass. None without texts of both kinds."""
    sample = [(t, y) for t, y in sample if t.strip()]
    if len({y for _, y in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    documents = [alnum_words(t) for t, _ in sample]
    y = np.array([label for _, label in sample], np.float32)
    fresh = rng.random(len(y)) < 0.2  # only calibrates; their words stay unknown
    if len(set(y[fresh])) < 2 or len(set(y[~fresh])) < 2:
        fresh[:] = False
    spread = Counter(w for d, f in zip(documents, fresh) if not f for w in set(d))
    vocabulary = Vocabulary(sorted(w for w, n in spread.items() if n >= SPREAD))
    words, numbered = _numbered(documents)
    word_rows = vocabulary.rows(words)
    pairs, starts = pair_segments(words)
    pair_count = np.append(starts[1:], len(pairs)) - starts
    net = Network(len(vocabulary.row), seed)
    net.w["word"][:-1, 0] = _leaning(documents, y, ~fresh, vocabulary)
    spans = [windows_of(len(d)) for d in numbered]
    owner = np.repeat(np.arange(len(spans)), [len(p) for p in spans])
    starts_of = np.concatenate([np.array(p, np.int64) for p in spans])
    train_on = ~fresh

    def highest() -> tuple[np.ndarray, np.ndarray]:
        gates = np.concatenate([NOTHING, net.project(vocabulary.inputs(net, words, word_rows))])
        return net.every_window(gates, [d + 1 for d in numbered])

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step, epoch, unknown = 0, 0, len(vocabulary.row)
    while epoch < EPOCHS or step < STEPS:
        if epoch == 0:
            text, start = owner, starts_of
        else:
            more = (y[owner] == 0) & (rng.random(len(owner)) < 0.3)
            text = np.concatenate([np.arange(len(y)), owner[more]])
            start = np.concatenate([highest()[1], starts_of[more]])
        epoch += 1
        order = rng.permutation(np.flatnonzero(train_on[text]))
        text, start = text[order], start[order]
        share = y[text].mean()
        for k in range(0, len(text), BATCH):
            part = text[k : k + BATCH]
            rows = laid_out(numbered, part, start[k : k + BATCH])
            used, local = np.unique(rows, return_inverse=True)
            local = local.reshape(rows.shape) - (1 if used[0] < 0 else 0)
            used = used[used >= 0]
            step += 1
            if not len(used):
                continue
            own_rows = np.where(rng.random(len(used)) < 0.1, unknown, word_rows[used])  # so that byte pairs learn too
            label = y[part]
            weight = np.where(label == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / len(part)
            spelled = _spelled(used, pairs, starts, pair_count)
            for name, grad in gradients(net, local, window_mask(rows), own_rows, spelled, label, weight).items():
                first, second = moment[name]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                net.w[name] -= RATES.get(name, RATE) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    best, _ = highest()
    judged = fresh if fresh.any() else np.ones(len(y), bool)
    scale, shift = _calibrated(best[judged].astype(float), y[judged])
    if odds:
        shift += np.log(odds) - np.log(y[judged].mean() / (1 - y[judged].mean()))
    return Trained(net, vocabulary, scale, shift)


def _spelled(used, pairs, starts, pair_count) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of some of the training words, and how many each has."""
    counts = pair_count[used]
    first = np.cumsum(counts) - counts
    return pairs[np.repeat(starts[used] - first, counts) + np.arange(counts.sum())], counts


def word_inputs(net: Network, own_rows: np.ndarray, spelled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Input vectors of words by their rows and byte pairs."""
    pairs, counts = spelled
    means = np.add.reduceat(net.w["pair"][pairs], np.cumsum(counts) - counts) / counts[:, None]
    return (net.w["word"][own_rows] + means).astype(np.float32)


def gradients(net: Network, rows, inside, own_rows, spelled, label, weight) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss of some windows, for all weights; ``rows`` index the given words."""
    x = word_inputs(net, own_rows, spelled)
    tape: list = []
    logit = net.forward(net.project(x), rows, inside, tape)
    g, d_gates = net.backward(((_sigmoid(logit) - label) * weight).astype(np.float32), len(own_rows), tape)
    g["input"] = np.stack([x.T @ d_gates[s] for s in (0, 1)])
    g["bias"] = d_gates.sum(axis=1, keepdims=True)
    d_x = d_gates[0] @ net.w["input"][0].T + d_gates[1] @ net.w["input"][1].T
    g["word"] = summed(len(net.w["word"]), own_rows, d_x)
    pairs, counts = spelled
    g["pair"] = summed(PAIRS, pairs, np.repeat(d_x / counts[:, None], counts, axis=0))
    return g


def labelled(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE
) -> tuple[list[tuple[bytes, int]], float | None]:
    """At most ``per_class`` texts of each label, drawn by a hash of the text, held-out ids left out,
    and the odds of label 1 among all of them.

    A text with both labels counts as toxic; null texts and labels are left out.
    """
    truth = labels.where(~held("doc_id", 4)).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    keys = docs.select("doc_id", digest().alias("__key"))
    pool = (
        keys.join(truth.dropna(), "doc_id")
        .groupBy("__key").agg(F.max("__toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    )
    pool = keep(pool, "labelled")
    counts = {r["toxic"]: r["count"] for r in pool.groupBy("toxic").count().collect()}  # a row per label
    sample = None
    for label in (0, 1):
        part = pool.where(F.col("toxic") == label).orderBy("__key").limit(per_class)
        sample = part if sample is None else sample.union(part)
    rows = (
        docs.select("doc_id", "text").where("text is not null").withColumn("__key", digest())
        .join(F.broadcast(sample), ["doc_id", "__key"])  # 2 * per_class rows
        .dropDuplicates(["__key"]).orderBy("__key").select("text", "toxic").collect()
    )
    odds = counts[1] / counts[0] if counts.get(0) and counts.get(1) else None
    return [(r["text"].encode(), r["toxic"]) for r in rows], odds


class Scorer:
    """Scores texts in one task; remembers the gate inputs of words it has met."""

    def __init__(self, model: Trained):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.gates = np.concatenate([NOTHING, np.zeros((1023, 2, 3 * HIDDEN), np.float32)])

    def _learn(self, new: list[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        at = len(self.known) + 1  # row 0 is no word
        if at + len(new) > len(self.gates):
            grown = np.zeros((2 * (at + len(new)), 2, 3 * HIDDEN), np.float32)
            grown[:at] = self.gates[:at]
            self.gates = grown
        net = self.model.net
        self.gates[at : at + len(new)] = net.project(self.model.vocabulary.inputs(net, new))
        self.known.update((w, at + k) for k, w in enumerate(new))

    def score(self, batch: list[bytes]) -> np.ndarray:
        documents = [alnum_words(t) for t in batch]
        distinct = set().union(*documents)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        new = sorted(distinct - self.known.keys())
        if new:
            self._learn(new)
        get = self.known.__getitem__
        numbered = [np.fromiter(map(get, d), np.int64, len(d)) for d in documents]
        best, _ = self.model.net.every_window(self.gates, numbered)
        return 1 / (1 + np.exp(-np.clip(self.model.scale * best.astype(float) + self.model.shift, -30, 30)))


def score(docs: DataFrame, model: Trained | None, carry: list[str]) -> DataFrame:
    """The carried columns and ``score``.

    The score is that of the highest of all windows of the whole text, ties alike; null and
    empty texts get that of an empty window. Repeated rows each get their row; no column
    but ``text`` is read, so others may have any name. Without a model (no labels of both kinds) it is 0.
    """
    narrow = docs.select(*carry, *([] if "text" in carry else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if model is None else Scorer(model)
        for batch in batches:
            found, held_back, size = [], [], 0

            def flush():
                if held_back:
                    found.append(np.zeros(len(held_back)) if scorer is None else scorer.score(held_back))
                    held_back.clear()

            for text in texts(batch):
                held_back.append(text)
                size += len(text)
                if size > 400_000:
                    flush()
                    size = 0
            flush()
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carry))), pa.array(scores)], [*carry, "score"]
            )

    schema = T.StructType([*(narrow.schema[c] for c in carry), T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(tidy(run), schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """Train on the labels, then score every text."""
    return score(docs, train(*labelled(docs, labels)), carry)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, null and empty texts and repeated rows included."""
    return toxic_scores(docs, labels, ["doc_id"]).select(
        "doc_id", held("doc_id", 4).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
