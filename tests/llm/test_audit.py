"""Filter audit, source mix and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from obsweave.llm import filter_audit, mixing, periodic
from tests.llm import fixtures

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = [(k, k % 2, 1 if k % 3 == 0 else 0) for k in range(60)] + [(4, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


# ------------------------------------------------------------ filter audit


def orders_run(rows):
    """Every order run over every row, and the removals of each filter summed over all orders."""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    found = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = SPACED.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and doc_id > least[t],
        }
        own = [x for x in LABELS if x[0] == doc_id and doc_id is not None]
        found.append((lang or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, Counter()
    for part in {r[0] for r in found}:
        for order in permutations("ABCDE"):
            left = [r for r in found if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += hit
                unique = sum(r[1] == {f} for r in found if r[0] == part)
                out[part, "".join(order), step] = (len(left), len(hit), redundant, unique, sum(r[2] for r in hit), sum(r[3] for r in hit))
                total[part, f] += len(hit)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(8)
    more = [(100 + k, fixtures.prose(rng, 230, 40 if k % 2 else 3000) + (" #" if k % 3 else "") + " LOUD" * (k % 5 * 8),
             ["en", "", "xx"][k % 3], None, None, None, None, None) for k in range(24)]
    return fixtures.rows() + more + [(50 + k, *more[k][1:]) for k in range(4)] + [(None, None, "en", None, None, None, None, None)]


def test_audit_equals_running_every_order(spark):
    docs = spark.createDataFrame(audit_rows(), fixtures.SCHEMA).repartition(3)
    got = filter_audit.op11_filter_audit(docs, labels(spark)).collect()
    fields = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in fields) for r in got} == orders_run(audit_rows())
    assert len(got) == 600 * len({r["part"] for r in got})


def test_audit_of_nothing_and_without_labels(spark):
    assert filter_audit.op11_filter_audit(fixtures.no_documents(spark), labels(spark)).count() == 0
    none = filter_audit.op11_filter_audit(fixtures.documents(spark), labels(spark).limit(0)).collect()
    assert none and all(r["good_lost"] == r["toxic_lost"] == 0 for r in none)


def test_paths_count_orders():
    reach, leave = filter_audit.paths(5)
    assert reach[-1] == leave[0] == 120
    assert all(reach[s] * leave[s] for s in range(32)) and reach[0b00111] == 6 and leave[0b00111] == 2
    # every order crosses one edge per step
    assert sum(reach[s] * leave[s | 1 << f] for s in range(32) for f in range(5) if not s >> f & 1) == 120 * 5


def test_audit_takes_other_filters(spark):
    docs = fixtures.documents(spark)
    found = filter_audit.patterns(docs, labels(spark), {"X": "size(words) = 0", "Y": "length(body) > 100"}, repeated=None)
    rows = filter_audit.steps(filter_audit.edges(found, "XY"), "XY").collect()
    assert {r["filter_order"] for r in rows} == {"XY", "YX"}
    with pytest.raises(ValueError):
        filter_audit.patterns(docs, labels(spark), {c: "true" for c in "ABCDEFGH"})


# -------------------------------------------------------------- source mix


def shared(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        whole = sum(weight[s] for s in open_)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / whole for s in names}
        above = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def mix_rows(seed=4):
    rng = random.Random(seed)
    # b is hot, a and d are far too small for their weights, z has no words, null is last
    plan = [("b", 300, 40), ("a", 4, 10), ("c", 60, 25), ("d", 2, 3), ("é", 20, 60), ("z", 3, 0), (None, 30, 30), ("", 10, 20)]
    rows, k = [], 0
    for source, n, words in plan:
        for _ in range(n):
            rows.append((k, fixtures.prose(rng, rng.randint(0, 2 * words)) if words else None, "en", source, None, None, None, None))
            k += 1
    return rows + [rows[1], rows[1], rows[5], (None, "no id", None, "c", None, None, None, None), (None, "no id", None, "c", None, None, None, None)]


def test_mix_reaches_shared_targets(spark):
    docs = spark.createDataFrame(mix_rows(), fixtures.SCHEMA).repartition(5)
    got = mixing.op12_source_mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(SPACED.findall(r[1] or ""))) for r in mix_rows())
    source = {r[0]: r[3] for r in mix_rows()}
    source[None] = "c"
    by = defaultdict(list)
    for r in got:
        by[source[r["doc_id"]]].append(r)
    sizes = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    for s, target in shared(sizes).items():
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target, rel=1e-12) for r in by[s])
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 2 * max(r["size"] for r in by[s])
    again = mixing.op12_source_mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert any(r["copies"] == 3 for r in got) and any(r["copies"] == 0 for r in got)


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.op12_source_mix(fixtures.no_documents(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, " ", None, "a", None, None, None, None)], fixtures.SCHEMA)
    assert [(r["target"], r["taken"]) for r in mixing.op12_source_mix(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_mix_emits_each_copy(spark):
    docs = fixtures.documents(spark)
    mix = mixing.mixed(docs)
    out = mixing.emitted(mix)
    assert out.count() == mix.agg({"copies": "sum"}).first()[0]
    assert out.where("copy < 1 or copy > copies").count() == 0


def test_mix_has_no_python_in_its_plan(spark):
    plan = mixing.op12_source_mix(fixtures.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("InArrow|InPandas|EvalPython|ArrowEval", plan)


# ------------------------------------------------------------ periodic runs


def brute_runs(x, power=4, least=6):
    out, n = [], len(x)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(x[s + k] == x[s + k + r] for k in range(length - r)) for r in range(1, q))
            if length >= max(least, power * q) and not smaller:
                out.append((s, length, q))
    return sorted(out)


def made(rng):
    letters = rng.choice([1, 2, 2, 3, 5])
    if rng.random() < 0.5:
        return [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
    out = []
    while len(out) < 60:
        out += [rng.randrange(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 8)
    return out


@pytest.mark.parametrize("power,least", [(4, 6), (2, 2), (3, 5), (2, 9)])
def test_runs_equal_brute_force(power, least):
    rng = random.Random(power * 100 + least)
    for _ in range(700):
        x = made(rng)
        expected = brute_runs(x, power, least)
        assert periodic.runs_of(x, power, least) == expected
        assert periodic.text_runs(x, power, least) == expected


def contract(doc_id, text):
    w = SPACED.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if n < 2000 else [r for r in periodic.runs_of([*map(hash, w)])]
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [r for r in fixtures.rows() if r[0] != 63]
    for k in range(200, 300):
        x = [f"é{v}" for v in made(rng)]
        rows.append((k, "\t".join(x) + rng.choice(["", " ", "\n"]), "en", None, None, None, None, None))
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3)
    got = periodic.op13_periodic_runs(docs)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(contract(r[0], r[1]) for r in rows)
    assert periodic.op13_periodic_runs(fixtures.no_documents(spark)).count() == 0


def test_long_texts_take_linear_time_and_keep_other_columns(spark):
    rng = random.Random(9)
    block = [f"w{rng.randrange(5000)}" for _ in range(9000)]
    long = " ".join(block * 12 + ["ha"] * 30_000 + block)
    docs = spark.createDataFrame([(1, long, "runs row")], "doc_id long, text string, row string").withColumnRenamed("row", "n")
    one = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in one["runs"]] == [(0, 108_000, 9000), (108_000, 30_000, 1)]
    assert len(one["collapsed"].split()) == 9000 + 1 + 9000 and one["n"] == "runs row"
