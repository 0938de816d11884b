"""URL filters, decontamination, license scan and quality rules against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from obsweave.llm import decontaminate, licenses, quality_rules, url_filters
from tests.llm import fixtures

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def by_text(df, columns):
    """Rows as a bag, with ids, so that repeated rows count."""
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_rules_equal_brute_force(spark):
    def expected(text):
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(three)
        hit = {i + k for i, w in enumerate(three) if n[w] > 1 for k in range(3)}
        base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                len(lines) - len(set(lines)), len(hit), base)

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.op7_quality_rules(fixtures.documents(spark))
    assert by_text(got, columns) == Counter((r[0], *expected(r[1])) for r in fixtures.rows())
    assert all(not r["kept"] for r in got.where("base_failed").collect())
    assert quality_rules.op7_quality_rules(fixtures.no_documents(spark)).count() == 0


def test_ablations_equal_the_ledger_filtered(spark):
    book = quality_rules.ledger(fixtures.documents(spark))
    bits = [r["failed_bits"] for r in book.collect()]
    for r in quality_rules.ablations(book).collect():
        chosen = quality_rules.POLICIES[r["policy"]]
        whole, bit = quality_rules.mask(chosen), quality_rules.mask([r["rule"]])
        assert r["kept"] == sum(b & whole == 0 for b in bits)
        assert r["kept_without"] == sum(b & (whole - bit) == 0 for b in bits)
        assert r["failed"] == sum(b & bit != 0 for b in bits)
        assert r["failed_only_this"] == sum(b & whole == bit for b in bits)


URLS = [
    "http://Sub.Example.NET/en/1", "https://example.net/EN/", "http://example.net?x=/en/", "http://anet/x", "http://a.net/",
    "ftp://www.example.com/de/x#y", "http://example.com.evil/de/", "http://x.org/fr/a?b", "http://x.org/fr", "no scheme", "",
    None, "http://", "http:///path", "a://b://c.net/d", "http://www.casino-win.example.org/en/", "http://my-casino.com/", 
    "http://x.de/ads/1", "http://x.de/ADS/1", "http://casinos.com/", "http://free-bets.example.org/fr/1", "http://x.net:80/a",
]


def test_url_filters_try_every_rule(spark):
    rules = url_filters.HOST_RULES + url_filters.PATTERN_RULES
    got = url_filters.judge(spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string"))
    assert got.count() == len(URLS)
    for r in got.collect():
        host, path = url_filters.split_url(URLS[r["page_id"]])
        hits = [x for x in rules if re.search(x.pattern.replace(r"\z", r"\Z"), host + path)]
        own = max((x for x in hits if x.host), key=lambda x: len(x.name), default=None)
        other = next((x for x in hits if not x.host), None)
        chosen = own or other
        assert (r["host"], r["path"], r["rule"]) == (host, path, own.name if own else None)
        assert r["verdict"] == (chosen.verdict if chosen else url_filters.DEFAULT)
    assert url_filters.split_url("http://Sub.Example.NET/en/1") == ("sub.example.net", "/en/1")
    assert url_filters.split_url("http://x.net?y#z") == ("x.net", "")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(none).count() == 0


def test_url_rules_that_decide(spark):
    found = {URLS[r["page_id"]]: r for r in url_filters.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()}
    assert found["http://Sub.Example.NET/en/1"]["rule"] == "example.net/en/"
    assert found["https://example.net/EN/"]["rule"] == "net/"
    assert found["http://example.net?x=/en/"]["rule"] is None
    assert found["http://anet/x"]["rule"] is None
    assert found["http://x.org/fr/a?b"]["verdict"] == "allow"
    assert found["http://www.casino-win.example.org/en/"]["verdict"] == "block"


ITEMS = [
    (1, "w1 w2 the of and to w3 w4 w5 w6 w7 w8"), (2, "One two THREE"), (3, None), (4, "..."), (5, "one, two three!"),
    (None, "x"), (10, "x"),
]


@pytest.mark.parametrize("slice_words", [500_000, 4])
def test_decontamination_equals_brute_force(spark, slice_words):
    texts = fixtures.texts()
    items = [*ITEMS, (7, texts[63][5000:5200]), (8, texts[52][200:420])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = fixtures.documents(spark)

    def words(t):
        return ALNUM.findall((t or "").translate(LOW))

    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)

    def expected(t):
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        return len(w), len(hit), tuple(sorted(ids))

    found = decontaminate.contamination(docs, bench, slice_words=slice_words).collect()
    got = Counter((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"])), tuple(map(int, r["items"]))) for r in found)
    assert got == Counter((r[0], *expected(r[1])) for r in fixtures.rows())
    if slice_words > 4:
        for r in decontaminate.op5_decontamination(docs, bench).where("doc_id is not null").collect():
            ids = expected(texts[r["doc_id"]])[2]
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.op5_decontamination(fixtures.documents(spark), bench).where("contaminated").count() == 0
    assert decontaminate.op5_decontamination(fixtures.no_documents(spark), bench).count() == 0


NOTICES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "Distributed under the terms of the GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "see https://www.mozilla.org/MPL/2.0/": "mpl-2.0",
    "MIT\n\n License and Apache license": "apache,mit",
    "A license to drive.": "",
    "nothing here": "",
    "": "",
}


def test_license_labels(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.op6_license_scan(df).collect()}
    assert [got[k] for k in range(len(NOTICES))] == list(NOTICES.values())


def test_license_base_places_equal_brute_force(spark):
    texts = {**fixtures.texts(), 100: "mit license mit LICENSE, apache license general public license " * 3}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.op6_license_scan(df).collect():
        words = ALNUM.findall((texts[r["doc_id"]] or "").translate(LOW))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
        at = sorted(k for k, _ in places)
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert 0 <= r["score"] <= 1
    assert licenses.op6_license_scan(fixtures.no_documents(spark)).count() == 0


def test_contained_detections_are_suppressed():
    assert licenses.resolve([(2, 0, 10), (1, 3, 7), (0, 2, 8), (3, 9, 12)]) == [(2, 0, 10), (0, 2, 8), (3, 9, 12)]
    assert len(licenses.SIGNATURES) > 200


UNGATED = {
    "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0": "cc-by-nc-sa-3.0",
    "a Creative Commons Zero waiver": "cc0-1.0",
    "governed by the MIT": "mit",
    "This file is covered by the terms of the Mozilla Public License, v 2.0": "mpl-2.0",
    "see the MIT terms": "mit",
    "zlib terms, PostgreSQL terms": "postgresql,zlib",
}


def every_place(text):
    """Detections of every signature in every text, without keywords and starts."""
    words = ALNUM.findall(text.translate(LOW))
    joined = " ".join(words).encode()
    found = [(i, *m.span()) for i, s in enumerate(licenses.SIGNATURES) for m in re.finditer(s.pattern.encode(), joined)]
    return [(i, joined.count(b" ", 0, a), joined.count(b" ", 0, b) + 1) for i, a, b in licenses.resolve(found)]


def test_license_keywords_drop_nothing(spark):
    df = spark.createDataFrame(list(enumerate(UNGATED)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.op6_license_scan(df).collect()}
    assert [got[k] for k in range(len(UNGATED))] == list(UNGATED.values())
    # each family as its patterns write it, every alternative of the outermost group once
    names = {n for f in licenses.FAMILIES for p in f[1:] for n in written(p)}
    calls = ["{}", "{} terms", "{} license", "{} licence x", "released by the {}", "provided to you as is under {}",
             "covered covered by the terms of the {} licenses", "governed by released under {}", "license is {}",
             "SPDX-License-Identifier: {}", "distributed by {} and published under the {} by"]
    scanner = licenses.Scanner(licenses.SIGNATURES, licenses.BASE)
    texts = [*UNGATED, *NOTICES, *(t or "" for t in fixtures.texts().values()), *(c.replace("{}", n) for c in calls for n in names)]
    for text in texts:
        assert scanner.scan(text.encode())[2] == every_place(text), text


def written(pattern):
    """Texts a pattern accepts: each choice of each group."""
    pattern = pattern.replace("[cs]", "c")
    group = re.search(r"\(\?:([^()]*(?:\([^()]*\)[^()]*)*)\)(\?)?", pattern)
    if not group:
        return {re.sub(r" \?", " ", pattern), re.sub(r" \?", "", pattern)}
    depth, parts = 0, [""]
    for c in group[1]:
        depth += (c == "(") - (c == ")")
        parts = [*parts, ""] if c == "|" and not depth else [*parts[:-1], parts[-1] + c]
    choices = {*parts, ""} if group[2] == "?" else set(parts)
    return {w for x in choices for w in written(pattern[: group.start()] + x + pattern[group.end() :])}


def test_suppression_equals_comparing_with_all_accepted():
    rng = random.Random(2)
    for _ in range(400):
        found = [(rng.randrange(6), a, a + rng.randint(1, 9)) for a in (rng.randrange(30) for _ in range(rng.randrange(25)))]
        kept = []
        for rule, start, end in sorted(found, key=lambda d: (d[0], d[1] - d[2], d[1])):
            if not any(a <= start and end <= b for _, a, b in kept):
                kept.append((rule, start, end))
        assert licenses.resolve(found) == sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def test_a_dump_of_notices_takes_linear_time():
    scanner = licenses.Scanner(licenses.SIGNATURES, licenses.BASE)
    n, places, found = scanner.scan(b"mit license " * 80_000)  # was quadratic: minutes
    assert n == 160_000 and [w for w, _ in places] == list(range(0, 160_000, 2)) and len(found) == 159_999
    took = []
    for times in (20_000, 160_000):
        start = time.process_time()
        scanner.scan(b"licensed under the apache license " * times)
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0]  # eight times the text


def test_item_ids_may_be_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([("q/10", "b c d e f g h i j k"), ("q/9", "a b c d e f g h i j"), (None, "x")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.op5_decontamination(docs, bench).collect()}
    assert got[1]["items_sha256"] == hashlib.sha256(b"q/10,q/9").hexdigest() and got[1]["n_hit"] == 11
    assert got[2]["n_items"] == 0
