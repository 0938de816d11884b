"""License scans: ordered signature rules with a keyword gate.

Every rule is a regular expression over the lower-cased words of a text, joined
by one space. A rule runs only in texts that hold one of its keywords; every text
its pattern accepts holds one, so the gate drops nothing. Rules are ordered;
where detections overlap, the earlier rule goes first and a detection that lies
inside an accepted one is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import WORDS, texts


@dataclass(frozen=True)
class Signature:
    label: str
    kind: str
    pattern: str
    #: Each match of the pattern holds one of them.
    keywords: tuple[str, ...]
    confidence: float
    #: Each match begins with a match of this; tried at these places only.
    start: str = ""


#: Label, the name as written in notices, its identifier tag, the path of its page, most specific first. Fixed values.
FAMILIES: tuple[tuple[str, str, str, str], ...] = (
    ("agpl-3.0", r"gnu affero general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"agpl 3 0", r"gnu org licenses agpl 3 0"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", r"agpl", r"gnu org licenses agpl"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"lgpl 3 0", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", r"lgpl 2 1", r"gnu org licenses lgpl 2 1"),
    ("lgpl-2.0", r"(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?", r"lgpl 2 0", r"gnu org licenses lgpl 2 0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl", r"gnu org licenses lgpl"),
    ("gpl-3.0", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"gpl 3 0", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", r"gpl 2 0", r"gnu org licenses gpl 2 0"),
    ("gpl-1.0", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?", r"gpl 1 0", r"gnu org licenses gpl 1 0"),
    ("gfdl-1.3", r"gnu free documentation licen[cs]e(?: version| v)? ?1 3", r"gfdl 1 3", r"gnu org licenses fdl 1 3"),
    ("gfdl", r"gnu free documentation licen[cs]e", r"gfdl", r"gnu org licenses fdl"),
    ("apache-2.0", r"apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?", r"apache 2 0", r"apache org licenses licen[cs]e 2 0"),
    ("apache-1.1", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 1", r"apache 1 1", r"apache org licenses licen[cs]e 1 1"),
    ("apache-1.0", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 0", r"apache 1 0", r"apache org licenses licen[cs]e 1 0"),
    ("cc-by-nc-sa-4.0", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike) 4 0", r"cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s) 4 0", r"cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-4.0", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial) 4 0", r"cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-sa-4.0", r"(?:cc|creative commons) (?:by sa|attribution share ?alike) 4 0", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-4.0", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s) 4 0", r"cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-4.0", r"(?:cc|creative commons) (?:by|attribution) 4 0", r"cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-nc-sa-3.0", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike) 3 0", r"cc by nc sa 3 0", r"creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-3.0", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial) 3 0", r"cc by nc 3 0", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-sa-3.0", r"(?:cc|creative commons) (?:by sa|attribution share ?alike) 3 0", r"cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-3.0", r"(?:cc|creative commons) (?:by|attribution) 3 0", r"cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", r"cc by nc", r"creativecommons org licenses by nc"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", r"cc by sa", r"creativecommons org licenses by sa"),
    ("cc-by", r"(?:cc by|creative commons attribution)", r"cc by", r"creativecommons org licenses by"),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?: 1 0)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("bsd-4-clause", r"(?:4 clause|original) bsd", r"bsd 4 clause", r"opensource org licenses bsd 4 clause"),
    ("bsd-3-clause", r"(?:3 clause|new|modified|revised) bsd", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", r"(?:2 clause|simplified|freebsd) bsd", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("0bsd", r"(?:zero clause|0) bsd", r"0bsd", r"opensource org licenses 0bsd"),
    ("bsd", r"bsd(?: style)?", r"bsd", r"opensource org licenses bsd"),
    ("isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("mit-0", r"mit no attribution", r"mit 0", r"opensource org licenses mit 0"),
    ("x11", r"x11", r"x11", r"spdx org licenses x11"),
    ("mit", r"(?:mit|expat)", r"mit", r"opensource org licenses mit"),
    ("mpl-2.0", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("mpl-1.1", r"mozilla public licen[cs]e(?: version| v)? ?1 1", r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl", r"mozilla public licen[cs]e", r"mpl", r"mozilla org mpl"),
    ("epl-2.0", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("epl-1.0", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version| v)? ?1 2", r"eupl 1 2", r"joinup ec europa eu collection eupl"),
    ("cddl-1.0", r"common development and distribution licen[cs]e", r"cddl 1 0", r"opensource org licenses cddl 1 0"),
    ("cpl-1.0", r"common public licen[cs]e", r"cpl 1 0", r"opensource org licenses cpl1 0"),
    ("artistic-2.0", r"artistic licen[cs]e 2 0", r"artistic 2 0", r"opensource org licenses artistic 2 0"),
    ("artistic", r"artistic", r"artistic 1 0", r"opensource org licenses artistic"),
    ("zlib", r"zlib", r"zlib", r"opensource org licenses zlib"),
    ("bsl-1.0", r"boost software licen[cs]e", r"bsl 1 0", r"boost org licen[cs]e 1 0"),
    ("unlicense", r"unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", r"wtfpl", r"wtfpl net"),
    ("psf-2.0", r"python software foundation", r"psf 2 0", r"python org psf licen[cs]e"),
    ("postgresql", r"postgresql", r"postgresql", r"opensource org licenses postgresql"),
    ("openssl", r"openssl", r"openssl", r"openssl org source licen[cs]e"),
    ("ofl-1.1", r"(?:sil )?open font licen[cs]e", r"ofl 1 1", r"scripts sil org ofl"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[cs]e", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", r"public domain dedication and licen[cs]e", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("ms-pl", r"microsoft public", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", r"opensource org licenses ms rl"),
    ("vim", r"vim", r"vim", r"vimhelp org uganda"),
    ("sspl-1.0", r"server side public licen[cs]e", r"sspl 1 0", r"mongodb com licensing server side public licen[cs]e"),
    ("busl-1.1", r"business source licen[cs]e", r"busl 1 1", r"mariadb com bsl11"),
    ("elastic-2.0", r"elastic licen[cs]e 2 0", r"elastic 2 0", r"elastic co licensing elastic licen[cs]e"),
    ("openrail", r"(?:creativeml )?open ?rail(?: m)?", r"openrail", r"huggingface co spaces bigscience licen[cs]e"),
)

#: Texts of their own: label, pattern, keyword. Fixed values.
SENTENCES: tuple[tuple[str, str, str], ...] = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby"),
    ("mit", r"the software is provided as is without warranty of any kind", "provided as is"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("bsd-3-clause", r"neither the name of (?:\w+ ){1,8}nor the names of its contributors", "neither the name"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e", "compliance with the"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "free software"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies", "verbatim copies"),
    ("wtfpl", r"you just do what the fuck you want to", "do what the"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:released|placed|dedicated|is|are) (?:\w+ ){0,2}(?:in|into|to) the public domain", "public domain"),
    ("all-rights-reserved", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"proprietary and confidential", "proprietary"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
)

_VERB = r"(?:released|licensed|distributed|published|available|provided|covered|governed)"
_LEAD = rf"{_VERB}(?: \w+){{0,3}} (?:under|by)(?: the)?(?: terms of(?: the)?)? "
_TAIL = r"(?: licen[cs]es?)?"
_CALL = r"(?: (?:licen[cs]e|licen[cs]ed|terms))"


def _signatures() -> tuple[Signature, ...]:
    """Every family in each way it is written; surer ways come first."""
    tags, notices, pages, names = [], [], [], []
    for label, name, tag, page in FAMILIES:
        creative = name.startswith("(?:cc")
        called = "licen" not in name and not creative
        own = rf"{name}(?:{_CALL})" if called else name
        known = ("cc", "creative commons") if creative else ("licen", "terms") if called else ("licen",)
        tags.append(Signature(label, "tag", rf"\bspdx licen[cs]e identifier {tag}\b", ("spdx",), 1.0))
        tags.append(Signature(label, "field", rf"\blicen[cs]e (?:is )?{tag}\b", ("licen",), 0.8))
        notices.append(Signature(label, "notice", rf"\b{_LEAD}{name}{_TAIL}\b", ("under", "by"), 0.95, rf"\b{_VERB} "))
        pages.append(Signature(label, "page", rf"\b{page}\b", (page.split()[0],), 0.9))
        names.append(Signature(label, "name", rf"\b{own}\b", known, 0.7))
    sentences = [Signature(label, "sentence", rf"\b{p}\b", (k,), 0.6) for label, p, k in SENTENCES]
    return (*tags[::2], *notices, *pages, *names, *tags[1::2], *sentences)


SIGNATURES = _signatures()
#: Phrases whose every place counts, and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
BASE_CONFIDENCE = 0.5


def resolve(found: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Accepted (rule, start, end): earlier rules first, then longer; what lies inside an accepted one goes.

    A binary indexed tree over the distinct starts holds the furthest end accepted
    so far from any start up to a place, so n detections take n log n steps.
    """
    starts = sorted({start for _, start, _ in found})
    place = {start: k for k, start in enumerate(starts, 1)}
    furthest = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, int]] = []
    for rule, start, end in sorted(found, key=lambda d: (d[0], -(d[2] - d[1]), d[1])):
        k, reached = place[start], -1
        while k:
            reached = max(reached, furthest[k])
            k &= k - 1
        if reached >= end:
            continue
        kept.append((rule, start, end))
        k = place[start]
        while k < len(furthest):
            furthest[k] = max(furthest[k], end)
            k += k & -k
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


class Scanner:
    """Signatures compiled once per task and grouped by keyword."""

    def __init__(self, signatures: Sequence[Signature], base: dict[tuple[str, ...], str]):
        self.signatures = signatures
        self.compiled = [re.compile(s.pattern.encode()) for s in signatures]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, s in enumerate(signatures):
            for k in s.keywords:
                self.by_keyword.setdefault(k.encode(), []).append(i)
        self.starts = {s.start: re.compile(s.start.encode()) for s in signatures if s.start}
        self.base = [(b" %s " % b" ".join(w.encode() for w in words), label) for words, label in base.items()]

    def _matches(self, rule: int, joined: bytes, starts: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
        """The places that ``finditer`` finds."""
        pattern, start = self.compiled[rule], self.signatures[rule].start
        if not start:
            yield from (m.span() for m in pattern.finditer(joined))
            return
        end = 0
        for at in starts[start]:
            if at >= end and (m := pattern.match(joined, at)):
                end = m.end()
                yield m.span()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Number of words, base places (word, label), accepted detections (rule, first word, end word)."""
        plain = text.translate(WORDS)
        words = plain.split()
        # white space between words varies in `plain`, so keywords of several words are looked for by their longest
        maybe = [k for k in self.by_keyword if max(k.split(), key=len) in plain]
        if not maybe:
            return len(words), [], []
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)  # the word at a byte is the gaps before it
        hits, labels = [], []
        for phrase, label in self.base:
            at = padded.find(phrase)
            while at >= 0:
                hits.append(at)
                labels.append(label)
                at = padded.find(phrase, at + 1)
        places = zip(np.searchsorted(gaps, hits).tolist(), labels)
        rules = {i for k in maybe if k in joined for i in self.by_keyword[k]}
        starts = {
            start: [m.start() for m in self.starts[start].finditer(joined)]
            for start in {self.signatures[i].start for i in rules} if start
        }
        found = [(i, a, b) for i in rules for a, b in self._matches(i, joined, starts)]
        accepted = resolve(found)
        first = np.searchsorted(gaps, [a for _, a, _ in accepted]).tolist()
        last = np.searchsorted(gaps, [b for *_, b in accepted]).tolist()
        return len(words), sorted(places), [(i, a, b + 1) for (i, *_), a, b in zip(accepted, first, last)]


def scan(
    docs: DataFrame, signatures: Sequence[Signature] = SIGNATURES, base: dict[tuple[str, ...], str] = BASE
) -> DataFrame:
    """doc_id, n_words, base places, accepted detections.

    ``base``: array of (word, label). ``found``: array of (label, kind, start, end,
    confidence) in words, end exclusive. Null and empty texts have no words; one row
    per input row.
    """
    if any("licen" not in " ".join(words) for words in base):
        raise ValueError("a base phrase needs a word that the keyword gate knows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(signatures, base)
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        hit = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))
        for batch in batches:
            n_words, places, found = [], [], []
            for text in texts(batch):
                n, base_places, hits = scanner.scan(text)
                n_words.append(n)
                places.append([{"word": w, "label": x} for w, x in base_places])
                found.append([
                    {"label": s.label, "kind": s.kind, "start": a, "end": b, "confidence": s.confidence}
                    for s, a, b in ((signatures[i], a, b) for i, a, b in hits)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, place), pa.array(found, hit)],
                ["doc_id", "n_words", "base", "found"],
            )

    narrow = docs.select("doc_id", "text")
    fields = "n_words long, base array<struct<word: long, label: string>>, found array<struct<label: string, kind: string, start: long, end: long, confidence: double>>"
    schema = T.StructType([narrow.schema["doc_id"], *T.StructType.fromDDL(fields).fields])
    return narrow.mapInArrow(run, schema)


def op6_license_scan(docs: DataFrame) -> DataFrame:
    """The contract's columns; the score is the surest detection's confidence, 0 without one."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, found = F.col("base.label"), F.col("found.label")
    sure = F.greatest(
        F.coalesce(F.array_max("found.confidence"), F.lit(0.0)),
        F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)),
    )
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), sure.alias("score"),
        "found",
    )
