"""Small tables with the cases every operator has to take: nulls, empty, long, equal, repeated, none, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, sig string"


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    vocabulary = ["the", "of", "and", "to", *[f"w{k:x}" for k in range(words)]]
    out = [rng.choice(vocabulary) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ".\n", ", "]) for w in out).strip()


def texts(seed: int = 3) -> dict[int, str | None]:
    """Ids and texts: near copies, shared passages, odd spaces, no Latin, very long, tiny, empty, null."""
    rng = random.Random(seed)
    out: dict[int, str | None] = {k: prose(rng, rng.choice([5, 30, 80, 200])) for k in range(40)}
    for k in range(40, 52):
        words = out[3 * (k % 4)].split(" ")
        words[len(words) // 2] = f"edit{k}"
        out[k] = " ".join(words)
    passage = prose(rng, 70)
    for k in range(52, 60):
        out[k] = prose(rng, 40) + " " + passage + " " + prose(rng, 40)
    out[60] = out[61] = out[62] = out[5]
    out[63] = prose(rng, 20_000, 5000)
    out[64] = (passage + "\n") * 3
    out[65] = "Und " * 200
    out[66] = "  two  spaces   and\ttabs\n\n\nlines \n end "
    out[67] = "größer Straße ñandú 東京 タワー \u00a0 x\u2003y <|endoftext|> don't"
    out[68] = "One Two three"
    out[69] = "one TWO three"
    out[70] = "x"
    out[71] = " \n\t "
    out[72] = ""
    out[73] = None
    out[74] = "!" * 900
    return out


def rows(seed: int = 3) -> list[tuple]:
    out = [(k, t, "en" if k % 2 else None, None, None, "k", 1, "s") for k, t in texts(seed).items()]
    return out + [out[7], out[7], (None, "no id at all", None, None, None, None, None, None)]


def documents(spark, seed: int = 3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
