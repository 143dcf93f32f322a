"""Small corpora with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sté", "tro") for b in ("lon", "dar", "vis", "gem", "pu", "rix", "ñol")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source) with copies, near copies, shared passages, nulls and blanks."""
    rng = random.Random(seed)
    passage = sentence(rng, 40)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(rows) < 6:
            text = "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5)))
        elif kind == 1:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            words = (rows[0][1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = sentence(rng, 5) + " " + passage + "\n" + sentence(rng, 8)
        elif kind == 4:
            text = sentence(rng, rng.randint(1, 4)).upper()
        else:
            text = sentence(rng, 200)
        rows.append((i, text, ("en", "de", None)[i % 3], ("s1", "s2", "s3", None)[i % 4]))
    rows += [(n, None, None, None), (n + 1, "", "en", ""), (n + 2, "   \n\t ", "en", "s1"), (n + 3, "a" * 30_000, "en", "s2")]
    rows += [rows[7], rows[7]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside or add; they must not clash.
CLASHING = {"fp": 1, "blk": "x", "n": 2.0, "_n": 3, "token": "t", "near": True, "root": 9, "key": "k", "size_": 1}


def clash(df):
    """The table with columns that are named like internal ones."""
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
