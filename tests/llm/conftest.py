from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, run int, fp string, row string, part string"


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, lang) as a table with columns whose names clash with those of the operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "d", 1, "f", "r", "p") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, pool: int = 60) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture
def edge_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(11)
    long = words(rng, 30_000, 500)
    base = words(rng, 40)
    return [
        (None, "no id at all"), (1, None), (2, ""), (3, "   \n\t"), (4, long), (5, base), (6, base), (6, base), (7, base.replace(" ", "\n ")), (8, base + " extra"),
        (9, "été Straße 東京 \U0001f642 naïve"), (10, "!!! ### $$$ 123"), (11, long), (12, "x"), (-5, base), (2, None),
    ]
