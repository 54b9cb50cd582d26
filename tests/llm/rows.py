"""Small booking messages for the text operators' tests."""

from __future__ import annotations

import random

PROSE = "the driver was at the gate of the old station and we left for the campus on time with all the bags in the boot of the car".split()


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randint(0, 400)) * (rng.random() < 0.5) for _ in range(n))


#: Texts of every awkward kind, under columns that operators use inside.
EDGES = [
    (1, prose(1)), (2, None), (3, ""), (4, " \n\t "), (5, prose(1)), (5, prose(1)), (None, prose(2)), (None, None), (6, "word " * 30_000), (7, "ü€😀 " * 40), (8, "\n".join([prose(3, 30)] * 3)),
    (9, "x" * 50_000)]
CLASHES = {"row": 1, "rest": 2, "w": "w", "n_words": -1, "kept": False, "fingerprint": "f", "removed": 0, "spans": "s", "hash": 3, "text": "t", "stay": 4, "again": 5, "copy": 9, "part": 6, "ids": "i", "start": 7, "u": 1, "a b": 2}


def messages(spark, rows=None, clash: bool = False):
    rows = EDGES if rows is None else rows
    if not clash:
        return spark.createDataFrame(rows, "id bigint, content string")
    names = ", ".join(f"`{c}` {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int'}" for c, v in CLASHES.items())
    return spark.createDataFrame([(*r, *CLASHES.values()) for r in rows], f"id bigint, content string, {names}")


def found(df):
    """Rows as sorted tuples of text."""
    return sorted(tuple(map(str, r)) for r in df.collect())
