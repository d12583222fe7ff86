import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

# Columns whose names the operators use inside.
CLASH = ", size long, kept boolean, target double, score string, bytes binary, gram long, key long, mark long, _x string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + CLASH


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, schema=DOCS):
        width = schema.count(",") + 1
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew dark amber potions near old stone bridges".split()


def prose(seed: int, n: int) -> str:
    """Text without repeated phrases: words with numbers."""
    return " ".join(f"{WORDS[(seed * 7 + i * i) % len(WORDS)]}{(seed * 31 + i * 17) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def mixed_rows():
    """Null, empty, blank, very long and repeated texts, ties, null ids and sources."""
    long = " ".join(prose(s, 400) for s in range(60))
    rows = [
        (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, "", None, "b"), (4, None, "en", "b"),
        (5, " \n\t ", "en", None), (6, long, "de", "a"), (7, prose(3, 30), None, None), (7, prose(3, 30), None, None),
        (8, "été 12 été", "fr", "é"), (9, "12 34 !!", "fr", "z"), (None, prose(1, 80), None, "b"), (None, None, None, None),
        (10, prose(1, 80) + " tail", "en", "c"), (11, "One. Two? Three!", "en", "c"), (12, "\U0001f600 中文", "zh", "c"),
    ]
    return rows
