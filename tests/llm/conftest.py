from __future__ import annotations

import pytest

CLASHING = "id long, t string, h long, block long, pos int, fp long, state double, selected boolean, group_id long, kept boolean, n int, words string, __gone long, __chosen long, toxic boolean, score double, bands array<long>, k1 long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source)."""

    def make(rows, clash=False):
        rows = [(d, t, "en", s[0] if s else "a", None if t is None else len(t)) for d, t, *s in rows]
        schema = SCHEMA
        if clash:
            rows = [(*r, 1, "x", 2, 3, 4, 5, 0.5, True, 6, False, 7, "w", 8, 9, True, 0.25, [1], 2) for r in rows]
            schema += ", " + CLASHING
        return spark.createDataFrame(rows, schema).repartition(2)

    return make


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty, blank, wordless and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    return [
        (1, None), (None, "text without an id and some more words"), (None, None), (2, ""), (3, "   \n\t "), (4, "!!! ... ---"), (5, "!!! ... ---"), (6, "one"), (7, "one"), (8, long),
        (9, "same row twice with a few words in it"), (9, "same row twice with a few words in it"), (10, "Ünïcode ÉCOLE ßtraße 東京 🙂 text"), (11, "same row twice with a few words in it", None), (12, "a\x00b zero byte"),
    ]
