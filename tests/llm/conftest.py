import pytest

from corpus_helpers import prose

SCHEMA = (
    "doc_id long, text string, key string, h long, w string, at int, part int, row long, file string, `set` string, shard int, label string, "
    "digest string, n int, span string, items string, nodes string, size int, features string, __key string"
)


@pytest.fixture
def frame(spark):
    """(doc_id, text) rows -> documents with extra columns whose names clash with those used inside."""

    def make(rows):
        extra = ("x", 1, "x", 1, 1, 1, "x", "x", 1, "x", "x", 1, "x", "x", "x", 1, "x", "x")
        return spark.createDataFrame([(i, t, *extra) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture
def tricky():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 12000)
    return [
        (1, "All rights reserved. Alpha beta gamma delta epsilon zeta"),
        (1, "All rights reserved. Alpha beta gamma delta epsilon zeta"),
        (2, None), (3, ""), (4, "   \t\n"), (5, long), (6, long + " "), (None, None), (None, "alpha beta"), (None, "alpha beta"),
        (7, "é" * 50 + " 日本語 \U0001F600 ﬁ"), (8, "a"), (9, long[: len(long) // 2]), (1, "another text under a repeated id"),
    ]
