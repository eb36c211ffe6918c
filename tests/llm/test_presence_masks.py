"""Ranked search against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest

from corpus_helpers import prose, words
from tidepanel.llm import presence_masks


def brute(docs, items, top=10):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in set(items):
        terms = {t for t in words(text) if df[t]}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // length
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, i, -score))
    return Counter(out)


@pytest.fixture
def queries(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, rank int, doc_id string")


ITEMS = [
    (1, "all rights reserved"), (1, "All Rights reserved alpha"), (2, None), (3, ""), (4, "..."), (5, "alpha alpha beta"), (5, "alpha alpha beta"),
    (6, prose(1, 300)), (None, "beta gamma"), (7, "words that stand nowhere"), (8, "é" * 50 + " ﬁ 日本語"),
]


@pytest.mark.parametrize("items,cells", [(512, 1 << 21), (3, 400)])
def test_search(frame, queries, tricky, items, cells):
    rows = tricky + [(100 + i, prose(i % 37, 5 + i % 60, 60)) for i in range(300)]
    got = presence_masks.search(frame(rows), queries(ITEMS + [(20 + i, prose(500 + i, 20, 60)) for i in range(6)]), items=items, cells=cells).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, ITEMS + [(20 + i, prose(500 + i, 20, 60)) for i in range(6)])


def test_ties_and_many_equal_documents(frame, queries):
    rows = [(i, "alpha beta") for i in range(60)] + [(100 + i, "gamma") for i in range(70)] + [(None, "alpha beta")]
    got = presence_masks.search(frame(rows), queries([(1, "alpha"), (2, "gamma")])).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, [(1, "alpha"), (2, "gamma")])
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.item_id == 1] == [None, *range(9)]


def test_empty(frame, queries):
    columns = ["item_id", "rank", "doc_id", "score"]
    for docs, items in (([], ITEMS), ([(1, "a b")], []), ([(1, None)], ITEMS), ([(1, "a")], [(1, "..")])):
        found = presence_masks.search(frame(docs), queries(items))
        assert found.columns == columns and found.collect() == []


def test_groups_are_left_out():
    """Once the best are known, groups that cannot reach them are not evaluated."""
    r = np.random.default_rng(1)
    impact = ((r.random((12, 4000)) < 0.3) * r.integers(1, 1000, (12, 4000))).astype(np.int32)
    items = [presence_masks.Item(np.arange(12), np.arange(1, 13) * 100)]
    ranking = presence_masks.Ranking(items, 10)
    seen = ranking.add(impact, np.arange(4000), np.ones(4000, bool))
    scores = (np.arange(1, 13) * 100) @ impact
    assert ranking.held[0][0].tolist() == sorted(scores.tolist(), reverse=True)[:10]
    assert 10 <= seen < 1500
    # More terms than a machine word has bits.
    one, group, size = presence_masks.masks(r.random((150, 40)) < 0.5)
    assert len(one) == 40 and sorted(group.tolist()) == list(range(40)) and size.tolist() == [1] * 40
