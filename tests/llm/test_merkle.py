"""The manifest against a tree built with hashlib alone."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from corpus_helpers import prose
from tidepanel.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, chunk int, leaf string, path string, n int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, tampered=False):
    doc_id, source, lang, n_chars, text = r
    if tampered and doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
        n_chars += 1
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def climb(tree, at, now, arity):
    """(siblings, root that follows from `now` at place `at`)."""
    others = []
    for level in tree[:-1]:
        first = at - at % arity
        run = level[first : first + arity]
        slot = at - first
        others += run[:slot] + run[slot + 1 :]
        now = sha("".join([*run[:slot], now, *run[slot + 1 :]]))
        at //= arity
    return others, now


def brute(rows, arity):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        order[lang], trees[lang] = own, levels([leaf_of(r) for r in own], arity)
    top = levels([trees[x][-1][0] for x in langs], arity)
    out = []
    for place, lang in enumerate(langs):
        for at, r in enumerate(order[lang]):
            below, sub = climb(trees[lang], at, leaf_of(r, True), arity)
            above, root = climb(top, place, sub, arity)
            out.append((r[0], leaf_of(r), trees[lang][-1][0], top[-1][0], sha("".join(below + above)), root, root == top[-1][0]))
    return Counter(out)


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1, 1, "x", "x", 1) for r in rows], DOCS).repartition(3)

    return make


LONG = prose(4, 30000)
AWKWARD = [
    (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abd"), (None, None, None, None, None), (None, None, None, None, None),
    (7, None, "de", None, ""), (8, "é日本", "é", 2, LONG), (9, "s", "", 0, ""), (-5, "s", "en", 1, "x"), (10, "s", None, 4, "\U0001F600"),
]
MANY = AWKWARD + [(100 + i, f"src{i % 3}", ["en", "en", "fr", None][i % 4], i, f"text {i}") for i in range(90)]


@pytest.mark.parametrize("arity,chunk", [(2, 4), (2, 4096), (3, 9), (5, 5)])
def test_manifest(docs, arity, chunk):
    got = merkle.verify(merkle.build(merkle.leaves_of(docs(MANY)), arity, chunk)).collect()
    assert Counter(tuple(r) for r in got) == brute(MANY, arity)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


@pytest.mark.parametrize("rows", [MANY[:1], AWKWARD[3:4], AWKWARD])
def test_small_tables(docs, rows):
    got = merkle.verify(merkle.build(merkle.leaves_of(docs(rows)))).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 2)


def test_empty(docs):
    assert merkle.verify(merkle.build(merkle.leaves_of(docs([])))).collect() == []


def test_states_resume(spark):
    """A parent's state before a slot, then the replacement and what is right of it, is the hash of the run."""
    nodes = np.random.default_rng(2).integers(0, 256, (11, 32), dtype=np.uint8)
    for arity in (2, 3, 4):
        digests, states = merkle.parents_of(nodes, arity)
        for at in range(len(nodes)):
            run = nodes[at - at % arity :][: arity].tolist()
            run[at % arity] = [0] * 32
            want = hashlib.sha256("".join(bytes(x).hex() for x in run).encode()).digest()
            path = merkle.records([nodes], [states], np.array([at]), arity)
            assert merkle.fold(np.zeros((1, 32), np.uint8), path, arity)[0].tobytes() == want
        assert digests[0].tobytes() == hashlib.sha256(b"".join(x.tobytes().hex().encode() for x in nodes[:arity])).digest()


def test_arity_is_checked(docs):
    with pytest.raises(ValueError):
        merkle.build(merkle.leaves_of(docs(AWKWARD)), arity=1)
