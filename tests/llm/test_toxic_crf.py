"""The field against enumeration of all tag sequences, planted markers, and held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_helpers import prose, words
from tidepanel.llm import toxic_crf


def enumerate_tags(model, e):
    total, toxic = 0.0, np.zeros(len(e))
    for tags in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(np.dot(e, tags) + model.start * tags[0] + sum(model.pairs[a, b] for a, b in zip(tags, tags[1:])))
        total, toxic = total + w, toxic + w * np.array(tags)
    return toxic / total


def some_field(seed=0):
    r = np.random.default_rng(seed)
    return toxic_crf.Field(pairs=r.normal(size=(2, 2)), start=0.4)


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxic_crf, "BLOCK", 4)
    model, lengths = some_field(), [1, 5, 3, 11, 2, 8]
    e = np.random.default_rng(1).normal(size=sum(lengths)) * 2
    starts = np.zeros(len(e), bool)
    at = np.concatenate([[0], np.cumsum(lengths)])
    starts[at[:-1]] = True
    got = toxic_crf.marginals(model, e, starts)
    for a, b in zip(at, at[1:]):
        assert np.allclose(got[a:b], enumerate_tags(model, e[a:b]), atol=1e-12)
    p, _ = toxic_crf._expected(model, e[at[3] : at[4]].reshape(1, -1))
    assert np.allclose(p[0], got[at[3] : at[4]], atol=1e-12)


def test_gradient_is_expected_less_observed():
    """The pair counts of a window are the derivative of its log partition sum."""
    model, e = some_field(3), np.random.default_rng(4).normal(size=6)

    def log_sum():
        return np.log(sum(
            np.exp(np.dot(e, t) + model.start * t[0] + sum(model.pairs[a, b] for a, b in zip(t, t[1:]))) for t in itertools.product((0, 1), repeat=6)
        ))

    _, edges = toxic_crf._expected(model, e.reshape(1, -1))
    for a in (0, 1):
        for b in (0, 1):
            before = log_sum()
            model.pairs[a, b] += 1e-6
            assert abs((log_sum() - before) / 1e-6 - edges[0, a, b]) < 1e-4
            model.pairs[a, b] -= 1e-6


def corpus(n=600):
    """Every fourth document has marker words at known places."""
    rows, labels, places = [], [], {}
    for i in range(n):
        text = prose(1000 + i, 40 + i % 30)
        if i % 4 == 0:
            w = text.split(" ")
            w[7 + i % 20] = ["Grobian", "schuft"][i // 4 % 2]
            text = " ".join(w)
            places[i] = w[7 + i % 20]
        rows.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels, places


@pytest.fixture
def labels_frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, toxic int, quality int")


def test_planted_markers(frame, labels_frame, tricky):
    rows, labels, places = corpus()
    learnt = [x for x in labels if x[0] % 5]
    docs = frame(rows + [(5000 + i, t) for i, (_, t) in enumerate(tricky)] + [(9000, "Grobian " + "x" * 100_000 + " schuft"), (9001, "a" * 2_000_000)])
    model = toxic_crf.learn(docs, labels_frame(learnt + [(1, None), (None, 1), (77777, 1)]))
    got = {r.doc_id: r for r in toxic_crf.tag(docs, model, "doc_id").collect()}
    assert len(got) == docs.count()
    for i, text in rows:
        assert (got[i].score >= 0.5) == (i in places), i
        found = [text[s.start : s.end] for s in got[i].spans]
        assert found == ([places[i]] if i in places else [])
        assert got[i].n_toxic == len(found) and got[i].n_words == len(words(text))
    assert got[9000].score >= 0.5 and got[9000].spans and got[9001].spans == []
    empty = [got[5000 + i].score for i, (_, t) in enumerate(tricky) if not words(t)]
    assert len(set(empty)) == 1 and empty[0] < 0.5


def test_offsets_are_code_points():
    t = toxic_crf.tokens_of(pa.array(["é\U0001F600 bad", None, "", "日本 x"]))
    assert t.first.tolist() == [0, 2, 2, 2, 4]


def test_one_label_or_none(frame, labels_frame):
    docs = frame([(1, "a b"), (2, None)])
    assert {r.score for r in toxic_crf.tag(docs, toxic_crf.learn(docs, labels_frame([])), "doc_id").collect()} == {0.0}
    assert {r.score for r in toxic_crf.tag(docs, toxic_crf.learn(docs, labels_frame([(1, 0)])), "doc_id").collect()} == {0.0}
    only = toxic_crf.tag(docs, toxic_crf.learn(docs, labels_frame([(1, 1), (2, 1)])), "doc_id").collect()
    assert all(0.5 < r.score <= 1 for r in only)
    assert toxic_crf.tag(frame([]), None, "doc_id").collect() == []


def test_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = toxic_crf.query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL")
    row = got.filter("held_out").join(labels, "doc_id").agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("clean"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"),
    ).first()
    # A tenth of the toxic labels of this table stand beside texts without any marker.
    assert row.right >= 0.97 and row.clean <= 0.01 and row.caught >= 0.85


def test_repeated_rows_and_ids(frame, labels_frame):
    rows, labels, _ = corpus(80)
    docs = frame(rows + rows[:1] * 50)
    got = toxic_crf.tag(docs, toxic_crf.learn(docs, labels_frame(labels)), "doc_id").filter("doc_id = 0").collect()
    assert len(got) == 51 and len({(r.score, str(r.spans)) for r in got}) == 1
