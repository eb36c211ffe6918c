"""Quality classifier by Bradley-Terry ranking: scores learnt from preference pairs, then cut at a score quantile.

A labelled good document is preferred to a labelled bad one. The score of a document is a weighted sum of features of its text, and the
weights minimise the logistic loss of the feature differences of the pairs (a Bradley-Terry model; no intercept, since it cancels). The cut
is the quantile of the scores of all labelled documents at the share of bad documents among the labels, halfway to the next higher score;
scores are then put on (0, 1) so that the cut is 0.7, in units of the spread of the same scores.

The weights are fitted on the driver on at most TRAIN_ROWS documents of each label, those whose id hashes smallest, and at most TRAIN_PAIRS
pairs of them; both are parameters. The quantile and the spread are exact and computed on Spark. Labels are the only thing learnt from; language, source and id are no features. All documents are scored, whole texts.

Null and empty texts have the features of a text without words and get a score like any other. Null labels and labels without a document
are left out. With only one label there, or none, there are no pairs: every score is 0.7. Rows that share a doc_id are learnt
from as one document with the mean of their features. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ordered import ordered_running_sum
from tidepanel.llm.words import sliced
from tidepanel.sources.scratch import save

TRAIN_ROWS = 6000
TRAIN_PAIRS = 60_000
#: Labels up to which they are broadcast to the documents; beyond, both are exchanged.
BROADCAST_LABELS = 500_000
CUT = 0.7
RIDGE = 1e-3
#: Half of the scores' spread around the cut, in units of the labelled documents' own spread.
STEEP = 4.0

FEATURES = (
    "log_words", "letters", "capitals", "digits", "marks", "odd_marks", "blanks", "distinct_words", "repeats", "top_word", "word_length",
    "capital_words", "marked_words", "lines_again", "bars", "loud", "sentences", "unreadable",
)

_CLASS = np.zeros((256, 7), dtype=bool)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        _c.isalpha() if _b < 128 else True, _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), 32 < _b < 127 and not _c.isalnum(),
        _c in "#$%&*+<=>@[\\]^_`{|}~", _c in " \t\n\r", _b < 32 and _c not in "\t\n\r",
    ]
_CLASS = _CLASS.astype(np.float64)
_LOUD = re.compile(r"[!?]{2,}")
_END = re.compile(r"[.!?](?:\s|$)")


def features(text: str | None) -> list[float]:
    """Shares and counts of one text, each within a few units."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(data))
    letters, capitals, digits, marks, odd, blanks, control = np.bincount(data, minlength=256) @ _CLASS / n
    words = text.split()
    m = max(1, len(words))
    # Arrays of fixed-size codes instead of Python loops over the words.
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    _, counts = np.unique(codes, return_counts=True) if len(codes) else (None, np.zeros(1, dtype=np.int64))
    same = float((codes[1:] == codes[:-1]).sum()) / m if len(codes) > 1 else 0.0
    lines = [x for x in text.split("\n") if x]
    ends = len(_END.findall(text))
    return [
        np.log1p(len(words)) / 10, letters, capitals, digits, marks, odd, blanks,
        float((counts > 0).sum()) / m, same, float(counts.max()) / m, min(30.0, len(text) / m) / 10,
        sum(map(str.isupper, words)) / m, len(_LOUD.findall(text)) / m + sum(w[-1] in "#$%&*" for w in words) / m,
        1 - len(set(lines)) / len(lines) if lines else 0.0, text.count("|") / m, text.count("!!") / m, min(1.0, ends / m * 5),
        control + text.count("�") / n,
    ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        values = [features(t.as_py()) for t in batch.column("text")]
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(values, type=pa.list_(pa.float64()))], names=[*names, "features"])


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns of docs and `features`."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_rows, f"{kinds}{', ' if kinds else ''}features array<double>")


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(scale * (features . weights - cut) + logit(0.7))))"""

    weights: tuple[float, ...]
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.scale * (x @ np.asarray(self.weights) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def pairs_of(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int = 7) -> np.ndarray:
    """Feature differences good - bad of `pairs` preference pairs, all documents used about equally often."""
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    i = np.concatenate([rng.permutation(len(good)) for _ in range(-(-n // max(1, len(good))))])[:n]
    j = np.concatenate([rng.permutation(len(bad)) for _ in range(-(-n // max(1, len(bad))))])[:n]
    return good[i] - bad[j]


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Weights of least mean logistic loss of the differences, with a small ridge; Newton's method."""
    spread = differences.std(axis=0) + np.abs(differences.mean(axis=0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    d, w = differences / spread, np.zeros(differences.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = ridge * w - d.T @ p / len(d)
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        # Newton steps may overshoot while the pairs are nearly separable.
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return w / spread


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, pairs: int = TRAIN_PAIRS) -> Model:
    """Learns from labelled documents; `labels` has doc_id and quality, and only rows that may be learnt from."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share, n = known.agg(F.avg(1 - F.col("quality")), F.count(F.lit(1))).first()
    joined = docs.join(F.broadcast(known) if n <= BROADCAST_LABELS else known, "doc_id")
    # Rows of one id are one document, with the mean of their features: combined in each task first, however many they are.
    means = [F.avg(F.get("features", F.lit(i))).alias(f"f{i}") for i in range(len(FEATURES))]
    per_id = with_features(joined, "quality", "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), *means)
    labelled = save(per_id.select("doc_id", "quality", F.array(*[f"f{i}" for i in range(len(FEATURES))]).alias("features")), "labelled")
    order = F.xxhash64(F.lit(11), "doc_id")
    picked = [labelled.filter(F.col("quality") == q).select("doc_id").orderBy(order, "doc_id").limit(rows) for q in (0, 1)]
    sample = labelled.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").toPandas()
    # The order is fixed, so the model is.
    sample = sample.sort_values("doc_id")
    x = {q: np.array(sample.loc[sample["quality"] == q, "features"].tolist(), dtype=float) for q in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return Model((0.0,) * len(FEATURES), 0.0, 1.0)
    weights = bradley_terry(pairs_of(x[1], x[0], pairs))
    cut, spread = cut_of(labelled, weights, float(share))
    return Model(tuple(weights.tolist()), cut, float(STEEP / max(1e-9, spread)))


def cut_of(labelled: DataFrame, weights: np.ndarray, share: float) -> tuple[float, float]:
    """Quantile at `share` of the scores of all rows (quality, features), and the scores' spread. Only a few numbers reach the driver."""
    raw = reduce(lambda a, b: a + b, [F.get("features", F.lit(i)) * float(w) for i, w in enumerate(weights)])
    scored = labelled.select("quality", raw.alias("raw"))
    bad = F.col("quality") == 0
    counts = save(scored.groupBy("raw").agg(F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good")), "score_counts")
    spread = scored.agg(F.stddev_pop("raw")).first()[0]
    n_bad, n_good = counts.agg(F.sum("bad"), F.sum("good")).first()
    run = ordered_running_sum(counts, [], [F.col("raw")], {"bad_upto": F.col("bad"), "good_upto": F.col("good")})
    # The labels' own share of bad documents sets the quantile, whatever that of the documents is.
    upto = F.col("bad_upto") * (share / n_bad) + F.col("good_upto") * ((1 - share) / n_good)
    below = run.filter(upto >= share * (1 - 1e-9)).agg(F.min("raw")).first()[0]
    above = counts.filter(F.col("raw") > below).agg(F.min("raw")).first()[0]
    return (below + (below if above is None else above)) / 2, spread


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns of docs, score."""
    rows = with_features(docs, *keep)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(len(x), -1)))

    return rows.select(*keep, score("features").alias("score"))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of 0.7 or more, with all their columns."""
    model = fit(docs.select("doc_id", "text"), learnable(labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in text], dtype=float).reshape(len(text), len(FEATURES))
        return pa.array(model.score(x))

    return docs.filter(score("text") >= CUT)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = scores(docs, model, "doc_id")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
