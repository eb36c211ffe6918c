"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; each is tagged toxic or not. The field has one weight per hashed feature of a token (word, its first and last bytes, the
words beside it) and weights for the tags of neighbours. The forward-backward algorithm gives each token's marginal probability of being
toxic, over the whole text as one chain. Spans are runs of tokens with a marginal of a half or more, given by their offsets in code points. A
document's score is a logistic function of the sum, the largest and the share of its marginals.

Labelled tokens come from labelled documents. A word is a marker if it stands in toxic documents far more often than in others (a likelihood
ratio test on numbers of documents, where near copies, which share the smallest hash of their word pairs, count once). In a toxic document
markers are labelled toxic; every other token is not. The field is fitted on windows of tokens.

Bounds of the fit, all parameters: TRAIN_DOCS documents of each label (those whose ids hash smallest; of rows that share an id the one
whose text hashes smallest), MARKERS words, WINDOWS windows of each kind. Scores read all documents and whole texts. Labels are the only
thing learnt from; language, source and id are no features.

Null, empty and wordless texts have no tokens and get the score of a document without toxic tokens. Null labels and labels without a
document are left out. With no toxic document to learn from, every score is 0; with only toxic ones, there are no markers and the score
is their share. Repeated rows give repeated rows, an empty table an empty result. A very long text is one chain, whose tokens are held at
once. Columns besides doc_id, text and those asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.words import _LOWER, mix, range_hashes, raw_bytes, sliced, word_edges
from tidepanel.sources.scratch import save

TRAIN_DOCS = 4000
MARKERS = 500
WINDOWS = 20_000
#: Tokens of a training window.
WIDTH = 16
#: Least likelihood ratio statistic of a marker, and how many times more often it stands in toxic documents.
LEAST_G, LEAST_RATIO = 25.0, 20.0
BITS = 18
#: Bytes of the prefix and the suffix of a word.
AFFIX = 4
CUT = 0.5
#: Steps of a block in which chains are scanned.
BLOCK = 128
FEATURES = 5


@dataclass
class Tokens:
    """Tokens of a slice of texts; text i has those from first[i] to first[i + 1]."""

    words: np.ndarray
    features: np.ndarray  # tokens x FEATURES
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def chain_starts(self) -> np.ndarray:
        out = np.zeros(len(self.words), dtype=bool)
        out[self.first[:-1][np.diff(self.first) > 0]] = True
        return out


def tokens_of(texts: pa.Array) -> Tokens:
    data, offsets = raw_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Tokens(none.view(np.uint64), np.zeros((0, FEATURES), np.uint32), np.zeros(len(offsets), np.int64), none, none, data, offsets)
    low = _LOWER[data]
    starts, ends = word_edges(low, offsets)
    hashed, first = range_hashes(low), np.searchsorted(starts, offsets)
    words = hashed(starts, ends)
    head, tail = hashed(starts, np.minimum(ends, starts + AFFIX)), hashed(np.maximum(starts, ends - AFFIX), ends)
    # Beside the ends of a text there is no word.
    before, after = np.zeros_like(words), np.zeros_like(words)
    before[1:], after[:-1] = words[:-1], words[1:]
    some = np.diff(first) > 0
    before[first[:-1][some]] = 0
    after[first[1:][some] - 1] = 0
    columns = [mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) >> np.uint64(64 - BITS) for k, h in enumerate((words, head, tail, before, after))]
    return Tokens(words, np.stack(columns, axis=1).astype(np.uint32), first, starts, ends, data, offsets)


@dataclass
class Field:
    """Weights of the chain: per feature (for the tag toxic), for a chain that starts toxic, and for pairs of tags [from, to]."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, dtype=np.float32))
    start: float = 0.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[features].sum(axis=1, dtype=np.float64), -30, 30)


def _carried(steps: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_(t-1) S_t, scaled to sum 1, for all t: steps is n x 2 x 2, v_0 is (1, 1).

    The chain is cut into blocks that are gone through side by side: first each block's product, then what enters each block, then all vectors.
    """
    n = len(steps)
    blocks = -(-n // BLOCK)
    padded = np.broadcast_to(np.eye(2), (blocks * BLOCK, 2, 2)).copy()
    padded[:n] = steps
    padded = padded.reshape(blocks, BLOCK, 2, 2)
    product = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for k in range(BLOCK):
        product = np.matmul(product, padded[:, k])
        product /= product.sum(axis=(1, 2), keepdims=True)
    enters, v = np.empty((blocks, 2)), (0.5, 0.5)
    for b, ((p, q), (r, s)) in enumerate(product.tolist()):
        enters[b] = v
        x, y = v[0] * p + v[1] * r, v[0] * q + v[1] * s
        v = (x / (x + y), y / (x + y))
    out, v = np.empty((blocks, BLOCK, 2)), enters
    for k in range(BLOCK):
        s = padded[:, k]
        v = v[:, :1] * s[:, 0] + v[:, 1:] * s[:, 1]
        v = v / v.sum(axis=1, keepdims=True)
        out[:, k] = v
    return out.reshape(-1, 2)[:n]


def marginals(model: Field, emissions: np.ndarray, chain_starts: np.ndarray) -> np.ndarray:
    """Probability of the tag toxic for each token of chains laid end to end, by forward and backward vectors."""
    n = len(emissions)
    if not n:
        return np.zeros(0)
    steps = np.exp(model.pairs)[None, :, :] * np.stack([np.ones(n), np.exp(emissions)], axis=1)[:, None, :]
    # Whatever came before, a chain starts anew.
    steps[chain_starts] = np.stack([np.ones(chain_starts.sum()), np.exp(np.clip(emissions[chain_starts] + model.start, -40, 40))], axis=1)[:, None, :]
    forward = _carried(steps)
    # b_t = S_(t+1) b_(t+1), so backwards in time with the transposed steps; behind the last token there is nothing.
    later = np.broadcast_to(np.ones((2, 2)), (n, 2, 2)).copy()
    later[1:] = steps[:0:-1].transpose(0, 2, 1)
    backward = _carried(later)[::-1]
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def fit_field(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, least_steps: int = 800, batch: int = 512, rate: float = 0.3, ridge: float = 1e-6, seed: int = 3) -> Field:
    """Maximum likelihood on windows (n x WIDTH x FEATURES, n x WIDTH tags, n window weights), by Adagrad on mini-batches.

    All windows are gone through four times or more, and as often as makes `least_steps` steps.
    """
    # Toxic tokens are rare: the field begins with the odds at which the tag stands anywhere.
    rare = np.log((labels.sum() + 1) / (labels.size + 1))
    model, rng = Field(start=rare, pairs=np.array([[0.0, rare], [0.0, rare]])), np.random.default_rng(seed)
    epochs = max(4, -(-least_steps // max(1, -(-len(features) // batch))))
    seen, seen_pairs, seen_start = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y, w = features[rows], labels[rows], weights[rows] / weights[rows].sum()
            n, width = y.shape
            starts = np.zeros((n, width), dtype=bool)
            starts[:, 0] = True
            e = model.emissions(x.reshape(-1, FEATURES)).reshape(n, width)
            p, edges = _expected(model, e)
            # Gradient of the loss: expected less observed counts.
            off = (p - y) * w[:, None]
            g = np.bincount(x.reshape(-1), weights=np.repeat(off.reshape(-1), FEATURES), minlength=1 << BITS) + ridge * model.weights
            seen += g * g
            model.weights -= (rate * g / np.sqrt(seen)).astype(np.float32)
            observed = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    observed[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b)).sum(axis=1) * w).sum()
            gp = (edges * w[:, None, None]).sum(axis=0) - observed + ridge * model.pairs
            seen_pairs += gp * gp
            model.pairs -= rate * gp / np.sqrt(seen_pairs)
            gs = float(off[:, 0].sum())
            seen_start += gs * gs
            model.start -= rate * gs / np.sqrt(seen_start)
    return model


def _expected(model: Field, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n x width) and expected numbers of tag pairs (n x 2 x 2) of windows of one width, windows side by side."""
    n, width = e.shape
    trans, odds = np.exp(model.pairs), np.stack([np.ones_like(e), np.exp(e)], axis=2)
    alpha, beta = np.empty((n, width, 2)), np.ones((n, width, 2))
    alpha[:, 0] = odds[:, 0] * np.array([1.0, np.exp(np.clip(model.start, -20, 20))])
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        alpha[:, t] = (alpha[:, t - 1] @ trans) * odds[:, t]
        alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
    for t in range(width - 2, -1, -1):
        beta[:, t] = (odds[:, t + 1] * beta[:, t + 1]) @ trans.T
        beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
    both = alpha * beta
    p = both[:, :, 1] / both.sum(axis=2)
    joint = alpha[:, :-1, :, None] * trans * (odds[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return p, joint.sum(axis=1)


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: log of one more than the expected number of toxic tokens, the largest marginal, the root of the share. Zero without tokens."""
    counts = np.diff(first)
    some = counts > 0
    out = np.zeros((len(counts), 3))
    at = first[:-1][some]
    if len(at):
        sums = np.add.reduceat(p, at)
        out[some] = np.stack([np.log1p(sums), np.maximum.reduceat(p, at), np.sqrt(sums / counts[some])], axis=1)
    return out


@dataclass
class Model:
    chain: Field
    coefficients: tuple[float, ...]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.asarray(self.coefficients) + self.intercept, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of least weighted logistic loss, with a small ridge on the coefficients; Newton's method."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    penalty = np.diag([ridge] * x.shape[1] + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (weight * (p - y)) + penalty @ w)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def sample_of(docs: DataFrame, labels: DataFrame, n_docs: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most n_docs ids of each label, one row an id; and how many ids each label has."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = save(known.join(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi"), "known")
    n = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(13), "doc_id")
    picked = [known.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(n_docs) for t in (0, 1)]
    ids = save(picked[0].unionByName(picked[1]), "picked")
    # At most 2 x n_docs ids. Rows of one id combine in each task first.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return save(one, "sample"), n


def markers(sample: DataFrame, limit: int = MARKERS) -> np.ndarray:
    """Sorted hashes of the words that mark toxic documents."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            t, toxic = tokens_of(batch.column("text")), batch.column("toxic").to_pylist()
            for i in range(batch.num_rows):
                own = t.words[t.first[i] : t.first[i + 1]]
                pairs = mix(own[:-1] * np.uint64(0xD6E8FEB86659FD93) + own[1:]) if len(own) > 1 else own
                each = np.unique(own)
                family = int(pairs.min().view(np.int64)) if len(pairs) else 0
                cols = [pa.array(each.view(np.int64)), pa.array(np.full(len(each), toxic[i], np.int32)), pa.array(np.full(len(each), family, np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "family"])

    held = save(sample.select("toxic", "text").mapInArrow(words, "word long, toxic int, family long").distinct(), "families")
    totals = held.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()
    n = {row["toxic"]: row["n"] for row in totals}
    if not n.get(1) or not n.get(0):
        return np.zeros(0, np.int64)
    counts = held.groupBy("word").agg(F.count_if(F.col("toxic") == 1).cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    both = (a + b) / F.lit(float(n[1] + n[0]))
    g = 2 * (a * F.log(a / (n[1] * both)) + F.when(b > 0, b * F.log(b / (n[0] * both))).otherwise(0.0))
    marked = counts.filter((a > 0) & (a / n[1] >= LEAST_RATIO * b / n[0])).withColumn("g", g).filter(F.col("g") >= LEAST_G)
    best = marked.orderBy(F.col("g").desc(), "word").limit(limit).select("word").toPandas()["word"]
    return np.sort(best.to_numpy(dtype=np.int64))


def windows(sample: DataFrame, marked: np.ndarray, limit: int = WINDOWS) -> DataFrame:
    """kind (0: without a marker, 1: with one), features and tags (binary) of windows; at most `limit` of each kind."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            t, toxic = tokens_of(batch.column("text")), np.asarray(batch.column("toxic").to_pylist(), dtype=bool)
            counts = np.diff(t.first)
            # All windows of the texts, end to end; the last of a text reaches back, and texts shorter than a window give none.
            at = [np.minimum(np.arange(a, a + n, WIDTH), a + n - WIDTH) for a, n in zip(t.first[:-1], counts) if n >= WIDTH]
            own = np.repeat(np.arange(len(counts)), [-(-n // WIDTH) if n >= WIDTH else 0 for n in counts])
            if not len(own):
                continue
            spans = np.concatenate(at)[:, None] + np.arange(WIDTH)[None, :]
            tags = np.isin(t.words.view(np.int64), marked)[spans] & toxic[own][:, None]
            rows = [f.tobytes() for f in t.features[spans]]
            cols = [pa.array(tags.any(axis=1).astype(np.int32)), pa.array(rows, pa.binary()), pa.array([x.tobytes() for x in tags.astype(np.uint8)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "features", "tags"])

    rows = sample.select("toxic", "text").mapInArrow(cut, "kind int, features binary, tags binary")
    # Each task keeps only its smallest hashes of each kind before they meet.
    picks = [rows.filter(F.col("kind") == k).orderBy(F.xxhash64("features"), "features").limit(limit) for k in (0, 1)]
    return picks[0].unionByName(picks[1])


def learn(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, n_windows: int = WINDOWS) -> Model | None:
    """Learns from labelled documents; labels has doc_id and toxic, and only rows that may be learnt from. None without a toxic one."""
    sample, n = sample_of(docs, labels, n_docs)
    if not n.get(1):
        return None
    chain, marked = Field(), markers(sample)
    if len(marked):
        rows = windows(sample, marked, n_windows).toPandas()
        x = np.frombuffer(b"".join(rows["features"]), dtype=np.uint32).reshape(-1, WIDTH, FEATURES)
        y = np.frombuffer(b"".join(rows["tags"]), dtype=np.uint8).reshape(-1, WIDTH).astype(float)
        order = np.lexsort((rows["features"].map(_front), rows["kind"]))
        chain = fit_field(x[order], y[order], np.ones(len(x)))
    scored = summaries(sample, chain, "toxic", "doc_id").toPandas().sort_values("doc_id")
    x, y = np.array(scored["summary"].tolist(), dtype=float).reshape(-1, 3), scored["toxic"].to_numpy(dtype=float)
    # The sample holds the labels in other shares than the table.
    taken = {t: max(1, int((y == t).sum())) for t in (0, 1)}
    weight = np.where(y == 1, n[1] / taken[1], n.get(0, 0) / taken[0])
    coefficients, intercept = logistic(x, y, weight)
    return Model(chain, tuple(coefficients.tolist()), intercept)


def _front(raw: bytes) -> int:
    return int.from_bytes(raw[:7], "little")


def summaries(docs: DataFrame, chain: Field, *keep: str) -> DataFrame:
    """keep columns of docs and `summary`."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            t = tokens_of(batch.column("text"))
            x = summary(marginals(chain, chain.emissions(t.features), t.chain_starts), t.first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*keep, "summary"])

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, summary array<double>")


TAGGED = "score double, n_words long, n_toxic long, spans array<struct<start:long,end:long,marginal:double>>"


def tag(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """keep columns of docs, score, n_words, n_toxic (tokens tagged) and spans: start and end in code points, and the largest marginal."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    chain = model.chain if model else Field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            t = tokens_of(batch.column("text"))
            p = marginals(chain, chain.emissions(t.features), t.chain_starts) if model else np.zeros(len(t.words))
            x = summary(p, t.first)
            score = model.score(x) if model else np.zeros(len(x))
            hit = p >= CUT
            # A span starts at a hit whose text has none right before it.
            begins = hit & ~(np.concatenate([[False], hit[:-1]]) & ~t.chain_starts)
            ends = hit & ~np.concatenate([(hit & ~t.chain_starts)[1:], [False]])
            a, b = np.flatnonzero(begins), np.flatnonzero(ends)
            # Code points before a byte: those that are no continuation bytes.
            points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
            own = np.searchsorted(t.first, a, "right") - 1
            base = points[t.offsets[own]]
            top = np.maximum.reduceat(np.concatenate([p, [0.0]]), np.stack([a, b + 1], axis=1).reshape(-1))[::2] if len(a) else np.zeros(0)
            spans = pa.StructArray.from_arrays(
                [pa.array(points[t.starts[a]] - base, pa.int64()), pa.array(points[t.ends[b]] - base, pa.int64()), pa.array(top, pa.float64())],
                names=["start", "end", "marginal"],
            )
            lists = pa.ListArray.from_arrays(np.searchsorted(own, np.arange(len(x) + 1)).astype(np.int32), spans)
            n_toxic = np.diff(np.concatenate([[0], np.cumsum(hit)])[t.first])
            cols = [*(batch.column(c) for c in keep), pa.array(score), pa.array(np.diff(t.first), pa.int64()), pa.array(n_toxic, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "n_words", "n_toxic", "spans"])

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, {TAGGED}")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    rows = tag(docs, learn(docs, labels), "doc_id")
    first = F.get("spans", F.lit(0))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_toxic",
        F.size("spans").cast("long").alias("n_spans"), first["start"].alias("first_start"), first["end"].alias("first_end"),
    )
