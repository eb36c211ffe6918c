"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_helpers import prose, words
from tidepanel.llm import (
    bitplanes, decontaminate, graph, hilbert_packing, licenses, lsh_forest, pairwise_quality, rendezvous, streaming_dedup, suffixes, warc,
)
from tidepanel.llm.tokens import VOCABULARY
from tidepanel.sources.scratch import folder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def by(rows):
    return Counter(tuple(r) for r in rows)


# --- 1: bit planes ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("layout", ["bit", "byte"])
def test_planes_round_trip(spark, frame, tricky, layout):
    path = f"{folder(spark)}/t-{uuid.uuid4().hex}"
    bitplanes.write(frame(tricky), path, block=512, layout=layout)
    rows = bitplanes.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in tricky), key=lambda i: (i is not None, i))
    texts = defaultdict(list)
    for i, t in tricky:
        texts[i].append(t)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        own = [ids_of(t, 2) for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in [(len(x), crc(x)) for x in own]
    assert by((r.doc_id, r.ids_crc32) for r in rows) == by((i, crc(ids_of(t, 2))) for i, t in tricky)
    at = next(r for r in rows if r.doc_id == 5)
    assert bitplanes.read_ids(spark, path, at.start, at.n_tokens).tolist() == ids_of(dict(tricky)[5], 2)
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("n_ids")).first()[0] == start
    assert index.filter("n_ids > 512").isEmpty()


def test_planes_of_wide_ids():
    x = np.array([0, 1, 70000, 2**32 - 1], dtype="<u4")
    for layout in ("bit", "byte"):
        assert (bitplanes.from_planes(bitplanes.to_planes(x, layout), 4, layout) == x).all()


def test_planes_empty(spark, frame):
    path = f"{folder(spark)}/t-{uuid.uuid4().hex}"
    bitplanes.write(frame([]), path)
    assert bitplanes.read_documents(spark, path).isEmpty()


# --- 2: licenses -----------------------------------------------------------------------------------------------------


def brute_licenses(rows):
    sets = licenses.template_sets(licenses.TEMPLATES)
    out = []
    for i, t in rows:
        w = words(t)
        hits = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        scores = defaultdict(float)
        for label, ws, need, n in sets:
            best = max((len(set(ws).intersection(w[k : k + n])) for k in range(len(w))), default=0)
            if best >= need:
                scores[label] = max(scores[label], best / len(ws))
        base = sorted({x for _, x in hits})
        at = [k for k, _ in hits]
        score = max([0.0, *scores.values(), 1.0 if hits else 0.0])
        out.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *scores})), round(score, 9)))
    return by(out)


def test_licenses(frame, tricky):
    mit, bsd = licenses.TEMPLATES["mit"][1], licenses.TEMPLATES["bsd"][0]
    cut = " ".join(w for k, w in enumerate(bsd.split(" ")) if k % 6)
    rows = tricky + [
        (20, "cc by cc by CC-BY. General Public\nLicense"), (21, "Licensed under the Apache License, Version 2.0"),
        (22, "Licensed, under the apache licence version 2.0\nx"), (23, "released under a MIT license\n\nThe MIT license"), (24, "rights reserved all"),
        (25, "work released into public domain has been the"), (26, "All\nrights reserved"),
        (27, f"{prose(2, 50)} {mit} {prose(3, 50)}".replace(" ", "\n", 120)), (28, bsd.replace(" ", " \r\n// ")), (29, cut),
        (30, "\n".join(t for texts in licenses.TEMPLATES.values() for t in texts)), (31, f"{cut} {bsd} {bsd}"), (32, "software " * 3000),
        (33, " all ".join(prose(k, 500) for k in (4, 5)) + " rights " + prose(6, 500) + " reserved"), (34, mit[: len(mit) // 2]),
    ]
    got = licenses.scan(frame(rows)).collect()
    assert by((*r[:-1], round(r.score, 9)) for r in got) == brute_licenses(rows)
    labels = {r.doc_id: r.labels.split(",") for r in got}
    assert "rights-reserved" in labels[26] and "mit" in labels[27] and "bsd" in labels[28]
    assert labels[33] == labels[34] == [""]


def test_license_blocks_anywhere(frame):
    """Windows of random words over a small lexicon, where most places are near misses."""
    templates = {"a": [prose(11, 14, 20)], "b": [prose(12, 30, 20)], "c": [prose(13, 3, 20)]}
    rows = [(i, prose(i, 60, 20) if i % 2 else prose(i, 40, 20) + " " + " ".join(reversed(templates["b"][0].split()))) for i in range(40)]
    lexicon = [w for t in templates.values() for w in t[0].split()]
    rows += [(100 + i, " ".join(lexicon[(i * 7 + k * (i + 1)) % len(lexicon)] for k in range(50))) for i in range(40)]
    got = sorted((r.label, round(r.score, 9)) for r in licenses.matches(frame(rows), templates).collect())
    want = []
    for _, text in rows:
        w = words(text)
        for label, ws, need, n in licenses.template_sets(templates):
            best = max(len(set(ws).intersection(w[k : k + n])) for k in range(len(w)))
            want += [(label, round(best / len(ws), 9))] if best >= need else []
    assert got == sorted(want) and 0 < len(want) < 3 * len(rows)


def test_licenses_empty(frame):
    assert licenses.scan(frame([])).isEmpty()
    assert licenses.scan(frame([(1, "x")]), templates={}).first().labels == ""


# --- 3: streaming deduplication --------------------------------------------------------------------------------------


def brute_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        g = groups[n]
        out.append((i, min(g)[2], len(g)))
    return by(out)


def weak(text):
    """Only a few digests, so that different texts collide."""
    return F.unhex(F.lpad(F.hex(F.pmod(F.length(text), F.lit(3)).cast("long")), 2, "0"))


@pytest.mark.parametrize("digest", [streaming_dedup.sha256, weak])
def test_exact_classes(frame, tricky, digest):
    got = streaming_dedup.classes(frame(tricky).select("doc_id", "text"), digest)
    assert by(got.select("doc_id", "best.doc_id", "n").collect()) == brute_classes(tricky)


def test_exact_dedup_keeps_columns(frame, tricky):
    docs = frame(tricky)
    got = streaming_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert got.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in tricky})
    assert streaming_dedup.dedup(frame([])).isEmpty()


def test_state_goes_on(spark, frame):
    """A second run with the same checkpoint takes only what is new; nothing expires."""
    base = f"{folder(spark)}/t-{uuid.uuid4().hex}"
    first = streaming_dedup.fingerprints(streaming_dedup.located(frame([(1, "a b"), (2, "c")]).select("doc_id", "text")))
    first.write.parquet(f"{base}/in")
    state = streaming_dedup.keyed_state(spark, f"{base}/in", first.schema, f"{base}/state")
    assert sorted(r.n for r in state.collect()) == [1, 1]
    streaming_dedup.fingerprints(streaming_dedup.located(frame([(3, "ab "), (4, "d")]).select("doc_id", "text"))).write.mode("append").parquet(f"{base}/in")
    state = streaming_dedup.keyed_state(spark, f"{base}/in", first.schema, f"{base}/state")
    assert sorted((r.best.doc_id, r.n) for r in state.collect()) == [(1, 2), (2, 1), (4, 1)]


# --- 4: rendezvous ---------------------------------------------------------------------------------------------------


def test_rendezvous(frame, tricky):
    rows = tricky + [(100 + i, f"text {i}") for i in range(400)]
    got = rendezvous.assign(frame(rows), rendezvous.even(16), rendezvous.even(17)).collect()
    assert by((r.doc_id, r["size"], r.text_crc32) for r in got) == by((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert rendezvous.assign(frame([]), rendezvous.even(4)).isEmpty()


def test_weights(spark):
    ids = spark.range(20000)
    shares = ids.groupBy(rendezvous.shard_of(F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).count().collect()
    assert abs({r.s: r["count"] for r in shares}[1] / 20000 - 0.75) < 0.02
    before, after = rendezvous.shard_of(F.col("id"), {0: 1.0, 1: 3.0}), rendezvous.shard_of(F.col("id"), {0: 1.0, 1: 3.0, 2: 2.0})
    assert ids.filter((before != after) & (after != 2)).isEmpty()
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.col("id"), {0: 0.0})


# --- 5: decontamination ----------------------------------------------------------------------------------------------


def brute_contamination(rows, items, size=13):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(i)
    lengths = {len(g) for g in grams}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return by(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, frame, tricky, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    item = prose(9, 40)
    items = [(1, item), (2, "alpha beta"), (3, ""), (4, None), (None, "gamma delta"), (5, item), (10, "one two three four")]
    rows = tricky + [(30, prose(2, 90) + " " + " ".join(item.split()[5:22]) + " " + prose(3, 700)), (31, item.upper()), (32, "ONE two, three-four alpha")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(decontaminate.find_hits(frame(rows), bench)).collect()
    assert by((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == brute_contamination(rows, items)


def test_removal(spark, frame, tricky):
    item = prose(9, 40)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = tricky + [(30, "Keep this.\n" + item.replace(" ", ", ") + " -- and: this!"), (31, prose(4, 3000) + " " + " ".join(item.split()[:13]))]
    docs = frame(rows)
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, _ in rows if i != 30)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).filter("doc_id >= 30").collect()}
    assert cut[30] == "Keep this -- and: this!"
    assert words(cut[31]) == words(rows[-1][1])[:-13]
    same = decontaminate.remove_spans(docs, bench).filter("doc_id < 30 OR doc_id IS NULL")
    assert by(map(tuple, same.select("doc_id", "text").collect())) == by(tricky)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(docs, nothing).count() == len(rows)
    assert decontaminate.find_hits(frame([]), bench).isEmpty()


# --- 6: pairwise quality ---------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = pairwise_quality.query(spark, big)
    assert got.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_learns_from_labels_alone(spark, sf_dir):
    """Held-out labels have no part in the model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(pairwise_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    fit = lambda x: pairwise_quality.fit(docs, pairwise_quality.learnable(x))
    assert fit(labels) == fit(turned)


def test_quality_cut_covers_all_labels(spark, frame):
    """With a small sample for the weights, quantile and spread are still those of all labelled documents."""
    texts = [(i, prose(i, 20 + i % 90) + (" !!! ### @@@" * (i % 7) if i % 3 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int")
    model = pairwise_quality.fit(frame(texts), labels, rows=6)
    raw = np.sort([np.asarray(pairwise_quality.features(t)) @ np.asarray(model.weights) for _, t in texts])
    upto = np.arange(1, 241) / 240
    k = int(np.searchsorted(upto, 160 / 240 * (1 - 1e-9)))
    assert model.cut == pytest.approx((raw[k] + raw[k + 1]) / 2, abs=1e-9)
    assert model.scale == pytest.approx(pairwise_quality.STEEP / raw.std())


def test_quality_repeated_ids_count_once(spark, frame):
    """A doc_id with most of the rows is one document to learn from."""
    texts = [(i, prose(i, 20 + i % 90) + (" !!! ### @@@" * (i % 7) if i % 3 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    once, often = (pairwise_quality.fit(frame(x), labels) for x in (texts, texts + [texts[1]] * 300))
    assert often.weights == pytest.approx(once.weights, rel=1e-6, abs=1e-9)
    assert (often.cut, often.scale) == pytest.approx((once.cut, once.scale), rel=1e-6)


def test_quality_awkward(spark, frame, tricky):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 0, 0), (8, 0, 0), (None, 1, 0), (7, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(tricky)
    model = pairwise_quality.fit(docs, labels)
    got = pairwise_quality.scores(docs, model, "doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in tricky) and all(0 <= r.score <= 1 for r in got)
    flat = pairwise_quality.fit(docs, labels.filter("quality = 1"))
    assert {round(r.score, 6) for r in pairwise_quality.scores(docs, flat, "doc_id").collect()} == {0.7}
    assert pairwise_quality.scores(frame([]), model, "doc_id").isEmpty()
    assert pairwise_quality.keep_good(docs, labels).columns == docs.columns


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(0)
    x, true = rng.standard_normal((400, 3)), np.array([2.0, -1.0, 0.0])
    i, j = rng.integers(0, 400, (2, 20000))
    won = rng.random(20000) < 1 / (1 + np.exp(-(x[i] - x[j]) @ true))
    w = pairwise_quality.bradley_terry(np.where(won[:, None], x[i] - x[j], x[j] - x[i]))
    assert np.abs(w - true).max() < 0.15


# --- 7: WARC derivatives ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- gone -->
<h1>Head</h1><p>One <b>bold</b> &lt;x&gt;</p><p>Two<br>three</p><a href="/u?a=1&amp;b=2">link</a></body></html>"""


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a", PAGE), (2, None, None), (None, "http://c", ""), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses(pages).withColumn("block", F.lit(1))).collect()
    assert Counter(r.warc_type for r in rows) == {"metadata": 4, "conversion": 4}
    text = next(r for r in rows if r.page_id == 1 and r.warc_type == "conversion")
    meta = next(r for r in rows if r.page_id == 1 and r.warc_type == "metadata")
    assert text.block == "Head\nOne bold <x>\nTwo\nthree\nlink"
    assert "title: A & B\r\n" in meta.block and "language: fr\r\n" in meta.block and "outlink: /u?a=1&b=2\r\n" in meta.block
    import base64

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in (text, meta):
        assert r.source_digest == sha(PAGE.encode()) and r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and "WARC-Target-URI: http://a\r\n" in r.header
    assert text.refers_to == meta.refers_to and len({text.record_id, meta.record_id, text.refers_to}) == 3
    assert warc.derive(warc.responses(pages.limit(0))).isEmpty()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<head><title>a <p> b</title><meta charset=utf-8><script>x('<p></head>')</script><body class=x><p>One</p>Two", "One\nTwo"),
        ("<html><head><link rel=x><style>p {}</style>\n<p>One<header>Two</header>", "One\nTwo"),
        ("<head><title>t</title>Words at once", "Words at once"),
        ("<head><title>t</title></head><body><noscript>One<p>Two <template>three", "One\nTwo three"),
        ("<head><title>t</title><object>gone</object></head>One<script>lost", "One"),
        ("<p>One</p><script>never closed <p>Two", "One"),
    ],
)
def test_unclosed_elements(page, text):
    assert warc.text_of_page(page) == text


def test_metadata_keeps_http_headers():
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT\r\nX-Long: a\r\n  b\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Empty:\r\nVary: x\r\n\r\n"
    lines = warc.metadata_of("", http, "").split("\r\n")
    assert lines[:2] == ["http-status: 200", "http-content-type: text/html"]
    assert [x.removeprefix("http-header: ") for x in lines if x.startswith("http-header: ")] == [
        "Content-Type: text/html; charset=utf-8", "Last-Modified: Mon, 01 Jan 2024 00:00:00 GMT", "X-Long: a b", "Set-Cookie: a=1", "Set-Cookie: b=2", "X-Empty: ", "Vary: x",
    ]


def test_derivative_files(spark, sf_dir):
    path = f"{folder(spark)}/t-{uuid.uuid4().hex}"
    records = warc.query(spark, sf_dir)
    warc.write(records.coalesce(1), path)
    data = b"".join(r.content for r in spark.read.format("binaryFile").load(path).collect())
    n = at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        length = int(re.search(rb"Content-Length: (\d+)", data[at:head])[1])
        assert data[head + 4 + length : head + 8 + length] == b"\r\n\r\n"
        at, n = head + 8 + length, n + 1
    assert n == records.count() == 2 * spark.read.parquet(f"{sf_dir}/pages.parquet").count()


# --- 8: LSH forest ---------------------------------------------------------------------------------------------------


def shingles(text, size=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_join(rows, threshold=0.8):
    """(doc_id, class_id, n_links) with links between different sets; and the number of classes with words."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    links, parent = Counter(), {s: s for s in kinds}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a in range(len(kinds)):
        for b in range(a):
            x, y = kinds[a], kinds[b]
            if len(x & y) >= threshold * len(x | y):
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    first = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        if s:
            first[root(s)].append((i is None, i))
    return by((i, min(first[root(s)])[1] if s else i, links[s]) for (i, _), s in zip(rows, sets)), len(first)


def variants(seed, n, edits, many):
    import random

    r, base = random.Random(seed), prose(seed, n).split()
    for _ in range(many):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n)] = f"edit{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [256, 7])
def test_near_join(frame, tricky, block):
    texts = [*variants(1, 120, 4, 30), *variants(2, 300, 9, 20), *variants(3, 60, 2, 10), *(prose(100 + i, 80) for i in range(30))]
    rows = tricky + [(1000 - i, t) for i, t in enumerate(texts)]
    got = lsh_forest.join(frame(rows), block=block).select("doc_id", "class_id", "n_links").collect()
    assert by(got) == brute_join(rows)[0]


def test_near_join_shortens_prefixes(frame):
    """Whole labels of 12 values find too few of the links near the threshold; shorter ones find all."""
    rows = list(enumerate(variants(5, 200, 5, 25)))
    got = lsh_forest.join(frame(rows), trees=16, longest=12).select("doc_id", "class_id", "n_links").collect()
    assert by(got) == brute_join(rows)[0]


def test_near_join_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert by(lsh_forest.query(spark, sf_dir).select("doc_id", "class_id", "n_links").collect()) == brute_join(rows)[0]


def test_forest_depths(frame):
    """A hot node stops where the recall is met, small ones are shortened on; whatever the batches, nodes are those of plain grouping."""
    rows = list(enumerate([*variants(1, 200, 2, 120), *variants(2, 200, 8, 12), *(prose(100 + i, 80) for i in range(30))]))
    limit = lsh_forest.target_depth(0.8, 32, 8, 0.999)
    assert limit == 7 and lsh_forest.chance(0.8, 7, 32) >= 0.999 > lsh_forest.chance(0.8, 8, 32)
    _, sets = lsh_forest.signed(streaming_dedup.located(frame(rows).select("doc_id", "text")))
    nodes = lsh_forest.forest(sets, 32, 8, limit, limit - 2)
    labels = {bytes(r.set): np.frombuffer(r.label, np.uint16).reshape(32, 8) for r in sets.collect()}
    want = set()
    for tree in range(32):
        for d in (7, 6, 5):
            groups = defaultdict(set)
            for k, v in labels.items():
                groups[v[tree, :d].tobytes()].add(k)
            shorter = defaultdict(set)
            for k, v in labels.items():
                shorter[v[tree, : d - 1].tobytes()].add(k)
            for prefix, own in groups.items():
                stops = d == 5 or len(shorter[prefix[:-2]]) > lsh_forest.SMALL
                if len(own) > 1 and stops and (d == 7 or len(own) <= lsh_forest.SMALL):
                    want.add((tree, d, frozenset(own)))
    got = defaultdict(set)
    for r in nodes.collect():
        got[r.node, r.depth].add(bytes(r.set))
    assert {(node & 255, d, frozenset(own)) for (node, d), own in got.items()} == want
    assert {d for _, d, _ in want} >= {5, 7} and {r.depth for r in lsh_forest.depths(nodes).collect()} == {d for _, d, _ in want}


def test_commons_of_repeated_postings(monkeypatch):
    monkeypatch.setattr(lsh_forest, "POSTINGS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 40, 40, 80, 3)]
    commons = lsh_forest._Commons(sets)
    for i, a in enumerate(sets):
        assert commons.of(i).tolist() == [len(np.intersect1d(a, b)) for b in sets]


def test_near_join_keeps_one(frame, tricky):
    docs = frame(tricky)
    kept = lsh_forest.keep_first(docs)
    assert kept.columns == docs.columns
    alone = sum(not words(t) for _, t in tricky)
    assert kept.count() == alone + brute_join(tricky)[1]
    assert lsh_forest.join(frame([])).isEmpty()
    assert lsh_forest.join(frame([(1, None), (2, "")])).count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# --- 9: sparse suffixes ----------------------------------------------------------------------------------------------


def brute_spans(rows, length=50):
    docs = {}
    for i, t in rows:
        docs[(i, t)] = words(t)
    where = defaultdict(set)
    for d, w in docs.items():
        for k in range(len(w) - length + 1):
            where[tuple(w[k : k + length])].add(d)
    out = set()
    for d, w in docs.items():
        hit = set()
        for k in range(len(w) - length + 1):
            if len(where[tuple(w[k : k + length])]) > 1:
                hit |= set(range(k, k + length))
        start = None
        for k in range(len(w) + 1):
            if k in hit and start is None:
                start = k
            if k not in hit and start is not None:
                out.add((d[0], start, k - start))
                start = None
    return out


def test_repeats(spark, frame, tricky):
    p, q, short = prose(11, 70), prose(12, 400), prose(13, 49)
    rows = tricky + [(100 + i, f"{prose(200 + i, 150)} {p} {prose(300 + i, 90)}") for i in range(40)]
    rows += [(200, f"{q} {prose(400, 60)}"), (201, f"{prose(401, 10)} {q}"), (202, f"{prose(402, 80)} {short} {prose(403, 80)}"), (203, f"{short} {prose(404, 80)}")]
    rows += [(204, f"{prose(14, 60)} x {prose(14, 60)}"), (205, f"{p} {p}"), (206, prose(15, 50)), (207, prose(15, 50) + " more"), (208, p.upper())]
    got = suffixes.repeats(frame(rows))
    found = {(r.doc_id, r.start_word, r.n_words) for r in got.collect()}
    assert found == brute_spans(rows)
    other = {r.doc_id: r.other_id for r in got.collect()}
    assert other[200] == 201 and other[201] == 200
    named = suffixes.span_text(frame(rows), got).filter("doc_id = 200").first()
    assert named.passage == " ".join(words(q))
    assert suffixes.repeats(frame([])).isEmpty() and suffixes.repeats(frame([(1, None), (2, "x")])).isEmpty()


def test_repeats_with_far_partners(frame):
    """Pairs share their own words before a common line; after it each document goes on by itself, so partners lie anywhere in the order."""
    line = prose(500, 40)
    rows = [(2 * i + k, f"{prose(6000 + 2 * i + k, 60)} {prose(7000 + i, 15)} {line} {prose(8000 + 2 * i + k, 60)}") for i in range(60) for k in (0, 1)]
    rows += [(None, rows[0][1] + " more"), (3000, rows[9][1])]
    got = suffixes.repeats(frame(rows)).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == brute_spans(rows)
    assert all(r.other_id == (r.doc_id ^ 1) for r in got if r.doc_id is not None and 20 <= r.doc_id < 120)


def test_repeats_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = suffixes.query(spark, sf_dir).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == brute_spans(rows)


# --- 10: packing -----------------------------------------------------------------------------------------------------


def check_packing(pieces, rows, sequence=2048):
    docs, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[(p.doc_id, p.doc_tokens)].append(p)
        places[p.sequence_id].append((p.offset, p.length, p.sequence_tokens))
    for parts in places.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= sequence and at & (at - 1) == 0
    want = defaultdict(list)
    for i, t in rows:
        ids = ids_of(t, 1)
        want[(i, len(ids))].append(ids)
    assert docs.keys() == want.keys()
    for k, parts in docs.items():
        assert sum(p.length for p in parts) == sum(map(len, want[k]))
        for p in parts:
            assert p.ids_crc32 in [crc(ids[p.start : p.start + p.length]) for ids in want[k]]
        starts = Counter((p.start, p.length) for p in parts)
        if len(want[k]) == 1:
            at = 0
            for start, length in sorted(starts):
                assert start == at
                at += length


@pytest.mark.parametrize("sequence", [2048, 64])
def test_packing(frame, tricky, sequence):
    rows = tricky + [(50 + i, prose(i, 30 + i)) for i in range(60)]
    check_packing(hilbert_packing.pack(frame(rows), sequence=sequence).collect(), rows, sequence)
    assert hilbert_packing.pack(frame([])).isEmpty()
    with pytest.raises(ValueError):
        hilbert_packing.pack(frame(rows), sequence=100)


def test_curve():
    import itertools

    p = np.array(list(itertools.product(range(4), repeat=3)))
    h = hilbert_packing.hilbert_index(p, 2)
    assert sorted(h) == list(range(64))
    assert (np.abs(np.diff(p[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_are_similar(frame):
    """Documents of two vocabularies lie apart on the curve."""
    import random

    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(80))) for i in range(60)]
    order = [x.doc_id % 2 for x in hilbert_packing.along_curve(frame(rows)).coalesce(1).collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) < 15


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, monkeypatch):
    """Each stage keeps what a plain version keeps of the rows before it, and the pieces hold all of the last ones."""
    import corpus_pipeline

    paths = []

    def watched(stage):
        def run(session, docs, folder_):
            paths.append(docs)
            return stage(session, docs, folder_)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(f)) for name, f in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    raw, good, exact, near, clean = ([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in paths)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in paths[1:])

    labels = pairwise_quality.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = pairwise_quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    score = lambda t: model.score(np.array([pairwise_quality.features(t)]))[0]
    assert by(good) == by((i, t) for i, t in raw if score(t) >= pairwise_quality.CUT)
    assert 0 < len(good) < len(raw)

    first = {}
    for i, t in good:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        first[key] = min(first.get(key, (-len(t or ""), i)), (-len(t or ""), i))
    assert sorted(i for i, _ in exact) == sorted(i for _, i in first.values())

    # No repeated ids: a document stays that is the first of its class.
    classes = brute_join(exact)[0]
    assert sorted(i for i, _ in near) == sorted(i for i, c, _ in classes if i == c)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = brute_contamination(near, items)
    assert sorted(i for i, _ in clean) == sorted(r[0] for r in judged if not r[-1])
    check_packing(pieces, clean)
