"""Ranked lexical search by presence masks: an item's documents are grouped by which of its terms they hold.

One pass over the documents keeps, per document, its number of terms and the frequencies of the query terms in it, as codes. The statistics
(N, L, df) are sums over that table, so they cover all documents. A second pass ranks: a task takes the documents in blocks, lays out the
block as one row of contributions per term, and for each item packs the rows of its terms into a bitmap per document, the mask. Documents
with equal masks are one group, and a group's maximum score is the sum over its terms of weight x largest contribution in the block. Groups are
evaluated by descending maximum, until the item has TOP documents and no group left can reach the last of them. Scores are exact 64-bit
integers. A task hands on at most TOP documents an item, which are merged per item.

Items are the stated queries. They are taken in blocks of about ITEMS, and only a block's items are held by driver and tasks; a larger
benchmark means more passes over the documents. Equal rows of the benchmark are one item; items that share an id are ranked on their own.

Null and empty texts have no terms and are never found; items without terms, and a corpus without terms, have no rows. Rows of documents with
equal or null ids are documents of their own; null ids come first among equal scores. Texts of any length are read whole, a megabyte
of texts at a time (a longer text at once). Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.words import sliced, word_bytes
from tidepanel.sources.scratch import save

TOP = 10
#: Items of a block, about.
ITEMS = 512
#: Cells of a block of documents: its documents x the terms of the items.
CELLS = 1 << 21
POSTINGS = "doc_id long, n long, codes array<int>, counts array<int>"


def _coded(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """Per text with a term: how many it has, and the codes and frequencies of those that are query terms."""
    for batch in sliced(batches):
        words, first = word_bytes(batch.column("text"))
        codes = pc.index_in(words, value_set=terms)
        at = np.flatnonzero(pc.is_valid(codes).to_numpy(zero_copy_only=False))
        own = np.searchsorted(first, at, "right") - 1
        pairs, counts = np.unique(own * max(1, len(terms)) + codes.drop_null().to_numpy().astype(np.int64), return_counts=True)
        row, code = np.divmod(pairs, max(1, len(terms)))
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (code, counts)]
        n = np.diff(first)
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "codes", "counts"])
        yield out.filter(pa.array(n > 0))


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """POSTINGS of all documents with a term."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    values = pa.array(terms, pa.large_binary())
    return save(rows.mapInArrow(lambda b: _coded(b, values), POSTINGS), "postings")


def frequencies(table: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each query term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("codes").flatten().to_numpy(), minlength=n_terms)
        code = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(held[code], pa.int64())], names=["code", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    # One row per query term of the block of items.
    for row in table.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] = row["n"]
    return out


@dataclass(frozen=True)
class Item:
    """Codes and weights of the terms that weigh something."""

    codes: np.ndarray
    weights: np.ndarray


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the columns of a boolean table (terms x documents) by their bits: (a document of each group, group of each document, sizes)."""
    bits = np.packbits(present, axis=0, bitorder="little").T
    width = -(-bits.shape[1] // 8) * 8
    padded = np.zeros((len(bits), width), dtype=np.uint8)
    padded[:, : bits.shape[1]] = bits
    keys = padded.view(np.uint64)
    flat = keys[:, 0] if keys.shape[1] == 1 else padded.view(np.dtype((np.void, width)))[:, 0]
    _, one, group, size = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    return one, group.reshape(-1), size


def best_of(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """Places of the best rows: by score, then id, null ids first."""
    return np.lexsort((ids, known, -scores))[:top]


class Ranking:
    """The best documents of each item so far."""

    def __init__(self, items: list[Item], top: int):
        self.items, self.top = items, top
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]

    def add(self, impact: np.ndarray, ids: np.ndarray, known: np.ndarray) -> int:
        """Ranks a block: impact is terms x documents, 0 where a term gives nothing. Returns how many documents were evaluated."""
        seen = 0
        largest = impact.max(axis=1, initial=0).astype(np.int64)
        for i, item in enumerate(self.items):
            here = largest[item.codes] > 0
            codes, weights = item.codes[here], item.weights[here]
            if not len(codes):
                continue
            rows = impact[codes]
            one, group, size = masks(rows > 0)
            most = (weights * largest[codes]) @ (rows[:, one] > 0)
            order = np.argsort(-most, kind="stable")
            order = order[most[order] > 0]
            documents = np.argsort(group, kind="stable")
            first = np.concatenate([[0], np.cumsum(size)])
            at, take = 0, self.top
            while at < len(order):
                scores, own, sure = self.held[i]
                if len(scores) == self.top and most[order[at]] < scores[-1]:
                    break
                # Groups enough for `take` documents, more each time.
                to = at + 1 + int(np.searchsorted(np.cumsum(size[order[at:]]), take))
                chosen = np.concatenate([documents[first[g] : first[g + 1]] for g in order[at:to]])
                new = weights @ rows[:, chosen]
                scores, own, sure = np.concatenate([scores, new]), np.concatenate([own, ids[chosen]]), np.concatenate([sure, known[chosen]])
                best = best_of(scores, own, sure, self.top)
                self.held[i] = (scores[best], own[best], sure[best])
                seen, at, take = seen + len(chosen), to, 4 * take
        return seen


def _ranked(batches: Iterator[pa.RecordBatch], items: list[Item], n_terms: int, n_docs: int, length: int, top: int, cells: int) -> Iterator[pa.RecordBatch]:
    ranking, step = Ranking(items, top), max(16, min(4096, cells // max(1, n_terms)))
    impact = np.zeros((n_terms, step), dtype=np.int32)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            n = part.column("n").to_numpy()
            m = 10 + 90 * n * n_docs // length
            column = np.repeat(np.arange(len(n)), pc.list_value_length(part.column("codes")).to_numpy())
            code, tf = part.column("codes").flatten().to_numpy(), part.column("counts").flatten().to_numpy().astype(np.int64)
            impact[code, column] = 1_000_000_000 * tf // (1000 * tf + 8 * m[column])
            ids = part.column("doc_id")
            ranking.add(impact[:, : len(n)], pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False))
            impact[code, column] = 0
    for i, (scores, ids, known) in enumerate(ranking.held):
        if len(scores):
            cols = [pa.array([i] * len(scores), pa.int32()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, items: int = ITEMS, cells: int = CELLS) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of each row of queries (item_id, text)."""
    stated = save(queries.select("item_id", "text").filter("text IS NOT NULL").distinct(), "items")
    blocks = max(1, -(-stated.count() // items))
    out, totals = None, None
    for block in range(blocks):
        rows = stated.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        words, first = word_bytes(pa.array([r["text"] for r in rows], pa.string()))
        own = [sorted(set(words[first[i] : first[i + 1]].to_pylist())) for i in range(len(rows))]
        terms = sorted(set().union(*own))
        if not terms:
            continue
        table = postings(docs, terms)
        totals = totals or table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not totals[0]:
            break
        weights = np.array([weight(totals[0], int(df)) for df in frequencies(table, len(terms))], dtype=np.int64)
        place = {t: i for i, t in enumerate(terms)}
        codes = [np.array([place[t] for t in x if weights[place[t]] > 0], dtype=np.int64) for x in own]
        asked = [Item(c, weights[c]) for c in codes]
        found = _search_block(table, asked, len(terms), totals[0], totals[1], top, cells)
        kind = queries.schema["item_id"].dataType.simpleString()
        names = queries.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.limit(0).select(F.lit(None).cast(queries.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out


def _search_block(table: DataFrame, asked: list[Item], n_terms: int, n_docs: int, length: int, top: int, cells: int) -> DataFrame:
    """item, rank, doc_id, score. Tasks hand on `top` rows an item; a window merges them."""
    local = table.mapInArrow(lambda b: _ranked(b, asked, n_terms, n_docs, length, top, cells), "item int, doc_id long, score long").filter("score > 0")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every benchmark item against all documents."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (
  SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM b),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
p AS (
  SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM f JOIN q USING (term) JOIN g USING (term), s GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS k FROM p WHERE score > 0) WHERE k <= 10
"""
