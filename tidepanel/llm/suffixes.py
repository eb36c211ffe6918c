"""Repeated passages by a sparse suffix array: suffixes at minimiser positions, sorted, compared with neighbours, extended both ways.

A suffix is kept where the hash of its first SEED words is the smallest among WINDOW consecutive ones; the choice depends on the words
alone, so copies of a passage keep the same positions in it, one in every WINDOW words at least. Seeds that occur once are dropped by a
count. The others carry the RIGHT words from their position and the LEFT words before it, as 32-bit word hashes, and are range-partitioned and
sorted by their right words (then document and position): a sparse suffix array. Each suffix is compared with the nearest ones before and
after it that belong to other documents, NEIGHBOURS on each side, and the match is extended to the left. A match of LENGTH words or more is a
repeat; overlapping repeats of a document are made one span, so a span may be far longer than a context.

Partners further away are found by windows. Every LENGTH words have their first minimiser less than WINDOW words from their start, so they are
a window that begins up to WINDOW - 1 words before some suffix, in every copy. The nearest rows of other documents share the most right words
with a suffix, so only windows within those can be repeated. One that no neighbour shares is open. Open windows, and the others of the rows
that share the fewest right words a window can have with an open row, are counted by digest, combined in each task first; an open window that
a second document has is a repeat. Rows that begin or end a partition do not know their nearest rows, and all their windows are taken.

With WINDOW, LEFT and RIGHT as chosen here, every repeated passage of LENGTH words is thus found, whatever lies between its copies in the order.
Words are hashed to 32 bits and open windows to 128, so two different passages would have to agree in LENGTH hashes, or in a digest, to be taken for one.

Order inside equal words is by document, and the range partitioning uses it, so a passage that a third of all documents share is dealt over
many tasks. Rows at the edges of partitions are compared once more. Documents are told apart by (doc_id, text): rows equal in both are one
document, and a passage repeated inside one document only is not a repeat. Nulls and texts of fewer than LENGTH words have none.
An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.words import hash_words, shingle_hashes, text_of, words_of
from tidepanel.sources.scratch import folder, save

LENGTH = 50
SEED = 8
WINDOW = 20
LEFT = WINDOW
RIGHT = LENGTH + 2
NEIGHBOURS = 2
SEEDS = "doc_id long, text_key long, at int, seed long"
SUFFIX = "doc_id long, text_key long, at int, right binary, left binary"
MATCH = "doc_id long, text_key long, from int, to int, other long"


def minimisers(words: np.ndarray, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seed hashes of the suffixes to keep; the leftmost of equal minima. Too few words: one window."""
    h = shingle_hashes(words, seed)
    if not len(h):
        return np.zeros(0, dtype=np.int64), h
    # Hash above, position below: a minimum then names its place, the leftmost first.
    bits = max(24, int(len(h)).bit_length())
    low = np.uint64((1 << bits) - 1)
    x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, span = min(window, len(h)), 1
    while span < w:
        step = min(span, w - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    at = np.unique(x & low).astype(np.int64)
    return at, h[at]


def _texts(batch: pa.RecordBatch):
    words = hash_words(batch.column("text"))
    for i, (doc_id, key) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist())):
        yield doc_id, key, words.hashes[words.first[i] : words.first[i + 1]]


def _seeded(length: int, seed: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, ats, seeds, counts = [], [], [], [], []
            for doc_id, key, words in _texts(batch):
                if len(words) >= length:
                    at, h = minimisers(words, seed, window)
                    ids.append(doc_id)
                    keys.append(key)
                    counts.append(len(at))
                    ats.append(at.astype(np.int32))
                    seeds.append(h.view(np.int64))
            if counts:
                own = np.repeat(np.arange(len(counts)), counts)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(take), pa.array(keys, pa.int64()).take(take), pa.array(np.concatenate(ats)), pa.array(np.concatenate(seeds))],
                    names=["doc_id", "text_key", "at", "seed"],
                )

    return run


def _contexts(left: int, right: int):
    """Suffix rows of the wanted positions of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                yield of(piece)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        wanted = batch.column("ats").to_pylist()
        for (doc_id, key, words), ats in zip(_texts(batch), wanted):
            small = (words >> np.uint64(32)).astype(">u4")
            # A text ends with a word of its own: 0 on either side equals nothing.
            padded = np.concatenate([np.zeros(left, ">u4"), small, np.zeros(right, ">u4")])
            at = np.array(sorted(set(ats)), dtype=np.int64)
            rights = padded[(at + left)[:, None] + np.arange(right)]
            lefts = padded[(at + left - 1)[:, None] - np.arange(left)]
            out[0] += [doc_id] * len(at)
            out[1] += [key] * len(at)
            out[2] += at.tolist()
            out[3] += [r.tobytes() for r in rights]
            out[4] += [x.tobytes() for x in lefts]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split(" ")[0] for c in SUFFIX.split(", ")])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading words that each row of a shares with the row of b; the word 0 equals nothing."""
    unlike = (a != b) | (a == 0)
    return np.where(unlike.any(axis=1), unlike.argmax(axis=1), a.shape[1])


class Rows:
    """Sorted suffixes as arrays."""

    def __init__(self, ids, keys, at, right, left):
        self.ids, self.keys, self.at, self.right, self.left = ids, keys, at, right, left

    @classmethod
    def of(cls, batch: pa.RecordBatch, left: int, right: int) -> Rows:
        n = batch.num_rows
        matrix = lambda c, k: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=">u4").astype(np.uint32).reshape(n, k)
        ids = np.array(batch.column("doc_id").to_pylist(), dtype=object)
        return cls(ids, batch.column("text_key").to_numpy(), batch.column("at").to_numpy(), matrix("right", right), matrix("left", left))

    def __len__(self) -> int:
        return len(self.at)

    def take(self, index) -> Rows:
        return Rows(self.ids[index], self.keys[index], self.at[index], self.right[index], self.left[index])

    def plus(self, other: Rows) -> Rows:
        pair = ((getattr(self, n), getattr(other, n)) for n in ("ids", "keys", "at", "right", "left"))
        return Rows(*(np.concatenate(p) for p in pair))

    def runs(self) -> np.ndarray:
        """Number of the run of one document that each row is in."""
        new = np.ones(len(self), dtype=bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (self.ids[1:] != self.ids[:-1])
        return np.cumsum(new) - 1


@dataclass
class Found:
    """For each row: the union of its matches of LENGTH words or more, and whether one of them fills its whole context."""

    hit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    other: np.ndarray
    full: np.ndarray
    #: Right words shared with the nearest rows of other documents, and (row, x) where the window that begins x words before is shared with a neighbour.
    near: np.ndarray
    shut: np.ndarray


def matches(rows: Rows, length: int, neighbours: int) -> Found:
    """Matches of each row with rows of other documents near it in the order."""
    n = len(rows)
    found = Found(*(np.zeros(n, dtype=k) for k in (bool, np.int64, np.int64, object, bool, np.int64)), np.zeros((n, rows.left.shape[1]), dtype=bool))
    starts = np.arange(rows.left.shape[1])
    if n < 2:
        return found
    run = rows.runs()
    first = np.searchsorted(run, np.arange(run[-1] + 1))
    last = np.append(first[1:], n) - 1
    for step in range(1, neighbours + 1):
        for there in (run - step, run + step):
            i = np.flatnonzero((there >= 0) & (there <= run[-1]))
            j = np.where(there[i] < run[i], last[there[i]], first[there[i]])
            # Two runs away may be the same document again.
            other = (rows.keys[i] != rows.keys[j]) | (rows.ids[i] != rows.ids[j])
            i, j = i[other], j[other]
            r, x = _common(rows.right[i], rows.right[j]), _common(rows.left[i], rows.left[j])
            found.near[i] = np.maximum(found.near[i], r)
            found.shut[i] |= (starts <= x[:, None]) & (starts + r[:, None] >= length)
            hit = r + x >= length
            i, j, r, x = i[hit], j[hit], r[hit], x[hit]
            for k, m in zip(i, j):  # ids may be null
                mine = rows.ids[m]
                if not found.hit[k] or found.other[k] is None or (mine is not None and mine < found.other[k]):
                    found.other[k] = mine
            found.hit[i] = True
            found.left[i], found.right[i] = np.maximum(found.left[i], x), np.maximum(found.right[i], r)
            found.full[i] |= (r == rows.right.shape[1]) & (x == rows.left.shape[1])
    return found


OUT = [
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("other", pa.int64()),
    ("kind", pa.int32()), ("part", pa.int32()), ("place", pa.int64()), ("at", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("window", pa.binary()), ("open", pa.bool_()),
]
KIND = f"{MATCH}, kind int, part int, place long, at int, right binary, left binary, window binary, open boolean"
SPANS, EDGES, WINDOWS = range(3)


def _batch(cols: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * n), k) for c, k in OUT], names=[c for c, _ in OUT])


def _spans(rows: Rows, found: Found, at: np.ndarray) -> pa.RecordBatch:
    at = at[found.hit[at]]
    cols = {
        "doc_id": rows.ids[at].tolist(), "text_key": rows.keys[at].tolist(), "from": (rows.at[at] - found.left[at]).tolist(),
        "to": (rows.at[at] + found.right[at]).tolist(), "other": found.other[at].tolist(), "kind": [SPANS] * len(at),
    }
    return _batch(cols, len(at))


def _at_edge(rows: Rows, at: np.ndarray, part: int, start: int) -> pa.RecordBatch:
    big = lambda m: [x.astype(">u4").tobytes() for x in m]
    cols = {
        "doc_id": rows.ids[at].tolist(), "text_key": rows.keys[at].tolist(), "kind": [EDGES] * len(at), "part": [part] * len(at),
        "place": (at + start).tolist(), "at": rows.at[at].tolist(), "right": big(rows.right[at]), "left": big(rows.left[at]),
    }
    return _batch(cols, len(at))


def _windows(rows: Rows, found: Found, done: int, upto: int, length: int, head: bool, tail: bool) -> pa.RecordBatch:
    """Windows of rows[done:upto] that may be repeated, less those of stretches of rows where all are known to be.

    head, tail: the rows begin or end the partition.
    """
    left, right, n = rows.left.shape[1], rows.right.shape[1], len(rows)
    runs = rows.runs()
    unknown = np.zeros(n, dtype=bool)
    if head:
        unknown |= runs == 0
    if tail:
        unknown |= runs == runs[-1]
    starts = np.arange(left)
    # The other words of a window lie in the right context; a window stays in its text.
    own_left, own_right = _common(rows.left, rows.left), _common(rows.right, rows.right)
    inside = (starts <= own_left[:, None]) & (length - starts <= own_right[:, None])
    may = inside & (length - starts <= np.where(unknown, right, found.near)[:, None])
    opened = may & ~found.shut
    # Stretches of equal least right words; those at either end may go on in rows that are not held here.
    least = max(1, length - left + 1)
    stretch = np.cumsum(np.append(True, (rows.right[1:, :least] != rows.right[:-1, :least]).any(axis=1))) - 1
    wanted = np.zeros(stretch[-1] + 1, dtype=bool)
    wanted[stretch[opened.any(axis=1)]] = True
    wanted[[0, -1]] = True
    may &= wanted[stretch][:, None]
    at, x = np.nonzero(may[done:upto])
    at += done
    words = {i: np.concatenate([rows.left[i, ::-1], rows.right[i]]).astype(">u4").tobytes() for i in np.unique(at).tolist()}
    digests = [hashlib.blake2b(words[i][4 * (left - k) : 4 * (left - k + length)], digest_size=16).digest() for i, k in zip(at.tolist(), x.tolist())]
    cols = {
        "doc_id": rows.ids[at].tolist(), "text_key": rows.keys[at].tolist(), "from": (rows.at[at] - x).tolist(), "to": (rows.at[at] - x + length).tolist(),
        "kind": [WINDOWS] * len(at), "window": digests, "open": opened[at, x].tolist(),
    }
    return _batch(cols, len(at))


def _neighbours(length: int, left: int, right: int, neighbours: int):
    """Streams a sorted partition: holds a batch and the runs before it that later rows may meet, never more.

    Rows in the first and last runs of the partition have neighbours in other partitions. They are passed on as edges, but of those
    whose match is full already only one of each run, for others to meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows[done:] are not given out yet; `start` is the place of rows[0] in the partition.
        part, rows, done, start, opened = TaskContext.get().partitionId(), None, 0, 0, False

        def edge(found: Found, head: bool) -> np.ndarray:
            runs = rows.runs()
            near = runs < neighbours if head else runs > runs[-1] - neighbours
            new = np.diff(runs, prepend=-1) > 0 if head else np.diff(runs, append=runs[-1] + 1) > 0
            return np.flatnonzero(near & (new | ~found.full))

        for batch in batches:
            for piece in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                rows = Rows.of(piece, left, right) if rows is None else rows.plus(Rows.of(piece, left, right))
                runs = rows.runs()
                # The last run may go on, and rows of the runs before it may have neighbours to come.
                upto = int(np.searchsorted(runs, runs[-1] - neighbours))
                if upto <= done:
                    continue
                found = matches(rows, length, neighbours)
                yield _spans(rows, found, np.arange(done, upto))
                yield _windows(rows, found, done, upto, length, start == 0, False)
                if not opened:
                    at = edge(found, True)
                    yield _at_edge(rows, at[at < upto], part, start)
                    opened = bool(runs[upto - 1] >= neighbours - 1)
                kept = int(np.searchsorted(runs, max(0, runs[upto] - neighbours))) if opened else 0
                rows, done, start = rows.take(slice(kept, None)), upto - kept, start + kept
        if rows is not None:
            found = matches(rows, length, neighbours)
            yield _spans(rows, found, np.arange(done, len(rows)))
            yield _windows(rows, found, done, len(rows), length, start == 0, True)
            at = edge(found, False) if opened else np.union1d(edge(found, True), edge(found, False))
            yield _at_edge(rows, at, part, start)

    return run


def _edges(length: int, left: int, right: int, neighbours: int):
    """Matches across the edges of partitions; all rows at edges come in one group, a few for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            if batch.num_rows:
                rows = Rows.of(batch, left, right) if rows is None else rows.plus(Rows.of(batch, left, right))
        if rows is not None:
            out = _spans(rows, matches(rows, length, neighbours), np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([out.column(i) for i in range(5)], names=[c for c, _ in OUT[:5]])

    return run


def suffix_array(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, window: int = WINDOW, left: int = LEFT, right: int = RIGHT
) -> DataFrame:
    """The suffixes whose seed occurs more than once, with their contexts, range-partitioned and sorted."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    seeds = save(keyed.mapInArrow(_seeded(length, seed, window), SEEDS), "seeds")
    again = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    wanted = seeds.join(save(again, "repeated"), "seed").groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("ats"))
    wanted = save(wanted, "wanted").withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"})
    # Equal rows are one document.
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))
    rows = texts.select("doc_id", "text_key", "text", "ats").mapInArrow(_contexts(left, right), SUFFIX)
    order = ["right", "doc_id", "text_key", "at"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def merged(spans: Column) -> Column:
    """Sorted (from, to, other) with spans that overlap or touch made one; other is the smallest."""
    kind = "array<struct<from:int,to:int,other:bigint>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"), F.least(last["other"], s["other"]).alias("other")
        )
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= s["from"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), step)


def open_repeats(windows: DataFrame) -> DataFrame:
    """The open windows that another document has too; other is the smallest doc_id that has one, or the largest if it is the document's own."""
    null = F.col("doc_id").isNull()
    counted = windows.groupBy("window").agg(
        F.bool_or("open").alias("any_open"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("text_key").alias("k"),
        F.max("text_key").alias("l"), F.bool_or(null).alias("some_null"), F.bool_and(null).alias("all_null"),
    )
    several = F.coalesce(F.col("low") < F.col("high"), F.lit(False)) | (F.col("k") < F.col("l")) | (F.col("some_null") & ~F.col("all_null"))
    again = counted.filter(F.col("any_open") & several).select("window", "low", "high")
    other = F.when(F.col("low").eqNullSafe(F.col("doc_id")), F.col("high")).otherwise(F.col("low"))
    return windows.filter("open").join(again, "window").select("doc_id", "text_key", "from", "to", other.alias("other"))


def repeats(docs: DataFrame, length: int = LENGTH, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, text_key, start_word, n_words, other_id: each span of words that also stands in another document, words from 0.

    other_id is the smallest doc_id among the neighbours that the span was matched with, and those of open_repeats.
    """
    order = suffix_array(docs, length)
    path = f"{folder(docs.sparkSession)}/matches-{uuid.uuid4().hex}"
    # Each kind lies in a folder of its own, so that the one task that meets the edges reads nothing else.
    order.mapInArrow(_neighbours(length, LEFT, RIGHT, neighbours), KIND).write.partitionBy("kind").parquet(path)
    found = docs.sparkSession.read.schema(KIND).parquet(path)
    # A few rows per partition, in the order of the partitions; rows of an open start may have been passed on twice.
    edges = found.filter(F.col("kind") == EDGES).select("part", "place", "doc_id", "text_key", "at", "right", "left").coalesce(1)
    edges = edges.sortWithinPartitions("part", "place")
    across = edges.select("doc_id", "text_key", "at", "right", "left").mapInArrow(_edges(length, LEFT, RIGHT, neighbours), MATCH)
    far = open_repeats(found.filter(F.col("kind") == WINDOWS))
    spans = found.filter(F.col("kind") == SPANS).select("doc_id", "text_key", "from", "to", "other").unionByName(across).unionByName(far)
    # Per span first: copies of a match combine in each task, before the rows of a document meet.
    spans = spans.groupBy("doc_id", "text_key", "from", "to").agg(F.min("other").alias("other"))
    per_doc = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("from", "to", "other"))).alias("spans"))
    out = per_doc.select("doc_id", "text_key", F.explode(merged(F.col("spans"))).alias("s"))
    return out.select(
        "doc_id", "text_key", F.col("s.from").alias("start_word"), (F.col("s.to") - F.col("s.from")).alias("n_words"), F.col("s.other").alias("other_id")
    )


def span_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with the words they cover, as `passage`."""
    words = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text_of()).alias("k"), words_of(text_of()).alias("w")).dropDuplicates(["d", "k"])
    on = spans["doc_id"].eqNullSafe(F.col("d")) & (spans["text_key"] == F.col("k"))
    cut = F.array_join(F.slice("w", F.col("start_word") + 1, F.col("n_words")), " ")
    return spans.join(words, on).select(*spans.columns, cut.alias("passage"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every span of 50 words or more that stands in two documents or more."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
