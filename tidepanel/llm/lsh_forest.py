"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Documents are sets of word shingles; those with the same set form a copy class, and one of each stands for it. A forest of TREES trees
labels a set with DEPTH MinHash values in each tree. The labels of all trees are range-sorted together (tree, label, set): neighbours'
common prefixes are the nodes of the tree's prefix trie, read off in one pass over each batch. A node that lies inside a batch with one set has
no partners and is gone; what reaches a batch's edge is added up over batches, so a node of any size is never in one task.

A matched prefix starts as long as the label is and is shortened value by value. Every prefix is shortened until a pair at the threshold is found in
some tree with the chance RECALL (7 of 8 values with 32 trees at 0.8); a node that is still small there (SMALL sets) is shortened on, to SPARE
values less, while it stays small. So sets with few neighbours are searched wider, where that costs little, and
hot nodes are not widened. `depths` counts the nodes that stop at each depth.

Nodes are chained into clusters of candidates (connected components over node hubs, so no pairs are formed). The sets of a cluster are sorted along
the trie and cut into blocks of about BLOCK by running sums, so neighbours share a block. Verified together are a block with itself, and two blocks of a cluster
if some node has sets of both. In such a group pairs that share a node are compared exactly, by counts of common shingles; a pair meets in one
group only. A group returns a row per set: its number of links, and the smallest set it is joined to. So links are all counted, and never written
out as rows; classes are the components over them.

Documents without words (null, empty) are alone. Texts of fewer words than a shingle are one shingle; long ones are hashed in spans. Of ties the
smaller doc_id names a class, then the earlier row; null ids come last. Rows are told apart by file and row number, so null and repeated
ids are no trouble. An empty table gives an empty result. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ordered import ordered_running_sum
from tidepanel.llm.graph import components
from tidepanel.llm.streaming_dedup import keep_rows, located
from tidepanel.llm.words import hash_words, mix, shingle_hashes, sliced
from tidepanel.sources.scratch import save

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.999
#: Nodes of up to SMALL sets are shortened by up to SPARE values beyond the depth of the target recall.
SMALL = 64
SPARE = 2
#: Sets, and shingles of all its sets, that a block may start with.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Places in postings that verification looks at together.
POSTINGS = 1 << 20
#: Sets in clusters up to which their ids are broadcast to fetch the texts (16 bytes each); more are fetched by an exchange.
BROADCAST_SETS = 500_000
#: Shingles hashed at a time.
SPAN = 1 << 16


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = hash_words(texts)
    out = []
    for i in range(len(words)):
        own = words.hashes[words.first[i] : words.first[i + 1]]
        if 0 < len(own) < size:
            out.append(shingle_hashes(own, len(own)) ^ np.uint64(len(own)))
        else:
            out.append(np.unique(shingle_hashes(own, size)))
    return out


def labels(sets: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """MinHash values (their low 16 bits), sets x trees x depth. No set may be empty."""
    a, b = _permutations(trees * depth)
    out = np.empty((len(sets), trees * depth), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SPAN)))
        flat = mix(np.concatenate(sets[at:to])).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum(sizes[at:to])[:-1]])
        for k in range(trees * depth):
            x = flat * a[k] + b[k]
            # The low bits of a product are weak; the permuted value is mixed once more.
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[at:to, k] = np.minimum.reduceat(x, first).astype(np.uint16)
        at = to
    return out.reshape(len(sets), trees, depth)


def node_ids(tree: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """64-bit ids of the trie nodes at a depth; the lowest byte is the tree."""
    h = tree.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth)
    for k in range(depth):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + values[:, k].astype(np.uint64))
    return ((h & ~np.uint64(0xFF)) | tree.astype(np.uint64)).view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], size: int, trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = shingle_sets(batch.column("text"), size)
        some = [i for i, s in enumerate(sets) if len(s)]
        values = labels([sets[i] for i in some], trees, depth) if some else np.zeros((0, trees, depth), np.uint16)
        label: list[bytes | None] = [None] * len(sets)
        for row, i in enumerate(some):
            label[i] = values[row].tobytes()
        keys = [digest(s) if len(s) else None for s in sets]
        own = [batch.column("doc_id"), batch.column("file"), batch.column("row")]
        made = [pa.array(keys, pa.binary()), pa.array(label, pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(own + made, names=["doc_id", "file", "row", "set", "label", "size"])


def _me():
    """Orders the rows of a class; unknown ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "row")


def signed(docs: DataFrame, size: int = SHINGLE, trees: int = TREES, longest: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs with the digest of its set, a row per distinct set with its first row, number of copies, label and size)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("__file").alias("file"), F.col("__row").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "doc_id long, file string, row long, set binary, label binary, size long"
    rows = save(rows.mapInArrow(lambda b: _signed(b, size, trees, longest), kind), "signatures")
    sets = rows.filter("set IS NOT NULL").groupBy("set").agg(
        F.min(_me()).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.max("size").alias("size")
    )
    return rows, save(sets, "sets")


def _entries(trees: int, longest: int):
    """(tree and label as one sortable key, set) for each tree of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_rows
                raw = np.frombuffer(b"".join(part.column("label").to_pylist()), dtype=np.uint16).reshape(n * trees, longest)
                key = np.empty((n * trees, 1 + 2 * longest), dtype=np.uint8)
                key[:, 0] = np.tile(np.arange(trees), n)
                key[:, 1:] = raw.astype(">u2").view(np.uint8).reshape(n * trees, 2 * longest)
                width = key.shape[1]
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n * trees, [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, part.column("set").take(np.repeat(np.arange(n), trees))], names=["key", "set"])

    return run


def _matched(longest: int, limit: int, shortest: int):
    """Sorted keys to (set, nodes from depth `limit` to `shortest`): null for a node that surely has one set; no row if all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=np.uint8).reshape(n, 1 + 2 * longest)
            tree, values = key[:, 0], np.ascontiguousarray(key[:, 1:]).view(">u2").astype(np.uint16)
            same = np.empty((n - 1, longest + 1), dtype=bool)
            same[:, 0] = tree[1:] == tree[:-1]
            same[:, 1:] = values[1:] == values[:-1]
            # Values that each row has in common with the row before: the length of their matched prefix.
            prefix = np.minimum.accumulate(same, axis=1)
            ids, open_ = [], []
            for depth in range(limit, shortest - 1, -1):
                # The rows at the edges may go on in other batches.
                on = np.concatenate([[True], prefix[:, depth], [True]])
                first = np.concatenate([[True], ~prefix[:, depth]])
                run_of = np.cumsum(first) - 1
                edge = (run_of == 0) | (run_of == run_of[-1])
                open_.append(on[:-1] | on[1:] | edge)
                ids.append(node_ids(tree, values, depth))
            keep = np.flatnonzero(np.any(open_, axis=0))
            flat = np.array(ids).T[keep].reshape(-1)
            lists = pa.array(flat, mask=~np.array(open_).T[keep].reshape(-1))
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(ids), dtype=np.int32), lists)
            yield pa.RecordBatch.from_arrays([batch.column("set").take(keep), lists], names=["set", "nodes"])

    return run


def chance(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair this similar shares a node at this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def target_depth(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with the chance `recall` (1 if none is)."""
    return next((d for d in range(longest, 0, -1) if chance(threshold, d, trees) >= recall), 1)


def forest(sets: DataFrame, trees: int, longest: int, limit: int, shortest: int, small: int = SMALL) -> DataFrame:
    """set, node, hub, depth, n: the node of two sets or more at which the prefix of a set stops, at most one in each tree."""
    entries = sets.select("set", "label").mapInArrow(_entries(trees, longest), "key binary, set binary")
    ordered = entries.repartitionByRange("key", "set").sortWithinPartitions("key", "set")
    matched = save(ordered.mapInArrow(_matched(longest, limit, shortest), "set binary, nodes array<long>"), "matched")
    flat = matched.select("set", F.posexplode("nodes").alias("shorter", "node")).filter("node IS NOT NULL")
    hubs = flat.groupBy("node", "shorter").agg(F.min("set").alias("hub"), F.count(F.lit(1)).alias("n"))
    # A node that is no longer small is not one to stop at, unless it has to be reached for the recall.
    hubs = save(hubs.filter((F.col("n") > 1) & ((F.col("shorter") == 0) | (F.col("n") <= small))), "hubs")
    ways = flat.join(hubs.select("node", "hub", "n"), "node").withColumn("depth", F.lit(limit) - F.col("shorter"))
    stop = ways.groupBy("set", F.col("node").bitwiseAND(F.lit(255)).alias("tree")).agg(F.min(F.struct("depth", "node", "hub", "n")).alias("stop"))
    return save(stop.select("set", "stop.node", "stop.hub", "stop.depth", "stop.n"), "nodes")


def depths(nodes: DataFrame) -> DataFrame:
    """depth, nodes, places: how many nodes stop at a depth, and the sets in them."""
    return nodes.groupBy("depth").agg(F.count_distinct("node").alias("nodes"), F.count(F.lit(1)).alias("places"))


def _groups(clusters: DataFrame, sets: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """set, block, cluster, x, y: the sets of each pair of blocks that is verified together. Blocks are numbered in their cluster."""
    # The beginning of the label says which sets are neighbours in the first trees.
    along = save(clusters.join(sets.select("set", "size", F.expr("substring(label, 1, 32)").alias("label")), "set"), "along")
    # A set takes its share of a block, by number or by shingles, whichever is more.
    share = {"upto": F.greatest(F.lit(BLOCK_SHINGLES // block), F.col("size"))}
    along = ordered_running_sum(along, ["cluster"], [F.col("label"), F.col("set")], share, task_rows=4 * block)
    number = F.floor((F.col("upto") - 1) / F.lit(BLOCK_SHINGLES)).cast("long")
    dealt = save(along.select("cluster", "set", number.alias("block")), "blocks")
    large = dealt.groupBy("cluster").agg(F.min("block").alias("least"), F.max("block").alias("most")).filter("least < most").select("cluster")
    both = nodes.select("set", "node").join(dealt.join(save(large, "large"), "cluster"), "set")
    both = save(both.select("node", "cluster", "block").distinct(), "shared")
    met = both.alias("a").join(both.alias("b"), "node").filter("a.block < b.block")
    met = met.select("a.cluster", F.col("a.block").alias("x"), F.col("b.block").alias("y")).distinct()
    own = dealt.select("set", "block", "cluster", F.col("block").alias("x"), F.col("block").alias("y"))
    sides = save(met, "met").select("cluster", "x", "y", F.explode(F.array("x", "y")).alias("block"))
    return own.unionByName(dealt.join(sides, ["cluster", "block"]).select("set", "block", "cluster", "x", "y"))


def verify(group: pd.DataFrame, threshold: float, trees: int) -> pd.DataFrame:
    """Exact links inside a block or between two: per set its links, and the smallest set it is joined to."""
    group = group.sort_values("set", kind="stable").drop_duplicates("set").reset_index(drop=True)
    n = len(group)
    ids = np.zeros((n, trees), dtype=np.int64)
    for i, own in enumerate(group["nodes"]):
        own = np.asarray(own, dtype=np.int64)
        ids[i, own & 255] = own
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
    sizes = np.array([len(s) for s in sets])
    block = group["block"].to_numpy()
    apart = bool(group["x"].iloc[0] != group["y"].iloc[0])
    links, parent = np.zeros(n, dtype=np.int64), np.arange(n)
    commons = _Commons(sets)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        large, small = np.maximum(sizes[i], sizes[rest]), np.minimum(sizes[i], sizes[rest])
        rest = rest[(small >= threshold * large) & ((block[rest] != block[i]) if apart else True)]
        rest = rest[((ids[rest] == ids[i]) & (ids[i] != 0)).any(axis=1)] if len(rest) else rest
        if not len(rest):
            continue
        common = commons.of(i)[rest]
        linked = rest[common / (sizes[i] + sizes[rest] - common) >= threshold]
        links[i] += len(linked)
        links[linked] += 1
        for j in linked:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    top = [group["set"].iloc[root(i)] for i in range(n)]
    return pd.DataFrame({"set": group["set"], "links": links, "top": top})


class _Commons:
    """Sizes of the intersections of one set with each of a group, from the owners of each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        flat, self.n = np.concatenate(sets), len(sets)
        self.cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.cuts))[order]
        new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        self.starts = np.append(np.flatnonzero(new), len(flat))
        self.shingle = np.empty(len(flat), dtype=np.int64)
        self.shingle[order] = np.cumsum(new) - 1

    def of(self, i: int) -> np.ndarray:
        own = self.shingle[self.cuts[i] : self.cuts[i + 1]]
        lengths = self.starts[own + 1] - self.starts[own]
        out, at, ends = np.zeros(self.n, dtype=np.int64), 0, np.cumsum(lengths)
        while at < len(own):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + POSTINGS, "right")))
            part = lengths[at:to]
            places = np.repeat(self.starts[own[at:to]] - (ends[at:to] - part - before), part) + np.arange(ends[to - 1] - before)
            out += np.bincount(self.owners[places], minlength=self.n)
            at = to
        return out


def _links(rows: DataFrame, docs: DataFrame, sets: DataFrame, nodes: DataFrame, size: int, threshold: float, trees: int, block: int) -> DataFrame:
    """set, links, top for each set in a cluster; a row for each group that a set is in."""
    chains = nodes.filter("set <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    clusters = save(components(chains).select(F.col("node").alias("set"), F.col("root").alias("cluster")), "clusters")
    # Texts of one row for each set, as shingles; only of sets in clusters.
    wanted = clusters.join(sets.select("set", "first"), "set").select("set", F.col("first.file").alias("file"), F.col("first.row").alias("row"))
    wanted = save(wanted, "wanted")
    texts = docs.select(F.col("__file").alias("file"), F.col("__row").alias("row"), "text")
    few = wanted.count() <= BROADCAST_SETS
    found = texts.join(F.broadcast(wanted) if few else wanted, ["file", "row"]).select("set", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(out, pa.binary())], names=["set", "shingles"])

    shingles = found.mapInArrow(shingled, "set binary, shingles binary")
    own = nodes.groupBy("set").agg(F.collect_list("node").alias("nodes"))  # at most one a tree
    known = save(shingles.join(own, "set"), "shingles")
    full = _groups(clusters, sets, nodes, block).join(known, "set")
    checked = full.groupBy("cluster", "x", "y").applyInPandas(lambda g: verify(g, threshold, trees), "set binary, links long, top binary")
    return save(checked, "links")


def join(
    docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, longest: int = DEPTH, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per row of docs: doc_id, file, row, class_id and rep_id (smallest doc_id of the class, of the copies), copies, n_links, first.

    n_links counts the other sets that are at least `threshold` similar to the document's own; `first` is the row that class_id names.
    """
    docs = docs.select("doc_id", "text", "__file", "__row") if "__file" in docs.columns else located(docs.select("doc_id", "text"))
    rows, sets = signed(docs, size, trees, longest)
    limit = target_depth(threshold, trees, longest, recall)
    nodes = forest(sets, trees, longest, limit, max(1, limit - SPARE))
    links = _links(rows, docs, sets, nodes, size, threshold, trees, block)
    joined = links.filter("top <> set").select(F.col("set").alias("a"), F.col("top").alias("b"))
    classes = components(joined).select(F.col("node").alias("set"), F.col("root").alias("class"))
    counts = links.groupBy("set").agg(F.sum("links").alias("n_links"))
    known = sets.select("set", F.col("first").alias("rep"), "copies").join(classes, "set", "left").join(counts, "set", "left")
    known = save(known.select("set", "rep", "copies", F.coalesce("class", "set").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    first = known.groupBy("class").agg(F.min("rep").alias("first"))
    known = save(known.join(first, "class").drop("class"), "known")
    out = rows.drop("label", "size").join(known, "set", "left")
    return out.select(
        "doc_id", "file", "row",
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("rep_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("first", _me()).alias("first"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of each class (smallest doc_id), with all its columns."""
    return keep_rows(docs, lambda d: join(d).filter((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row"))))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: one row per document."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "rep_id", "copies", "n_links")
