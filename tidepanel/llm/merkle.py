"""Merkle dataset manifest as a SHA-256 midstate tree: parents keep the hash state from before each child slot.

Leaves are SHA-256 digests of rows, in order of doc_id within their language; every `arity` consecutive nodes become the SHA-256 of their
hex digests, until one is left. A hex digest is exactly one block of SHA-256, so the state before child slot j is eight words: the state
after j blocks. The manifest stores those words for every parent. To replace a child, the state before its slot is resumed, and only
the replacement and the siblings to its right are hashed.

Leaves take their places from a range sort by (language, doc_id, leaf, file, row), so a language of any size and copies of one row
are spread. Trees are built in chunks of `arity`^levels nodes, one row of the manifest each, and the chunks' roots in chunks again
until each language has one; languages are then the leaves of a tree of the same kind. On the way down each chunk gets the path above it
(states and siblings, a few dozen bytes a level), and the rows of a chunk are folded together.

Null values are `-` in a leaf. Null languages come first, null ids come first in their language, equal ids are ordered by leaf, repeated
rows follow each other. A row with a null id or a null n_chars is not tampered with. Texts of any length are hashed by Spark, empty
ones too. A single row has an empty proof; an empty table an empty result. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.streaming_dedup import located
from tidepanel.sources.scratch import save

ARITY = 2
#: Nodes of a chunk at most.
CHUNK = 4096
#: Rows up to which the first places of the sorted partitions are broadcast; beyond, they are joined by exchange.
BROADCAST_PLACES = 100_000


def _root_bits(p: int, degree: int) -> int:
    """The first 32 bits behind the point of the square or cube root of p."""
    low, high = 0, p << 40
    while low < high:
        mid = (low + high + 1) // 2
        if mid**degree <= p << (32 * degree):
            low = mid
        else:
            high = mid - 1
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]
_START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], dtype=np.uint32)
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES[:64]], dtype=np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8 x n) after one more block (16 x n or 16 x 1 words) each."""
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ a >> np.uint32(3)) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ b >> np.uint32(10)))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + (w[t] + _ROUND[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "big") for b in range(256)], dtype=np.uint32)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block (16 x n words) that is the hex text of digests (n x 32 bytes)."""
    pairs = _HEX[digests]
    return np.ascontiguousarray((pairs[:, 0::2] << np.uint32(16) | pairs[:, 1::2]).T)


def _last_block(children: int) -> np.ndarray:
    """What ends a message of that many blocks."""
    block = np.zeros((16, 1), dtype=np.uint32)
    block[0], block[14], block[15] = 1 << 31, children * 512 >> 32, children * 512 & 0xFFFFFFFF
    return block


def start(n: int) -> np.ndarray:
    return np.repeat(_START[:, None], n, axis=1)


def to_bytes(states: np.ndarray) -> np.ndarray:
    """States (8 x n) as n x 32 bytes."""
    return np.ascontiguousarray(states.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(raw).view(">u4").reshape(-1, 8).T).astype(np.uint32)


def parents_of(nodes: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parents of a level (n x 32 bytes), and their states before slots 1 .. arity - 1 (zero for slots without a child)."""
    n = len(nodes)
    m = -(-n // arity)
    children = np.minimum(arity, n - arity * np.arange(m))
    state, kept = start(m), np.zeros((m, arity - 1, 32), dtype=np.uint8)
    for slot in range(arity):
        here = np.flatnonzero(children > slot)
        if slot:
            kept[here, slot - 1] = to_bytes(state[:, here])
        state[:, here] = absorb(state[:, here], hex_block(nodes[here * arity + slot]))
    return to_bytes(_ended(state, children)), kept


def _ended(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    state = state.copy()
    for c in np.unique(children):
        here = children == c
        state[:, here] = absorb(state[:, here], _last_block(int(c)))
    return state


def levels_of(n: int, arity: int, chunk: int) -> int:
    """Levels that a chunk of a group of n nodes rises."""
    up, reach = 0, 1
    while reach < min(n, chunk):
        up, reach = up + 1, reach * arity
    return up


def _chunk_size(arity: int, chunk: int) -> int:
    if arity < 2 or arity > 255 or chunk < arity:
        raise ValueError("arity is 2 to 255, and a chunk holds at least one run")
    size = arity
    while size * arity <= chunk:
        size *= arity
    return size


CHUNK_ROW = "grp string, chunk long, size int, up int, nodes binary, states binary, digest binary, n long"


def _risen(arity: int, chunk: int):
    names = [c.split(" ")[0] for c in CHUNK_ROW.split(", ")]

    def rise(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        level = np.frombuffer(b"".join(table.column("digest").to_pylist()), dtype=np.uint8).reshape(-1, 32)[order]
        n = table.column("n")[0].as_py()
        nodes, states = [level], []
        for _ in range(levels_of(n, arity, chunk)):
            level, kept = parents_of(level, arity)
            nodes.append(level)
            states.append(kept)
        row = [key[0].as_py(), key[1].as_py(), len(order), len(states), b"".join(x.tobytes() for x in nodes), b"".join(x.tobytes() for x in states)]
        row += [level[0].tobytes(), -(-n // chunk)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)

    return rise


def _levels(row: dict, arity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests and states of a chunk row, level by level."""
    flat = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, 32)
    kept = np.frombuffer(row["states"], dtype=np.uint8).reshape(-1, arity - 1, 32)
    n, a, b = row["size"], row["size"], 0
    nodes, states = [flat[:n]], []
    for _ in range(row["up"]):
        n = -(-n // arity)
        nodes.append(flat[a : a + n])
        states.append(kept[b : b + n])
        a, b = a + n, b + n
    return nodes, states


def records(nodes: list[np.ndarray], states: list[np.ndarray], at: np.ndarray, arity: int) -> list[np.ndarray]:
    """Per level a record (n x (34 + 32 arity) bytes) for the nodes `at`: slot, children, state before the slot, digests of the run."""
    out = []
    for level, kept in zip(nodes, states):
        parent, slot = at // arity, at % arity
        children = np.minimum(arity, len(level) - parent * arity)
        record = np.zeros((len(at), 34 + 32 * arity), dtype=np.uint8)
        record[:, 0], record[:, 1] = slot, children
        record[:, 2:34] = np.where((slot == 0)[:, None], to_bytes(start(1)), kept[parent, np.maximum(slot, 1) - 1])
        for j in range(arity):
            here = np.flatnonzero(children > j)
            record[here, 34 + 32 * j : 66 + 32 * j] = level[parent[here] * arity + j]
        out.append(record)
        at = parent
    return out


def fold(replaced: np.ndarray, path: list[np.ndarray], arity: int) -> np.ndarray:
    """Roots (n x 32 bytes) that follow from the digests `replaced` at the foot of the path: each level has one record a row, or one for all."""
    for record in path:
        slot, children = (np.broadcast_to(record[:, i], len(replaced)) for i in (0, 1))
        state = np.repeat(from_bytes(record[:, 2:34]), len(replaced) // len(record), axis=1)
        state = absorb(state, hex_block(replaced))
        for j in range(1, arity):
            here = np.flatnonzero((children > j) & (slot < j))
            if len(here):
                rows = here if len(record) > 1 else np.zeros(len(here), dtype=np.int64)
                state[:, here] = absorb(state[:, here], hex_block(record[rows, 34 + 32 * j : 66 + 32 * j]))
        replaced = to_bytes(_ended(state, children))
    return replaced


def siblings(path: list[np.ndarray], n: int, arity: int) -> list[bytes]:
    """Hex digests of the other nodes of each run, level by level, left to right."""
    columns = []
    for record in path:
        hexes = np.ascontiguousarray(hex_block(record[:, 34:].reshape(-1, 32)).T).astype(">u4").view(np.uint8).reshape(len(record), arity, 64)
        own = np.arange(arity)[None, :]
        other = (own != record[:, :1]) & (own < record[:, 1:2])
        columns.append([hexes[i][other[i]].tobytes() for i in range(len(record))])
    return [b"".join(c[i if len(c) > 1 else 0] for c in columns) for i in range(n)]


@dataclass
class Manifest:
    """`leaves`: grp, pos, chunk and the caller's columns; `lower`, `upper`: chunk tables of the groups and of the tree over them; `groups`: grp, pos, digest."""

    leaves: DataFrame
    lower: list[DataFrame]
    groups: DataFrame
    upper: list[DataFrame]
    arity: int
    chunk: int

    def paths(self) -> DataFrame:
        """grp, chunk, path (records above the chunk's root), subroot and root (hex) of each chunk of leaves."""
        top = self.upper[-1]
        root = F.lower(F.hex("digest")).alias("root")
        above = top.select("grp", "chunk", F.lit(b"").alias("path"), root)
        for table in reversed(self.upper):
            above = _below(table, above, self.arity, self.chunk, ["root"]).withColumn("chunk", F.col("pos"))
        # The nodes under the upper tree are the languages' subroots, in order of language.
        places = self.groups.select(F.col("grp").alias("own"), "pos", F.lower(F.hex("digest")).alias("subroot"))
        above = places.join(above, "pos").select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("chunk"), "path", "root", "subroot")
        for table in reversed(self.lower[1:]):
            above = _below(table, above, self.arity, self.chunk, ["root", "subroot"]).withColumn("chunk", F.col("pos"))
        return save(above.select("grp", "chunk", "path", "root", "subroot"), "paths")


def _below(table: DataFrame, above: DataFrame, arity: int, chunk: int, keep: list[str]) -> DataFrame:
    """Paths of the lowest nodes of the chunks of a table, from the paths of the chunks."""
    kinds = "grp string, pos long, path binary, " + ", ".join(f"{c} string" for c in keep)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes, states = _levels(row, arity)
                n = len(nodes[0])
                own = records(nodes, states, np.arange(n), arity)
                paths = [b"".join(r[i].tobytes() for r in own) + row["path"] for i in range(n)]
                cols = [pa.array([row["grp"]] * n, pa.string()), pa.array(row["chunk"] * chunk + np.arange(n), pa.int64()), pa.array(paths, pa.binary())]
                cols += [pa.array([row[c]] * n, pa.string()) for c in keep]
                yield pa.RecordBatch.from_arrays(cols, names=["grp", "pos", "path", *keep])

    return table.select("grp", "chunk", "size", "up", "nodes", "states").join(above, ["grp", "chunk"]).mapInArrow(run, kinds)


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """rows with pos, their place from 0 in their grp (a string, the first of the order), and n, the rows of the grp."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    # Ids go up by one inside a sorted partition; they are written, so they stay.
    dealt = save(dealt.withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__id", 33)
    per_part = dealt.groupBy("grp", part.alias("__part")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    per_part = save(per_part, "places")
    # One row per partition and group; a group has at most one in each partition.
    ordered = Window.partitionBy("grp").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    places = per_part.select(
        F.col("grp").alias("__g"), F.col("__part").alias("__p"), "__first",
        F.coalesce(F.sum("__n").over(ordered), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy("grp")).alias("n"),
    )
    places = save(places, "bases")
    if places.count() <= BROADCAST_PLACES:
        places = F.broadcast(places)
    out = dealt.join(places, (F.col("grp") == F.col("__g")) & (part == F.col("__p")))
    return out.withColumn("pos", F.col("__id") - F.col("__first") + F.col("__base")).drop("__id", "__g", "__p", "__first", "__base")


def _forest(nodes: DataFrame, arity: int, chunk: int, name: str) -> list[DataFrame]:
    """Chunk tables from nodes (grp, pos, digest, n) up to one node per group."""
    out = []
    while True:
        dealt = nodes.select("grp", F.floor(F.col("pos") / chunk).cast("long").alias("chunk"), "pos", "digest", "n")
        table = save(dealt.groupBy("grp", "chunk").applyInArrow(_risen(arity, chunk), CHUNK_ROW), name)
        out.append(table)
        if (table.agg(F.max("n")).first()[0] or 1) <= 1:
            return out
        nodes = table.select("grp", F.col("chunk").alias("pos"), "digest", "n")


def encoded(*columns: str | Column) -> Column:
    """What a leaf hashes: per value `-` for null, else the bytes of its text counted, `:`, the text."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def build(rows: DataFrame, arity: int = ARITY, chunk: int = CHUNK) -> Manifest:
    """The manifest over rows (grp string without nulls, whose bytewise order is that of the groups; leaf binary; the order columns
    `doc_id`, `file`, `row`; more)."""
    chunk = _chunk_size(arity, chunk)
    placed = _placed(rows, ["grp", "doc_id", "leaf", "file", "row"])
    leaves = save(placed.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long")), "leaves")
    lower = _forest(leaves.select("grp", "pos", F.col("leaf").alias("digest"), "n"), arity, chunk, "lower")
    groups = _placed(lower[-1].select(F.lit("").alias("grp"), F.col("grp").alias("own"), "digest"), ["own"])
    upper = _forest(groups.select("grp", "pos", "digest", "n"), arity, chunk, "upper")
    return Manifest(leaves, lower, groups.select(F.col("own").alias("grp"), "pos", "digest"), upper, arity, chunk)


def verify(manifest: Manifest, replaced: str = "replaced") -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (all hex), verified. `replaced` is the leaf's digest as found now."""
    arity, size = manifest.arity, manifest.chunk
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = [c.split(" ")[0] for c in kinds.split(", ")]

    def fold_chunk(leaves: pa.Table, chunks: pa.Table) -> pa.Table:
        row = chunks.to_pylist()[0]
        nodes, states = _levels(row, arity)
        at, n = leaves.column("pos").to_numpy() - row["chunk"] * size, len(leaves)
        width = 34 + 32 * arity
        path = records(nodes, states, at, arity) + [r[None, :] for r in np.frombuffer(row["path"], dtype=np.uint8).reshape(-1, width)]
        now = np.frombuffer(b"".join(leaves.column("replaced").to_pylist()), dtype=np.uint8).reshape(-1, 32)
        folded = [x.tobytes().hex() for x in fold(now, path, arity)]
        proofs = [hashlib.sha256(s).hexdigest() for s in siblings(path, n, arity)]
        own = [x.hex() for x in leaves.column("leaf").to_pylist()]
        cols = [leaves.column("doc_id").to_pylist(), own, [row["subroot"]] * n, [row["root"]] * n, proofs, folded, [f == row["root"] for f in folded]]
        return pa.table([pa.array(c, type=pa.int64() if i == 0 else pa.bool_() if i == 6 else pa.string()) for i, c in enumerate(cols)], names=names)

    leaves = manifest.leaves.select("grp", "chunk", "pos", "doc_id", "leaf", F.col(replaced).alias("replaced"))
    chunks = manifest.lower[0].select("grp", "chunk", "size", "up", "nodes", "states").join(manifest.paths(), ["grp", "chunk"])
    return leaves.groupBy("grp", "chunk").cogroup(chunks.groupBy("grp", "chunk")).applyInArrow(fold_chunk, kinds)


def leaves_of(docs: DataFrame) -> DataFrame:
    """grp, doc_id, leaf, replaced, file, row: the leaf of each document, and the leaf of what it would be after tampering."""
    docs = located(docs.select("doc_id", "source", "lang", "n_chars", "text"))
    digest = lambda n_chars: F.unhex(F.sha2(encoded("doc_id", "source", "lang", n_chars, "text"), 256))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    # One hash per row; only the few that are tampered with take a second one.
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), digest("n_chars").alias("leaf"),
        F.when(hit, digest(F.try_add("n_chars", F.lit(1)))).alias("changed"), F.col("__file").alias("file"), F.col("__row").alias("row"),
    )
    return rows.withColumn("replaced", F.coalesce("changed", "leaf")).drop("changed")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the whole table."""
    return verify(build(leaves_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


#: Levels that the SQL unrolls: languages of up to 2^LEVELS documents, and as many languages.
_LEVELS = 20


def _sql() -> str:
    def text(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR) END"

    def digest(n_chars: str) -> str:
        return f"sha256({' || '.join(text(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    def forest(name: str, base: str) -> list[str]:
        """Tables name_0 ..: grp, pos, h, n (nodes of the group at this level)."""
        out = [f"{name}_0 AS MATERIALIZED ({base})"]
        for i in range(_LEVELS):
            out.append(
                f"{name}_{i + 1} AS MATERIALIZED (SELECT grp, pos // 2 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h,"
                f" (max(n) + 1) // 2 AS n FROM {name}_{i} GROUP BY grp, pos // 2)"
            )
        return out

    # A leaf's place at level i is pos // 2^i; its sibling there, if any, stands on the left of it when the place is odd.
    def sibling(name: str, i: int, alias: str, grp: str, pos: str) -> str:
        return f"LEFT JOIN {name}_{i} {alias} ON {alias}.grp = {grp} AND {alias}.pos = xor({pos} // {1 << i}, 1) AND {alias}.n > 1"

    def up(name: str, i: int, now: str, grp: str, pos: str) -> str:
        """SQL of the next digest, given that of the one below."""
        alive = f"(SELECT max(n) FROM {name}_{i} q WHERE q.grp = {grp}) > 1"
        odd = f"({pos} // {1 << i}) % 2 = 1"
        return f"CASE WHEN NOT ({alive}) THEN {now} WHEN {odd} THEN sha256(s.h || {now}) ELSE sha256({now} || coalesce(s.h, '')) END"

    steps = []
    before = "r0"
    steps.append("r0 AS (SELECT l.*, p.pos AS lpos, '' AS proof, changed AS now FROM leaves l JOIN places p ON p.own = l.grp)")
    for k, (name, grp, pos) in enumerate([("a", "r.grp", "r.pos"), ("b", "''", "r.lpos")]):
        for i in range(_LEVELS):
            after = f"r{k * _LEVELS + i + 1}"
            steps.append(
                f"{after} AS MATERIALIZED (SELECT r.* REPLACE (r.proof || coalesce(s.h, '') AS proof, {up(name, i, 'r.now', grp, pos)} AS now) FROM {before} r {sibling(name, i, 's', grp, pos)})"
            )
            before = after
    codes = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, y: xor(a >> 8, v[1 + (xor(a, y) & 255)])), 4294967295)"
    changed = f"CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND crc % 7 = 0 THEN {digest('(n_chars + 1)')} ELSE {digest('n_chars')} END"
    parts = [
        # CRC-32 by its table of 256 entries, made by the shift rule.
        "crc_table AS (SELECT list(e ORDER BY b) AS v FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, y: CASE WHEN a & 1 = 1 THEN"
        " xor(a >> 1, 3988292384) ELSE a >> 1 END) AS e FROM range(256) t(b)))",
        "leaves AS MATERIALIZED (SELECT doc_id, grp, leaf, changed, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,"
        f" count(*) OVER (PARTITION BY grp) AS n FROM (SELECT doc_id, coalesce('1' || lang, '0') AS grp, {digest('n_chars')} AS leaf, {changed} AS changed FROM (SELECT d.*, {crc} AS crc FROM documents d, crc_table)))",
        *forest("a", "SELECT grp, pos, leaf AS h, n FROM leaves"),
        f"places AS MATERIALIZED (SELECT grp AS own, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM a_{_LEVELS})",
        *forest("b", "SELECT '' AS grp, pos, h, n FROM places"),
        *steps,
    ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, p.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.h AS verified "
        f"FROM {before} r JOIN places p ON p.own = r.grp, b_{_LEVELS} t"
    )


SQL = _sql()
