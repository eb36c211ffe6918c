"""Token-id output by bit-plane shuffling: blocks of ids, transposed into bit or byte planes, each plane compressed.

Texts are range-partitioned by doc_id and encoded where they land; the ids of a partition form one stream that is cut into blocks of
BLOCK ids (the last may be shorter). A block is transposed into 16 or 32 bit planes, or 2 or 4 byte planes, each compressed by
zstandard on its own; planes that are all zero take a few bytes. A block is one row of a Parquet dataset (the planes are binary columns,
Parquet's own compression is off), so Spark's committer makes the output whole even when executors are lost.

The chunk index is a table beside it: one row per block (part, chunk, first id of the block in the whole stream, number of ids, and
the pieces of documents in it). Reading needs only the rows of the blocks wanted.

Nulls count as empty texts; every document has its end id, so none is without a piece. Order is doc_id (null first), then text hash;
repeated rows follow each other. An empty table gives an empty dataset. Other columns are not stored. A task holds one Arrow batch and
one block, however long a text is cut over blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.tokens import VOCABULARY, encoder
from tidepanel.llm.words import sliced, text_of
from tidepanel.sources.scratch import folder

#: Ids of a block; a multiple of 8.
BLOCK = 1 << 16
LEVEL = 3
END = 2
PIECES = "doc_ids array<long>, doc_at array<long>, doc_tokens array<long>, starts array<long>, lengths array<int>"
CHUNK = f"part int, chunk int, first long, n_ids int, layout string, width int, {PIECES}, planes array<binary>"


def to_planes(ids: np.ndarray, layout: str = "bit") -> list[bytes]:
    """Uncompressed planes of unsigned 32-bit ids, lowest first; as many as the widest id of 16 or 32 bits needs."""
    width = 16 if not len(ids) or int(ids.max()) < 1 << 16 else 32
    raw = ids.astype("<u2" if width == 16 else "<u4").view(np.uint8).reshape(-1, width // 8)
    if layout == "byte":
        return [raw[:, b].tobytes() for b in range(width // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(width)]


def from_planes(planes: list[bytes], n: int, layout: str = "bit") -> np.ndarray:
    if layout == "byte":
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    kind = "<u2" if raw.shape[1] == 2 else "<u4"
    return np.ascontiguousarray(raw).view(kind).reshape(-1).astype("<u4")


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: str, block: int, layout: str) -> Iterator[pa.RecordBatch]:
    part, enc, pack = TaskContext.get().partitionId(), encoder(vocabulary), zstandard.ZstdCompressor(level=LEVEL)
    chunk, first, held = 0, 0, []
    pieces: list[tuple[int | None, int, int, int, int]] = []
    room, at = block, 0

    def close() -> pa.RecordBatch:
        nonlocal chunk, first, held, pieces, room
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        planes = [pack.compress(p) for p in to_planes(ids, layout)]
        lists = [list(x) for x in zip(*pieces)]
        row = [part, chunk, first, len(ids), layout, 8 * len(planes) if layout == "byte" else len(planes), *lists, planes]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.int32()), pa.list_(pa.binary())]
        names = [c.split(" ")[0] for c in CHUNK.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)
        chunk, first, held, pieces, room = chunk + 1, first + len(ids), [], [], block
        return out

    for batch in sliced(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = enc.encode(text.as_py(), END)
            n, start = len(ids) // 4, 0
            while start < n:
                take = min(room, n - start)
                held.append(ids[4 * start : 4 * (start + take)])
                pieces.append((doc_id, at, n, start, take))
                start, room = start + take, room - take
                if not room:
                    yield close()
            at += n
    if pieces:
        yield close()


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, block: int = BLOCK, layout: str = "bit") -> None:
    """Writes `path`/blocks and `path`/index."""
    if block % 8 or layout not in ("bit", "byte"):
        raise ValueError("blocks are multiples of 8 ids; layouts are bit and byte")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("h"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").select("doc_id", "text")
    rows.mapInArrow(lambda b: _blocks(b, vocabulary, block, layout), CHUNK).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks").drop("planes")
    # One row per partition: where its ids begin in the whole stream.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    index = blocks.join(F.broadcast(bases), "part").withColumn("first", F.col("first") + F.col("base"))
    index.write.parquet(f"{path}/index")


def _shift(crc: int, n: int) -> int:
    """What a CRC-32 becomes when n bytes follow, apart from their own CRC: multiplication by x^8n modulo the polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(32):
            if a >> (31 - i) & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, by = 1 << 30, 1 << 31  # x, and 1
    e = 8 * n
    while e:
        if e & 1:
            by = times(by, power)
        power, e = times(power, power), e >> 1
    return times(crc, by)


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes([unpack.decompress(p) for p in row["planes"]], row["n_ids"], row["layout"]).tobytes()
            at, sums = 0, []
            for length, start, tokens in zip(row["lengths"], row["starts"], row["doc_tokens"]):
                crc = zlib.crc32(ids[4 * at : 4 * (at + length)])
                sums.append(_shift(crc, 4 * (tokens - start - length)) if start + length < tokens else crc)
                at += length
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_at"], pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                 pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())],
                names=["part", "doc_at", "doc_id", "length", "crc"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, from the written blocks."""
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "n_ids", "layout", "doc_ids", "doc_at", "doc_tokens", "starts", "lengths", "planes")
    pieces = blocks.mapInArrow(_piece_sums, "part int, doc_at long, doc_id long, length long, crc long")
    # The sum of a whole document is the exclusive or of its shifted pieces.
    docs = pieces.groupBy("part", "doc_at", "doc_id").agg(F.sum("length").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    index = spark.read.parquet(f"{path}/index").filter("chunk = 0")
    bases = index.select("part", F.col("first").alias("base"))
    joined = docs.join(F.broadcast(bases), "part")
    return joined.select("doc_id", (F.col("base") + F.col("doc_at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, start: int, length: int) -> np.ndarray:
    """Ids start .. start + length of the stream; only the blocks that hold them are read. For a length that fits the caller."""
    index = spark.read.parquet(f"{path}/index").filter((F.col("first") < start + length) & (F.col("first") + F.col("n_ids") > start))
    wanted = index.select("part", "chunk", F.col("first").alias("global"))
    rows = spark.read.parquet(f"{path}/blocks").join(wanted, ["part", "chunk"]).select("global", "n_ids", "layout", "planes").collect()
    unpack, out = zstandard.ZstdDecompressor(), []
    for r in sorted(rows, key=lambda r: r["global"]):
        ids = from_planes([unpack.decompress(bytes(p)) for p in r["planes"]], r["n_ids"], r["layout"])
        out.append(ids[max(0, start - r["global"]) : max(0, start + length - r["global"])])
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the whole table encoded, written as bit planes and read back."""
    path = f"{folder(spark)}/planes-{np.random.default_rng().integers(1 << 62):x}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
