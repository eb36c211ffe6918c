"""Packing along a space-filling curve: similar documents become neighbours, neighbours share sequences.

A document is a hashed vector: the signed counts of its words in BUCKETS buckets, brought to length 1. A fixed random projection takes it
to DIMENSIONS numbers, each squeezed to BITS bits, and their Hilbert index is the key. Rows are range-partitioned and sorted by
(key, doc_id, text hash), so a hot key is split by doc_id. Each task encodes its stretch of the curve and cuts the stream of ids into
sequences of SEQUENCE ids; what is left at the end of a stretch is cut into sequences whose lengths are powers of two, so nothing is padded.

Null texts count as empty; each document has its end id. Documents without words have the key of the zero vector. Repeated rows are
packed one after another. An empty table has no pieces. Other columns are not used. A task holds one Arrow batch of texts and works on
slices of about a megabyte; a text of any length is encoded whole and cut over sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tokens import VOCABULARY, encoder
from tidepanel.llm.words import hash_words, mix, sliced, text_of

SEQUENCE = 2048
END = 1
BUCKETS = 64
DIMENSIONS = 4
BITS = 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def vectors(texts: pa.Array) -> np.ndarray:
    """Hashed word counts, one row of length 1 (or 0) per text."""
    words = hash_words(texts)
    own = np.repeat(np.arange(len(words)), words.counts)
    h = mix(words.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    flat = np.bincount(own * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), weights=sign, minlength=len(words) * BUCKETS)
    v = flat.reshape(len(words), BUCKETS)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n x d, each below 2^bits): Skilling's transpose form, all points at once."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | x[i] >> b & 1
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    project = np.random.default_rng(3).standard_normal((BUCKETS, DIMENSIONS))
    flat = np.tanh(vectors(texts) @ project)
    return hilbert_index(np.minimum(((flat + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        keys = pa.array(curve_keys(batch.column("text")), type=pa.int64())
        yield pa.RecordBatch.from_arrays([keys, batch.column("doc_id"), batch.column("text")], names=["key", "doc_id", "text"])


def lengths_of(rest: int, sequence: int = SEQUENCE) -> list[int]:
    """Powers of two that add up to the rest, largest first."""
    return [1 << b for b in range(sequence.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, sequence: int) -> Iterator[pa.RecordBatch]:
    enc, stretch = encoder(vocabulary), TaskContext.get().partitionId() << 40
    number, waiting, held = 0, [], 0  # pieces (doc_id, start, ids, doc_tokens) of the sequence being filled
    out: list[tuple] = []

    def emit(pieces, length: int) -> None:
        nonlocal number
        at = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), tokens, stretch + number, at, length))
            at += n
        number += 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split(" ")[0] for c in PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=names)

    for batch in sliced(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = enc.encode(text.as_py(), END)
            tokens, start = len(ids) // 4, 0
            while start < tokens:
                take = min(sequence - held, tokens - start)
                waiting.append((doc_id, start, ids[4 * start : 4 * (start + take)], tokens))
                start, held = start + take, held + take
                if held == sequence:
                    emit(waiting, sequence)
                    waiting, held = [], 0
        if out:
            yield batch_of(out)
            out.clear()
    for length in lengths_of(held, sequence):
        pieces, room = [], length
        while room:
            doc_id, start, ids, tokens = waiting[0]
            take = min(room, len(ids) // 4)
            pieces.append((doc_id, start, ids[: 4 * take], tokens))
            waiting[0] = (doc_id, start + take, ids[4 * take :], tokens)
            room -= take
            if not waiting[0][2]:
                waiting.pop(0)
        emit(pieces, length)
    if out:
        yield batch_of(out)


def along_curve(docs: DataFrame) -> DataFrame:
    """doc_id and text, range-partitioned and sorted along the curve."""
    keyed = docs.select("doc_id", text_of().alias("text")).mapInArrow(_keyed, "key long, doc_id long, text string")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "key", F.col("doc_id").asc_nulls_first(), "h")
    return dealt.sortWithinPartitions("key", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece; sequence_tokens is the length of the sequence, which it is padded to."""
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("the length of a sequence is a power of two")
    return along_curve(docs).mapInArrow(lambda b: _packed(b, vocabulary, sequence), PIECE)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the whole table."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
