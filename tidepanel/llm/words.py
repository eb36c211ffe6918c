"""Words of a text: as native column expressions, and as 64-bit hashes of whole Arrow batches for numpy.

Both use one definition. A-Z is lower-cased; a word is a longest run of ASCII digits, ASCII letters and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, after lower-casing.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_of(text: Column | str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of words; empty for a text without any."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def row_key(df: DataFrame, *more: str) -> Column:
    """128-bit key of (doc_id, text): equal rows share it, rows that only share a doc_id do not."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in ("doc_id", *more)]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts, text_of())))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = _LETTER[ord("0") : ord("9") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


@dataclass
class Words:
    """Words of a batch of texts; text i has the words first[i] .. first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


#: Bytes hashed at a time; bounds the arrays that are eight times as large. Longer texts are cut between words.
SPAN = 1 << 19
#: Rows and bytes of text that a task works on at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows and about SLICE_BYTES of text (a longer text is a slice of its own)."""
    for batch in batches:
        texts = batch.column(column)
        sizes = _ends(texts)
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = int(np.searchsorted(sizes, before + SLICE_BYTES, "right"))
            to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch, texts
        pa.default_memory_pool().release_unused()


def _ends(texts: pa.Array) -> np.ndarray:
    """Running sum of the byte lengths; nulls have none."""
    return np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def raw_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts in them) as a view where possible. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """64-bit hashes of all words. Nulls have none."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64))
    hashes, counts = [], np.zeros(n, dtype=np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SPAN, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if to > at + 1:
            spans = [(part, offsets[at : to + 1] - offsets[at])]
        else:
            spans = ((piece, np.array([0, len(piece)])) for piece in _pieces(part))
        for piece, cuts in spans:
            found, per_text = _hash_span(piece, cuts)
            hashes.append(found)
            counts[at:to] += per_text
        at = to
    return Words(np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One text in pieces of about SPAN bytes that end between words."""
    at = 0
    while len(data) - at > 2 * SPAN:
        to, gap = at + SPAN, np.zeros(0, np.int64)
        while to < len(data) and not len(gap):
            gap = np.flatnonzero(~_LETTER[_LOWER[data[to : to + SPAN]]])
            to = to + int(gap[0]) if len(gap) else min(len(data), to + SPAN)
        yield data[at:to]
        at = to
    yield data[at:]


def word_edges(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in lower-cased bytes; a word ends where its text does."""
    inside = _LETTER[low]
    # A word starts where a letter follows none, or where a text starts.
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(low))]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def range_hashes(low: np.ndarray):
    """A function of (starts, ends) that hashes ranges of these bytes."""
    up, down = _power_tables(len(low) + 1)
    sums = np.empty(len(low) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts])


def _hash_span(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[data]
    starts, ends = word_edges(low, offsets)
    return range_hashes(low)(starts, ends), np.diff(np.searchsorted(starts, offsets))


def word_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(all lower-cased words as bytes, how many there are before each text and after the last)."""
    data, offsets = raw_bytes(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    starts, ends = word_edges(low, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = np.ascontiguousarray(low[_LETTER[low]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; runs over the end of the array are left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += words[j : j + n]
    return mix(out)
