"""Token ids of whole texts with a public tokenizer file, with a bounded store of words already seen.

White space separates tokens of this vocabulary, so a text is split there and each piece is encoded once per Python worker. A
piece of Latin letters, with or without ASCII punctuation behind, goes straight to the model; any other piece through the whole
tokenizer. Ids come as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
import struct

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Pieces of a generation; two generations are kept per worker (about 200 bytes a piece), so frequent pieces stay.
KEPT_PIECES = 400_000

# Letters whose lower case and composition are those of one code point, then punctuation that no special token and no contraction has.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")
# Blanks to Python that are none to the tokenizer; texts with one are split at ASCII blanks only.
_ODD = re.compile(r"[\x1c-\x1f]")
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Kept(dict):
    """Values by key, made when first asked for; the generation before the current one is remembered."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.runs = Kept(self._run, KEPT_PIECES // 2)
        self.pieces = Kept(self._piece, KEPT_PIECES)

    def _run(self, run: str) -> bytes:
        """Lower-case letters, or punctuation: one word to the model."""
        mapped = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        word, marks = plain.groups()
        return self.runs[word.lower()] + self.runs[marks] if marks else self.runs[word.lower()]

    def encode(self, text: str | None, end: int) -> bytes:
        """Ids of the text (null: none) and the id `end`."""
        text = text or ""
        pieces = text.split() if not _ODD.search(text) else filter(None, _BLANK.split(text))
        return b"".join(map(self.pieces.__getitem__, pieces)) + struct.pack("<I", end)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One per Python worker. The file's place is found on the machine that runs the task."""
    if vocabulary not in _encoders:
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        _encoders[vocabulary] = Encoder(path)
    return _encoders[vocabulary]
