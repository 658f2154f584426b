"""Byte-level BPE by a sentencepiece model that is serialised from a rank vocabulary.

Each token's bytes become one character each (the usual byte-to-character table of byte-level BPE), its score is its
negative rank, and normalisation is the identity; merging by best score is then merging by lowest rank. Texts are cut
into pre-tokens by the vocabulary's pattern, pre-tokens are encoded by sentencepiece, and ids are decoded by the inverse
of the byte table. The vocabulary file is read on the driver; its bytes, bounded by the file, go with the tasks.

Defined results: a null or empty text has no ids and decodes to no bytes; equal rows are rows of their own; a null
doc_id is kept; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pre-tokens whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 400_000


def byte_table() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank) by rank; ranks must be 0, 1, 2..."""
    with open(path, "rb") as file:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must have no gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file: piece 0 is <unk>, piece rank + 1 is the token of that rank."""
    table = byte_table()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(table[b] for b in t).encode()) + _field(2, float(-r)) + _field(3, 1) for r, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def latin_pattern(pattern: str) -> str | None:
    """The same pattern for texts of U+0000 to U+00FF alone, with \\p{L}, \\p{N}, \\s and \\S spelt out, so that the quicker
    standard module can run it; None where it has other properties."""
    spelt = {"L": "", "N": "", "s": ""}
    for c in map(chr, range(256)):
        kind = unicodedata.category(c)[0]
        if kind in "LN":
            spelt[kind] += c
        elif regex.fullmatch(r"\s", c):
            spelt["s"] += re.escape(c)

    def one(m: re.Match) -> str:
        inside = lambda x: re.sub(r"\\p\{([LN])\}|\\(s)", lambda k: spelt[k[1] or k[2]], x)
        return inside(m[0]) if m[0][0] == "[" else f"[^{spelt['s']}]" if m[0] == r"\S" else f"[{inside(m[0])}]"

    out = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", one, pattern)
    return None if re.search(r"\\[pPwWdDbB]|\(\?[^:!=<]", out) else out


class Codec:
    def __init__(self, model: bytes, pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.find_latin = re.compile(latin).findall if latin else self.find
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        inverse = {c: b for b, c in enumerate(byte_table())}
        #: The bytes of each id: its piece's characters back through the inverse table.
        self.decoded = [bytes(map(inverse.__getitem__, self.processor.id_to_piece(i))) for i in range(1, self.processor.get_piece_size())]
        #: UTF-8 has no byte 255; it stands between pre-tokens, as a character that is in no piece.
        self.units = np.array([*map(ord, byte_table()[:255]), 10], "<u2")
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Pre-tokens not met lately go through sentencepiece in one call: the character between them is in no piece, so
        nothing merges over it."""
        known = self.known
        try:
            text.encode("latin-1")
            words = self.find_latin(text)
        except UnicodeEncodeError:
            words = self.find(text)
        new = list(set(words).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(words))
        if new:
            joined = "\udcff".join(new).encode("utf-8", "surrogateescape")
            mapped = self.units[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.processor.encode(mapped), np.uint32)
            flat = memoryview((ids - np.uint32(1)).tobytes())
            ends = np.append(np.flatnonzero(ids == 0), len(ids))
            begins = np.append(0, ends[:-1] + 1)
            known.update(zip(new, (bytes(flat[a:b]) for a, b in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)), strict=True))
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))


@lru_cache(2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): ids of the whole text, and the bytes they decode to."""
    model = serialise(read_ranks(path))
    shipped = docs.sparkSession.sparkContext.broadcast((model, pattern))  # as large as the vocabulary file
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shipped.value)
        for batch in slices(batches, 64):
            ids = [codec.encode(x or "") for x in batch["text"].to_pylist()]
            offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([codec.decode(x) for x in ids], pa.binary())], schema=kind)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows; ids are hashed as little-endian unsigned 32 bits."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = batch["ids"].flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = np.cumsum([0, *batch["ids"].value_lengths().to_pylist()])
            ids = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            decoded = [hashlib.sha256(x).hexdigest() for x in batch["decoded"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at)), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=kind)

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
