"""Interpolated modified Kneser-Ney language model of any order, counted in Spark, stored as sorted hash arrays and scored
by workers that map those arrays into memory.

Words are known by their 64-bit hash; a word's number is its place in the sorted array of all hashes. An n-gram is the
tuple of its words' numbers; its key is a 64-bit hash of the tuple, for pairs one that can be undone, so pairs never
collide. Map tasks count the highest n-grams of a stretch of text with numpy and send blocks cut by ranges of the key;
each range is merged by one task, tuple by tuple, and written as one file of sorted keys and counts in the shared folder.
Lower orders follow from the files of the order above: how many different words stand before an n-gram (those at a text's
begin have none before them and keep their counts), and for each context its sum and how many followers it has with
count 1, 2 and more.

Keys are hashes, so a common word or context is spread over all ranges. There are as many ranges as make RANGE_KEYS keys
each at most; with more than FAN of them blocks go there in two steps, merged on the way, so that more text means more
ranges, not smaller blocks. The driver sees one line per file and the counts of counts.

Files in a folder that the workers' system mounts are mapped; of other stores a worker holds CACHE_BYTES at a time.

Defined results: a null or empty text is the end token alone; a text is scored whole, however long; equal rows are rows
of their own; a null doc_id is kept; an empty training table gives a model without words, in which every token has the
probability 1; an empty table gives no rows; other columns are not read. More than 2^32 - 2 different words are refused."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, new_dir, settle, slices

#: Order of the model; text bytes per range of words; keys per range of n-grams; tokens per counted stretch; words a
#: worker remembers before it begins anew; ranges that blocks are cut into at once.
ORDER, RANGE_BYTES, RANGE_KEYS, STRETCH, REMEMBERED, FAN = 2, 32 << 20, 2_500_000, 1_000_000, 300_000, 1024
CACHE_BYTES = 256 << 20
#: No word holds a blank, so none has this hash.
END = xxhash.xxh64_intdigest(b" ")
BLOCK = "part int, data binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("data", pa.binary())])
MOST_WORDS = (1 << 32) - 2


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _unmix(x: np.ndarray) -> np.ndarray:
    inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(32))) * inverse
    x = (x ^ (x >> np.uint64(32))) * inverse
    return x ^ (x >> np.uint64(32))


def next_key(key: np.ndarray | None, first: np.ndarray | None, number: np.ndarray) -> np.ndarray:
    """The key of a tuple and one more number: key is the tuple's, first its only number where it has one."""
    number = number.astype(np.uint64)
    if key is None:
        return _mix(number)
    if first is not None:
        return _mix(first.astype(np.uint64) << np.uint64(32) | number)
    return _mix(key * np.uint64(0x9E3779B97F4A7C15) + number + np.uint64(1))


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """The keys of tuples of word numbers."""
    key = None
    for k, c in enumerate(columns):
        key = next_key(key, columns[0] if k == 1 else None, c)
    return key


def _lows(parts: int) -> np.ndarray:
    return np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)


Tuples = tuple[list[np.ndarray], list[np.ndarray]]  # columns of word numbers (or one of word hashes), and values to add


def _pack(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Byte planes, as many of each array as its greatest value needs, and differences of the first column: what hardly
    changes is compressed away."""
    arrays = [np.concatenate([columns[0][:1], np.diff(columns[0])]), *columns[1:], *values]
    widths = bytes(max(1, (int(x.max()).bit_length() + 7) // 8) for x in arrays)
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for x, w in zip(arrays, widths, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(widths + b"".join(planes))


def _unpack(data: bytes, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths, out, at = raw[:width].tolist(), [], width
    n = (len(raw) - width) // sum(widths)
    for w in widths:
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(whole.view("<u8").ravel())
        at += n * w
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _summed(columns: list[np.ndarray], values: list[np.ndarray], key: Callable = keys_of) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(sorted keys, columns, summed values) of distinct tuples."""
    keys = key(columns)
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    if not len(keys):
        return keys, columns, values
    new = keys[1:] != keys[:-1]
    for c in columns:
        new |= c[1:] != c[:-1]
    first = np.flatnonzero(np.append(True, new))
    return keys[first], [c[first] for c in columns], [np.add.reduceat(v[order], first) for v in values]


def _cut(columns: list[np.ndarray], values: list[np.ndarray], parts: int, key: Callable = keys_of) -> pa.RecordBatch:
    """Distinct tuples with summed values as blocks, one for each range of keys that has some."""
    keys, columns, values = _summed(columns, values, key)
    cuts = np.append(np.searchsorted(keys, _lows(parts)), len(keys)).tolist()
    full = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    packed = []
    for _, a, b in full:
        order = np.argsort(columns[0][a:b], kind="stable")
        packed.append(_pack([c[a:b][order] for c in columns], [v[a:b][order] for v in values]))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in full], pa.int32()), pa.array(packed, pa.binary())], schema=BLOCK_ARROW)


def _gathered(blocks: list[bytes], n_columns: int, n_values: int) -> Tuples:
    parts = [_unpack(x, n_columns + n_values) for x in blocks]
    whole = [np.concatenate([p[k] for p in parts]) for k in range(n_columns + n_values)]
    return whole[:n_columns], whole[n_columns:]


def _exchange(blocks: DataFrame, parts: int, n_columns: int, n_values: int, fan: int, key: Callable = keys_of) -> DataFrame:
    """Blocks cut into min(parts, fan) ranges, as blocks of all the ranges: with more than fan ranges, blocks meet by coarse
    range first, are merged some at a time, and are cut finely."""
    if parts <= fan:
        return blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 16):
            for data in batch["data"].to_pylist():
                held.append(data)
                size += len(data)
            if size > 32 << 20:
                yield _cut(*_gathered(held, n_columns, n_values), parts, key)
                held, size = [], 0
        if held:
            yield _cut(*_gathered(held, n_columns, n_values), parts, key)

    return blocks.repartition(fan, "part").mapInArrow(run, BLOCK)


def _store(folder: str, name: str, *arrays: np.ndarray) -> str:
    """One file of arrays, one after the other; a repeated task writes another file, and only the one it reports counts."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/{path}") as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data.cast("B")) if a.size else None
    return f"{folder}/{path}"


_HELD: OrderedDict[tuple, tuple[np.ndarray, ...]] = OrderedDict()


def _open(path: str, n: int, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The arrays of a file, n items each: mapped, or from other stores read, the latest CACHE_BYTES of them held."""
    if not n:
        return tuple(np.zeros(0, k) for k in kinds)
    if (got := _HELD.get((path, kinds))) is not None:
        _HELD.move_to_end((path, kinds))
        return got
    store, place = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        data, most = np.memmap(place, np.uint8, "r"), 1 << 60
    else:
        with store.open_input_file(place) as file:
            data, most = np.frombuffer(file.read(), np.uint8), CACHE_BYTES
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(data[at : at + size].view(k))
        at += size
    _HELD[path, kinds] = tuple(out)
    while len(_HELD) > 4096 or (most < 1 << 60 and len(_HELD) > 1 and sum(x.nbytes for xs in _HELD.values() for x in xs) > most):
        _HELD.popitem(last=False)
    return tuple(out)


WORD_ARRAYS, GRAM_ARRAYS, CONTEXT_ARRAYS, FOLLOW_ARRAYS = ("u8", "i8"), ("u8", "u4"), ("u8", "i8", "u4", "u4", "u4"), ("i8",)
#: Marks files of n-grams with a count beyond 32 bits.
WIDE = "wide"
Files = tuple[tuple[str, int], ...]


def _kinds(path: str, kinds: tuple[str, ...]) -> tuple[str, ...]:
    return ("u8", "u8") if WIDE in path.rsplit("/", 1)[-1] else kinds


@dataclass(frozen=True)
class Level:
    """An order's n-grams by range of key: keys and counts; its contexts by range of key: keys, sums and followers with
    count 1, 2 and more; the discounts."""

    grams: Files = ()
    contexts: Files = ()
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Model:
    """Files by range: (path, items). words: hashes, counts; follows: by word number, how many words precede each word;
    levels: orders 2, 3..."""

    n_tokens: int = 0
    n_words: int = 0
    words: Files = ()
    follows: Files = ()
    n_pairs: int = 0
    lower_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    lower_left: float = 1.0
    levels: tuple[Level, ...] = ()

    @property
    def order(self) -> int:
        return len(self.levels) + 1

    def number_lows(self) -> np.ndarray:
        """First word number of each range of follows."""
        parts = max(len(self.follows), 1)
        return np.array([-(-p * self.n_words // parts) for p in range(parts + 1)], np.int64)


def _in_ranges(sorted_keys: np.ndarray, lows: np.ndarray, found: Callable[[int, np.ndarray], np.ndarray], kind=np.int64) -> np.ndarray:
    """found(range, keys) for the part of sorted keys in each range, joined."""
    cuts = np.append(np.searchsorted(sorted_keys, lows), len(sorted_keys))
    parts = [found(p, sorted_keys[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Numbers:
    """Word numbers by the mapped arrays, with the words met lately remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.lows, self.known = model, _lows(max(len(model.words), 1)), {}
        self.firsts = np.cumsum([0] + [n for _, n in model.words])
        self.end = int(self.lookup(np.array([END], np.uint64))[0]) if model.words else -1

    def _part(self, p: int, hashes: np.ndarray) -> np.ndarray:
        path, n = self.model.words[p]
        if not n:
            return np.full(len(hashes), -1)
        own = _open(path, n, WORD_ARRAYS)[0]
        at = np.minimum(np.searchsorted(own, hashes), n - 1)
        return np.where(own[at] == hashes, at + self.firsts[p], -1)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of hashes; -1 for words that are not in the model."""
        order = np.argsort(hashes)
        out = np.empty(len(hashes), np.int64)
        out[order] = _in_ranges(hashes[order], self.lows, self._part)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        if new:
            new = list(new)
            found = self.lookup(np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))) if self.model.words else np.full(len(new), -1)
            known.update(zip(new, found.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _numbered(texts: list[bytes], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all tokens with the ends, place of each in its text from 0, tokens per text)."""
    split = [words_of(x) for x in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(sizes) - 1
    ids = np.empty(int(sizes.sum()), np.int64)
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    ids[inner] = numbers.of([w for words in split for w in words])
    ids[ends] = numbers.end
    return ids, np.arange(len(ids)) - np.repeat(ends - sizes + 1, sizes), sizes


def _before(ids: np.ndarray, place: np.ndarray, k: int, begin: int) -> np.ndarray:
    """The number k tokens before each; the text's begin just before its first token, and nothing sensible before that."""
    out = np.full(len(ids), begin, np.int64)
    out[k:] = ids[: len(ids) - k] if k else ids
    return np.where(place >= k, out, begin)


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of items seen 1 to 4 times; 0.5 where they aren't defined."""
    if not n[0]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0, k)) if n[k - 1] else 0.5 for k in (1, 2, 3))


FILE = "part int, path string, n long, tuples string, seen array<long>"


def _blocks_of(texts: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Tuples]], parts: int, key: Callable = keys_of) -> DataFrame:
    """The tuples that make()'s function finds in each batch, counted over stretches of STRETCH tokens, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, n = make(), [], 0
        for batch in slices(batches, 128):
            held.append(found(batch))
            n += len(held[-1][0][0])
            if n >= STRETCH:
                yield _cut(*_joined(held), parts, key)
                held, n = [], 0
        if held:
            yield _cut(*_joined(held), parts, key)

    return texts.mapInArrow(run, BLOCK)


def _joined(held: list[Tuples]) -> Tuples:
    return tuple([np.concatenate([x[k][j] for x in held]) for j in range(len(held[0][k]))] for k in (0, 1))


def _files(manifest: DataFrame, parts: int) -> tuple[Files, list[dict]]:
    rows = [r.asDict() for r in manifest.collect()]  # a line per range
    made = {r["part"]: r for r in rows}
    return tuple((made[p]["path"], made[p]["n"]) if p in made else ("", 0) for p in range(parts)), rows


def _hash_keys(columns: list[np.ndarray]) -> np.ndarray:
    return columns[0]


def train(docs: DataFrame, order: int | None = None, range_bytes: int = RANGE_BYTES, range_keys: int = RANGE_KEYS, fan: int = FAN) -> Model:
    """Counts the texts of docs and writes the model's files to the shared folder. order: 2 or more."""
    order = ORDER if order is None else order
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not size["rows"]:
        return Model()
    folder = new_dir(spark, "lm")

    # ---- words
    parts = max(1, -(-int(size["n"] or 0) // range_bytes))

    def words() -> Callable[[pa.RecordBatch], Tuples]:
        known: dict[bytes, int] = {}

        def found(batch: pa.RecordBatch) -> Tuples:
            split = [words_of(x) for x in bytes_of(batch["text"])]
            words = [w for x in split for w in x]
            new = set(words).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            known.update(zip(new, map(xxhash.xxh64_intdigest, new), strict=True))
            hashes = np.concatenate([np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.full(len(split), END, np.uint64)])
            return [hashes], [np.ones(len(hashes), np.uint64)]

        return found

    def merge_words(table: pa.Table) -> pa.Table:
        keys, _, (counts,) = _summed(*_gathered(table["data"].to_pylist(), 1, 1), _hash_keys)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "path": [_store(folder, "words", keys, counts)], "n": [len(keys)], "tokens": [int(counts.sum())]})

    blocks = _exchange(_blocks_of(texts, words, min(parts, fan), _hash_keys), parts, 1, 1, fan, _hash_keys)
    made = settle(blocks.groupBy("part").applyInArrow(merge_words, "part int, path string, n long, tokens long"), "lm-words")
    files, rows = _files(made, parts)
    base = Model(n_tokens=sum(r["tokens"] for r in rows), n_words=sum(r["n"] for r in rows), words=files)
    if base.n_words > MOST_WORDS:
        raise ValueError(f"{base.n_words} different words; word numbers have 32 bits")
    begin = base.n_words
    parts = max(1, -(-base.n_tokens // range_keys))

    # ---- n-grams of the highest order, and shorter ones at a text's begin
    def grams(k: int) -> Callable[[], Callable[[pa.RecordBatch], Tuples]]:
        def start() -> Callable[[pa.RecordBatch], Tuples]:
            numbers = Numbers(base)

            def found(batch: pa.RecordBatch) -> Tuples:
                ids, place, _ = _numbered(bytes_of(batch["text"]), numbers)
                at = np.flatnonzero(place >= k - 2) if k == order else np.flatnonzero(place == k - 2)
                columns = [_before(ids, place, j, begin)[at].astype(np.uint64) for j in range(k - 1, -1, -1)]
                return columns, [np.ones(len(at), np.uint64)]

            return found

        return start

    def merge_grams(k: int) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            keys, columns, (counts,) = _summed(*_gathered(table["data"].to_pylist(), k, 1))
            wide = len(counts) and counts.max() > 0xFFFFFFFF
            tuples = _store(folder, f"tuples{k}", *[c.astype(np.uint32) for c in columns]) if k > 2 else ""
            return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "path": [_store(folder, f"grams{k}{WIDE if wide else ''}", keys, counts.astype("u8" if wide else "u4"))], "n": [len(keys)], "tuples": [tuples], "seen": [_count_of_counts(counts)]})

        return merge

    def from_files(k: int, make: Callable[[list[np.ndarray], np.ndarray], Tuples], cut: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Blocks of what make finds in each file's columns and counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, n, tuples in zip(batch["path"].to_pylist(), batch["n"].to_pylist(), batch["tuples"].to_pylist(), strict=True):
                    keys, counts = _open(path, n, _kinds(path, GRAM_ARRAYS))
                    if k > 2:
                        columns = [c.astype(np.uint64) for c in _open(tuples, n, ("u4",) * k)]
                    else:
                        pair = _unmix(np.asarray(keys))
                        columns = [pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)]
                    yield _cut(*make(columns, np.asarray(counts)), cut)

        return run

    def contexts(columns: list[np.ndarray], counts: np.ndarray) -> Tuples:
        one = lambda x: x.astype(np.uint64)
        return columns[:-1], [one(counts), one(counts == 1), one(counts == 2), one(counts > 2)]

    def suffixes(columns: list[np.ndarray], counts: np.ndarray) -> Tuples:
        return columns[1:], [np.ones(len(counts), np.uint64)]

    def merge_contexts(k: int) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            keys, _, (total, *kinds) = _summed(*_gathered(table["data"].to_pylist(), k - 1, 4))
            return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "path": [_store(folder, f"contexts{k}", keys, total, *[x.astype(np.uint32) for x in kinds])], "n": [len(keys)]})

        return merge

    levels: list[Level] = []
    n_grams = base.n_tokens
    blocks = _blocks_of(texts, grams(order), min(parts, fan))
    for k in range(order, 1, -1):
        manifest = settle(_exchange(blocks, parts, k, 1, fan).groupBy("part").applyInArrow(merge_grams(k), FILE), f"lm-grams{k}")
        files, rows = _files(manifest, parts)
        n_grams = sum(r["n"] for r in rows)
        spread = manifest.select("path", "n", "tuples").repartition(parts, "path")
        below = max(1, -(-n_grams // range_keys))
        found = _exchange(spread.mapInArrow(from_files(k, contexts, min(below, fan)), BLOCK), below, k - 1, 4, fan)
        context_files, _ = _files(settle(found.groupBy("part").applyInArrow(merge_contexts(k), "part int, path string, n long"), f"lm-contexts{k}"), below)
        levels.insert(0, Level(files, context_files, discounts_of([sum(r["seen"][j] for r in rows) for j in range(4)])))
        if k > 2:
            blocks = spread.mapInArrow(from_files(k, suffixes, min(below, fan)), BLOCK).unionByName(_blocks_of(texts, grams(k - 1), min(below, fan)))
            parts = below

    # ---- words by how many different ones stand before them
    follow_parts = max(1, -(-base.n_words // range_keys))
    lows = np.array([-(-p * base.n_words // follow_parts) for p in range(follow_parts + 1)], np.int64)

    def count_follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch["path"].to_pylist(), batch["n"].to_pylist(), strict=True):
                numbers, n_before = np.unique(_unmix(np.asarray(_open(path, n, _kinds(path, GRAM_ARRAYS))[0])) & np.uint64(0xFFFFFFFF), return_counts=True)
                cuts = np.append(np.searchsorted(numbers, lows[:-1].astype(np.uint64)), len(numbers)).tolist()
                full = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in full], pa.int32()), pa.array([_pack([numbers[a:b]], [n_before[a:b]]) for _, a, b in full], pa.binary())], schema=BLOCK_ARROW)

    def merge_follows(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        dense = np.zeros(int(lows[part + 1] - lows[part]), np.int64)
        for data in table["data"].to_pylist():  # dense, so blocks are added one by one
            numbers, n_before = _unpack(data, 2)
            dense[numbers.astype(np.int64) - lows[part]] += n_before.astype(np.int64)
        return pa.table({"part": pa.array([part], pa.int32()), "path": [_store(folder, "follows", dense)], "n": [len(dense)], "seen": [_count_of_counts(dense)], "types": [int((dense > 0).sum())]})

    made = settle(spread.mapInArrow(count_follows, BLOCK).groupBy("part").applyInArrow(merge_follows, "part int, path string, n long, seen array<long>, types long"), "lm-follows")
    follow_files, rows = _files(made, follow_parts)
    seen = [sum(r["seen"][j] for r in rows) for j in range(4)]
    lower = discounts_of(seen)
    more = sum(r["types"] for r in rows) - seen[0] - seen[1]
    left = (lower[0] * seen[0] + lower[1] * seen[1] + lower[2] * more) / n_grams
    return Model(base.n_tokens, base.n_words, base.words, follow_files, n_grams, lower, left, tuple(levels))


def _dense(files: Files, kinds: tuple[str, ...], which: int, numbers: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Values of one array at sorted word numbers; 0 where a range has no file."""

    def found(p: int, own: np.ndarray) -> np.ndarray:
        path, n = files[p]
        return np.asarray(_open(path, n, kinds)[which][own - lows[p]], np.int64) if n else np.zeros(len(own), np.int64)

    return _in_ranges(numbers, lows, found)


def _values(files: Files, kinds: tuple[str, ...], keys: np.ndarray) -> np.ndarray:
    """All arrays but the first at sorted keys, a row each; 0 where a key is not there."""

    def found(p: int, own: np.ndarray) -> np.ndarray:
        path, n = files[p]
        if not n:
            return np.zeros((len(own), len(kinds) - 1), np.int64)
        stored, *values = _open(path, n, _kinds(path, kinds))
        at = np.minimum(np.searchsorted(stored, own), n - 1)
        return np.where((stored[at] == own)[:, None], np.stack([v[at].astype(np.int64) for v in values], 1), 0)

    if not len(keys):
        return np.zeros((0, len(kinds) - 1), np.int64)
    return _in_ranges(keys, _lows(len(files)), found)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.numbers = model, Numbers(model)
        self.firsts, self.lows = self.numbers.firsts[:-1], model.number_lows()[:-1]

    def logs(self, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the add-one unigram probability, log10 of the model's probability) of each token; ids in text order,
        -1 for unknown words, with their places in their texts."""
        m = self.model
        if not m.n_words:
            return np.zeros(len(ids)), np.zeros(len(ids))
        word, inverse = np.unique(ids, return_inverse=True)
        old = word >= 0
        count, follow = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        count[old] = _dense(m.words, WORD_ARRAYS, 1, word[old], self.firsts)
        follow[old] = _dense(m.follows, FOLLOW_ARRAYS, 0, word[old], self.lows)
        base = np.log10((count + 1) / (m.n_tokens + m.n_words + 1))
        lower = np.maximum(follow - np.array([0.0, *m.lower_discounts])[np.minimum(follow, 3)], 0) / m.n_pairs + m.lower_left / (m.n_words + 1)
        p = lower[inverse]
        known = np.ones(len(ids), bool)  # whether all words of the context are in the model
        for k, level in enumerate(m.levels, 2):
            known &= _before(ids, place, k - 1, 0) >= 0
            at = np.flatnonzero(known & (place >= k - 2))
            columns = [_before(ids, place, j, m.n_words)[at] for j in range(k - 1, 0, -1)]
            context = keys_of([c.astype(np.uint64) for c in columns])
            keys, back = np.unique(context, return_inverse=True)
            stats = _values(level.contexts, CONTEXT_ARRAYS, keys)
            left = stats[:, 1:] @ np.array(level.discounts) / np.maximum(stats[:, 0], 1)  # of each different context
            here = (stats[:, 0] > 0)[back]
            at, context, back = at[here], context[here], back[here]
            p[at] *= left[back]
            two = np.flatnonzero(ids[at] >= 0)
            total = stats[:, 0].astype(float)[back[two]]
            gram = next_key(context[two], columns[0][here][two] if k == 2 else None, ids[at][two])
            keys, inside = np.unique(gram, return_inverse=True)
            c = _values(level.grams, GRAM_ARRAYS, keys)[:, 0][inside]
            p[at[two]] += np.maximum(c - np.array([0.0, *level.discounts])[np.minimum(c, 3)], 0) / total
        return base[inverse], np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): sums of log10 probabilities over each whole text and its end."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)

        def flush(held: list) -> pa.RecordBatch:
            ids, place, sizes = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            base, own = scorer.logs(ids, place)
            at = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, at) for x in ((ids >= 0).astype(np.int64), base, own)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in held]), pa.array(sizes), *map(pa.array, sums)], schema=kind)

        held, n = [], 0
        for batch in slices(batches, 128):
            held.append((batch["doc_id"], *_numbered(bytes_of(batch["text"]), scorer.numbers)))
            n += len(held[-1][1])
            if n >= STRETCH:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
