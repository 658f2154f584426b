"""Removal of word passages that an earlier document already has, by super-k-mers.

A window is `width` consecutive words of one text. Each window belongs to the minimiser among its runs of `core` words (the
least hash); consecutive windows with one minimiser travel as one packed string to the minimiser's bucket. There the
windows are sorted, equal ones compared word by word, and the smallest doc_id of each distinct window goes back to the
groups of documents that sent it. A word is removed when some window that covers it starts in a document with a smaller
doc_id; windows are judged on the texts as they came.

How it stays even and bounded. Documents are dealt to groups by hash; a group sends each distinct string once, with the
smallest and largest of its doc_ids, so that a passage in a third of all documents arrives once for each group. A first
pass counts strings in 65,536 bins of the minimisers' hashes; windows of bins far above the mean (a common phrase among
ever different words) go to buckets by the hash of the whole window, one by one. Both rules look at the windows' words
alone, so equal windows always meet. Strings whose minimiser only one document has are dropped unread. Answers are
matched by a 128-bit hash of the string.

Defined results: a null or empty text has no words and an empty rest; a text is read whole, however long, and one with
fewer than `width` words keeps all; rows of equal doc_id do not remove from each other, since neither is smaller; a null
doc_id is larger than all others, and equal to another null (the largest long counts as null); repeated rows give
repeated results; an empty table gives no rows; only doc_id and text are read, whatever other columns there are."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of

WIDTH, CORE = 13, 3
BINS = 1 << 16
#: A bin is hot beyond so many times the mean, and this many strings more.
HOT_TIMES, HOT_LEAST = 4, 4096
#: Text of a group of documents, and strings of a bucket, that a task aims to hold.
GROUP_BYTES, BUCKET_STRINGS = 32 << 20, 400_000
CHUNK_BYTES = 8 << 20
NO_ID = (1 << 63) - 1
ODD = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words; a bounded number of short words is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * ODD[-1]
    x = (x ^ (x >> np.uint64(29))) * ODD[-2]
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """A hash of n consecutive numbers of h, at each place or at those of `at`."""
    out = np.zeros(len(h) - n + 1 if at is None else len(at), np.uint64)
    for j in range(n):
        out += (h[j : len(h) - n + 1 + j] if at is None else h[at + j]) * ODD[j]
    return out


class Chunk:
    """Some texts as words, and their super-k-mers: from window `first` to window `last`, each with its bucket's hash."""

    def __init__(self, texts: list[bytes], hot: np.ndarray, width: int, core: int):
        split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.words = [w for words in split for w in words]
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.joined = b" ".join(self.words)
        self.h = np.fromiter(map(HASHES.__getitem__, self.words), np.uint64, n)
        spaces = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)
        self.begin, self.end = np.append(0, spaces + 1), np.append(spaces, len(self.joined))
        self.first = self.last = np.zeros(0, np.int64)
        self.value = np.zeros(0, np.uint64)
        if n < width:
            return
        least, span, wide = mixed(rolled(self.h, None, core)), 1, width - core + 1
        while span < wide:
            step = min(span, wide - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        value = mixed(least)
        whole = self.doc[: n - width + 1] == self.doc[width - 1 :]
        alone = np.flatnonzero(hot[value >> np.uint64(48)] & whole)
        value[alone] = mixed(rolled(self.h, alone, width))
        joins = whole[1:] & whole[:-1] & (value[1:] == value[:-1])
        self.first = np.flatnonzero(whole & ~np.append(False, joins))
        self.last = np.flatnonzero(whole & ~np.append(joins, False))
        self.value, self.width = value[self.first], width

    def strings(self) -> list[bytes]:
        return [self.joined[a:b] for a, b in zip(self.begin[self.first].tolist(), self.end[self.last + (self.width - 1)].tolist(), strict=True)] if len(self.first) else []

    def distinct_values(self) -> np.ndarray:
        """The buckets' hashes of the distinct super-k-mers."""
        if not len(self.first):
            return self.value
        key = self.value + mixed(rolled(self.h, self.first, self.width)) * ODD[-3] + (self.last - self.first).astype(np.uint64)
        return self.value[np.unique(key, return_index=True)[1]]


def _chunks(table: pa.Table | pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_id, texts) of rows with about `most` bytes of text."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"].cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
            part = batch.slice(at, until - at)
            yield part["doc_id"], bytes_of(part["text"])
            at = until


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(arrays: list[np.ndarray], text: bytes = b"") -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(b"".join([*(a.tobytes() for a in arrays), text]), asbytes=True)


def _unpack(body: bytes, size: int, n: int, kinds: list) -> tuple[list[np.ndarray], bytes]:
    raw, out, at = pa.decompress(body, size, "zstd", asbytes=True), [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:]


SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])
BACK = pa.schema([("g", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])


def _send(table: pa.Table, hot: np.ndarray, buckets: int, width: int, core: int) -> pa.Table:
    """Of one group of documents each distinct super-k-mer, packed by bucket with its smallest and largest doc_id."""
    number: dict[bytes, int] = {}
    at, ids, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for doc_id, texts in _chunks(table):
        chunk = Chunk(texts, hot, width, core)
        at.append(np.fromiter((number.setdefault(x, len(number)) for x in chunk.strings()), np.int64, len(chunk.first)))
        ids.append(_ids(doc_id)[chunk.doc[chunk.first]])
        values.append(chunk.value)
    at, ids, values = np.concatenate(at), np.concatenate(ids), np.concatenate(values)
    low, high, value = np.full(len(number), NO_ID), np.full(len(number), -NO_ID - 1), np.zeros(len(number), np.uint64)
    np.minimum.at(low, at, ids)
    np.maximum.at(high, at, ids)
    value[at] = values
    strings, bucket = list(number), (mixed(value) % np.uint64(buckets)).astype(np.int32)
    tag = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lengths = np.fromiter(map(len, strings), np.uint32, len(strings))
    order = np.lexsort((tag, bucket))
    rows, cuts = [], np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[a:b]
        text = b"".join([strings[i] for i in own.tolist()])
        rows.append({"bucket": int(bucket[own[0]]), "g": table["g"][0].as_py(), "n": b - a, "size": 24 * (b - a) + len(text), "body": _pack([tag[own], lengths[own], low[own], high[own] - low[own]], text)})
    return pa.Table.from_pylist(rows, SENT)


def _count_windows(ids: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places sorted so that equal windows stand together, and where each distinct window begins."""
    h = rolled(ids.astype(np.uint64), places, width)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    a, b = places[order[:-1][same]], places[order[1:][same]]
    if any((ids[a + j] != ids[b + j]).any() for j in range(width)):  # two windows with one hash
        order = np.lexsort([ids[places + j] for j in range(width - 1, -1, -1)])
        a, b = places[order[:-1]], places[order[1:]]
        same = np.all([ids[a + j] == ids[b + j] for j in range(width)], axis=0)
    return order, np.flatnonzero(np.append(True, ~same))


def _answer(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket: for each group and string with a window that a smaller document has, the smallest doc_id by window."""
    number: dict[bytes, int] = {}
    tags, of, group, lows, highs = [], [], [], [], []
    for batch in batches:
        for g, n, size, body in zip(batch["g"].to_pylist(), batch["n"].to_pylist(), batch["size"].to_pylist(), batch["body"], strict=True):
            (tag, lengths, low, span), text = _unpack(body.as_py(), size, n, [np.uint32, np.uint32, np.int64, np.int64])
            ends = np.cumsum(lengths, dtype=np.int64)
            of.append(np.fromiter((number.setdefault(text[b - m : b], len(number)) for b, m in zip(ends.tolist(), lengths.tolist(), strict=True)), np.int32, n))
            tags.append(tag)
            group.append(np.full(n, g, np.int32))
            lows.append(low)
            highs.append(low + span)
    if not number:
        return
    tags, of, group, lows, highs = map(np.concatenate, (tags, of, group, lows, highs))
    low, high, tag = np.full(len(number), NO_ID), np.full(len(number), -NO_ID - 1), np.zeros(len(number), np.uint32)
    np.minimum.at(low, of, lows)
    np.maximum.at(high, of, highs)
    tag[of] = tags
    by_tag = np.argsort(tag, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(tag[by_tag]) != 0))
    several = np.minimum.reduceat(low[by_tag], cuts) < np.maximum.reduceat(high[by_tag], cuts)
    kept = np.sort(by_tag[np.repeat(several, np.diff(np.append(cuts, len(by_tag))))])
    if not len(kept):
        return
    strings = list(number)
    strings = [strings[i] for i in kept.tolist()]
    joined = b" ".join(strings)
    words = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin = np.cumsum([0] + [len(s) + 1 for s in strings])[:-1]
    owner = np.repeat(np.arange(len(kept)), np.diff(np.append(np.searchsorted(spaces, begin), len(ids))))
    places = np.flatnonzero(owner[: len(ids) - width + 1] == owner[width - 1 :])
    order, starts = _count_windows(ids, places, width)
    least = np.empty(len(places), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[kept][owner[places]][order], starts), np.diff(np.append(starts, len(order))))
    first = np.searchsorted(owner[places], np.arange(len(kept)))
    windows = np.diff(np.append(first, len(places)))
    lowest = np.full(len(number), NO_ID)
    lowest[kept] = np.minimum.reduceat(least, first)
    rank = np.full(len(number), -1)
    rank[kept] = np.arange(len(kept))
    asked = np.flatnonzero(lowest[of] < highs)
    asked = asked[np.argsort(group[asked], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(group[asked], prepend=-1)), len(asked))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = rank[of[asked[a:b]]]
        keys = b"".join([xxhash.xxh3_128_digest(strings[i]) for i in own.tolist()])
        answers = least[_spread(first[own], windows[own])]
        body = _pack([windows[own].astype(np.uint32), np.frombuffer(keys, np.uint8)], answers.tobytes())
        yield pa.RecordBatch.from_pylist([{"g": int(group[asked[a]]), "n": b - a, "size": 20 * (b - a) + 8 * len(answers), "body": body}], BACK)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] numbers, then those from first[1] on, and so on."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))


def _remove(docs: pa.Table, answers: pa.Table, hot: np.ndarray, width: int, core: int) -> pa.Table:
    """What is left of each document of one group."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    known: dict[bytes, tuple[int, int]] = {}
    least, total = [np.zeros(0, np.int64)], 0
    for n, size, body in zip(answers["n"].to_pylist(), answers["size"].to_pylist(), answers["body"].to_pylist(), strict=True):
        (windows, keys), rest = _unpack(body, size, n, [np.uint32, "V16"])
        least.append(np.frombuffer(rest, np.int64))
        starts = total + np.cumsum(windows, dtype=np.int64) - windows
        known |= {k: (s, m) for k, s, m in zip(keys.tolist(), starts.tolist(), windows.tolist(), strict=True)}
        total += len(least[-1])
    least, out = np.concatenate(least), []
    for doc_id, texts in _chunks(docs):
        chunk = Chunk(texts, hot, width, core)
        n = len(chunk.words)
        gone = np.zeros(n, bool)
        if known and len(chunk.first):
            found = [(k, *x) for k, s in enumerate(chunk.strings()) if (x := known.get(xxhash.xxh3_128_digest(s)))]
            if found:
                of, start, windows = np.array(found).T
                first = chunk.first[of]
                earlier = least[_spread(start, windows)] < np.repeat(_ids(doc_id)[chunk.doc[first]], windows)
                at = _spread(first, windows)[earlier]
                gone = np.cumsum(np.bincount(at, minlength=n + 1)[:n] - np.bincount(at + width, minlength=n + 1)[:n]) > 0
        removed = np.bincount(chunk.doc[gone], minlength=len(texts))
        texts_left, w = [], 0
        for k, (c, r) in enumerate(zip(chunk.counts.tolist(), removed.tolist(), strict=True)):
            texts_left.append(b" ".join(compress(chunk.words[w : w + c], (~gone[w : w + c]).tolist())) if r else b" ".join(chunk.words[w : w + c]))
            w += c
        out.append(pa.RecordBatch.from_arrays([doc_id, pa.array(chunk.counts), pa.array(removed.astype(np.int64)), pa.array(texts_left, pa.binary()).cast(pa.string())], schema=kind))
    return pa.Table.from_batches(out, kind)


def _binned(batches: Iterator[pa.RecordBatch], width: int, core: int) -> Iterator[pa.RecordBatch]:
    """(bin, n): the strings of these documents by bin; (-1, bytes of text)."""
    counts, none, size = np.zeros(BINS, np.int64), np.zeros(BINS, bool), 0
    for batch in batches:
        for _, texts in _chunks(batch):
            counts += np.bincount((Chunk(texts, none, width, core).distinct_values() >> np.uint64(48)).astype(np.int64), minlength=BINS)
            size += sum(map(len, texts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], size))], names=["bin", "n"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, core: int = CORE, hot_times: float = HOT_TIMES, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): of each text the words that no window of a smaller document covers, joined by
    one space. hot_times and hot_least say which bins' windows travel one by one; they change no result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bins = {r["bin"]: r["n"] for r in docs.mapInArrow(lambda x: _binned(x, width, core), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    size, hot = bins.pop(-1, 0), np.zeros(BINS, bool)
    total = sum(bins.values())
    hot[[b for b, n in bins.items() if n > hot_times * total / BINS + hot_least]] = True
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = max(parts, -(-size // GROUP_BYTES)), max(2 * parts, -(-total // BUCKET_STRINGS))
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(parts, "g")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answer(batches, width)

    sent = dealt.groupBy("g").applyInArrow(lambda t: _send(t, hot, buckets, width, core), "bucket int, g int, n int, size long, body binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "g int, n int, size long, body binary")
    left = dealt.groupBy("g").cogroup(answers.groupBy("g"))
    return left.applyInArrow(lambda d, a: _remove(d, a, hot, width, core), "doc_id long, n_words long, n_removed long, kept string")
