"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into `blocks` blocks. Two that differ in at most `distance` bits agree in at least
blocks - distance whole blocks, so they share the key made of some choice of that many blocks. Rows meet by key, and
pairs are verified by Hamming distance. Nothing is dropped: a key held by more than TILE fingerprints is dealt in tiles
of TILE by TILE, each a task group of its own, and every tile is compared whole. A tile returns links that span its
connected fingerprints instead of all its pairs; components then follow from links by star contraction. The number of
blocks follows the number of distinct fingerprints (blocks_for), so that keys stay short lists at any size.

What one key can hold a third of is split: keys in tiles; fingerprints with very many rows are joined by broadcast
(common.meet_counted); the ends of a large component meet its root by broadcast or salted.

Defined results: a null, empty or blank text has fingerprint zero, and links like any other; a text is read whole,
however long; equal rows share a component; a null doc_id keeps a row with its fingerprint, and its component is the
smallest non-null doc_id reachable (null if there is none); an empty table gives no rows; other columns are not read by
near_duplicates() and stay, whatever their names and types, in keep_first()."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _quoted, bounded, bytes_of, fresh, meet, meet_counted, settle, slices, whole_row

TILE = 4096
#: Fingerprints that a key may have on average.
PER_KEY = 256


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text: lower-cased A-Z, words between ASCII white space, shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    hashed = xxhash.xxh64_intdigest
    pairs = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    h = np.fromiter((hashed(plain[a:b], seed) for a, b in pairs), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp): text_key is a hash of the text, fp is the fingerprint as a signed long."""
    kind = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(x, shingle, seed) for x in bytes_of(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(fps)], schema=kind)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys are wide enough for n fingerprints to have some PER_KEY to a key at most."""
    wide = (b for b in range(distance + 2, 2 * distance) if n <= PER_KEY << 64 * (b - distance) // b)
    return next(wide, max(2 * distance, distance + 2))


def block_masks(blocks: int, distance: int) -> list[int]:
    """One 64-bit mask for each choice of blocks - distance blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _roots(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of a tile, the index of the first one of its connected set: search by frontier, O(n) memory."""
    root, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        root[first], todo = first, [first]
        while todo and len(left):
            near = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= distance
            if near.any():
                root[left[near]] = first
                todo.extend(left[near].tolist())
                left = left[~near]
    return root


def _small_pairs(keys: np.ndarray, fps: np.ndarray, most: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within runs of equal keys of at most `most` rows: each row against the k-th after it."""
    left, right = [], []
    for k in range(1, most):
        i = np.flatnonzero(keys[k:] == keys[:-k])
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= distance]
        left.append(i)
        right.append(i + k)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: (tile as one number in `run`, fp) in, spanning links out. Runs may go over batch ends."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def work(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat(sizes <= 16, sizes)
        i, j = _small_pairs(keys[small], fps[small], 16, distance)
        a, b = [fps[small][i]], [fps[small][j]]
        for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
            own = fps[s : s + n]
            root = _roots(own, distance)
            moved = np.flatnonzero(root != np.arange(n))
            a.append(own[root[moved]])
            b.append(own[moved])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], schema=kind)

    for batch in batches:
        keys = np.concatenate([rest[0], batch["run"].to_numpy(zero_copy_only=False)])
        fps = np.concatenate([rest[1], batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(keys != keys[-1], False)) if len(keys) and keys[0] == keys[-1] else (int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) else 0)
        yield from work(keys[:cut], fps[:cut])
        rest = keys[cut:], fps[cut:]
    yield from work(*rest)


def near_links(prints: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints of the column fp, at most `distance` bits apart, whose connected
    components are those of all such pairs. prints is counted to choose the blocks where they are not given."""
    blocks = blocks_for(prints.count(), distance) if blocks is None else blocks
    masks = F.array(*[F.struct(F.lit(i).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(block_masks(blocks, distance))])
    keyed = prints.select("fp").distinct().select("fp", F.explode(masks).alias("k")).select("fp", F.xxhash64("k.n", "k.part").alias("key"))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    parts = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
    dealt = keyed.join(full, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = dealt.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    run = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    tiles = tiles.select(run.alias("run"), "fp")
    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_tiles = tiles.repartition(count, "run").sortWithinPartitions("run", "fp")
    return sorted_tiles.mapInArrow(lambda batches: _links(batches, distance), "a long, b long").distinct()


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): for each end of a link the smallest node it is connected to, by alternating large and small stars."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(edges)
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = settle(meet(both.where("v > u"), low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = meet(large, low, "u", F.col("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        edges, before, seen = new, seen, mark(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(prints: DataFrame, distance: int, blocks: int | None) -> DataFrame:
    """(fp, n, least): of every fingerprint how many rows have it, and the least (no doc_id, doc_id, text_key) of its component."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    own = settle(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), least.alias("first")), "distinct-fingerprints")
    roots = connected(near_links(own, distance, blocks))
    roots = settle(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    best = settle(roots.join(own, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("least")), "least-of-components")
    linked = settle(meet(roots, best, "root", F.col("node")).select(F.col("node").alias("fp"), "least"), "linked")
    return settle(own.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("least")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = settle(fingerprints(docs, shingle, seed), "fingerprints").select("doc_id", "text_key", "fp")
    named = components(prints, distance, blocks).select("fp", "n", F.col("least.doc_id").alias("component_id"))
    return meet_counted(prints, named, ["fp"]).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id (rows without one come
    last), of rows with this doc_id that with the smallest text hash, of equal ones the first by all their columns."""
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    first = components(prints, distance, blocks).select("least").distinct()
    own_id, own_key, first_id, first_key, row = fresh(docs, "own_id", "own_key", "first_id", "first_key", "row")
    named = lambda df, i, k: df.select(F.col(i).alias(first_id), F.col(k).alias(first_key))
    same = F.col(own_id).eqNullSafe(F.col(first_id)) & (F.col(own_key) == F.col(first_key))
    keyed = docs.withColumns({own_id: docs["doc_id"].cast("long"), own_key: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))})
    kept = keyed.join(named(first, "least.doc_id", "least.text_key"), same, "left_semi")
    many = settle(prints.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-rows")
    if many.isEmpty():
        return kept.drop(own_id, own_key)
    many = bounded(named(many, "doc_id", "text_key"))
    columns = [F.col(_quoted(c)) for c in docs.columns]
    one = kept.join(many, same, "left_semi").groupBy(own_id, own_key).agg(F.min_by(F.struct(*columns), whole_row(docs)).alias(row)).select(f"{row}.*")
    return kept.join(many, same, "left_anti").select(*columns).unionByName(one)
