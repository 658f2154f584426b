"""Merkle manifests of a data set by time-forward processing.

Nodes are labelled (tree, level, place), so that every child's label comes before its parent's. Digests travel forward in
time: a node takes its children's digests from a priority queue ordered by label, and puts its own digest there for its
parent. The reversed sweep goes through the same labels from the last to the first: each node takes the proof suffix that
its parent left for it, and leaves its children theirs, each with its siblings put before.

The queue is external: between tasks it is Spark's sorted exchange. Nodes are dealt by label to blocks of fan^levels
neighbours; a task sweeps a block's levels with a heap of its own, which never holds more than the block, and passes one
digest on as a leaf of the next round. So a source of any size is many tasks, and n documents take some log(n) / levels
rounds. Places of leaves come from ranges of the whole order (ranks.py), without a window over a source.

Defined results: a null source or any other null field is `-`; sources order by their bytes, null first; leaves order by
doc_id, null first, then by digest; repeated rows are leaves of their own; a null doc_id is never tampered with; texts
are hashed whole; only the named columns are read, whatever others there are; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, settle
from .ranks import ranked

FAN, LEVELS = 3, 6
KINDS = {"tree": pa.int64(), "place": pa.int64(), "digest": pa.string(), "doc_id": pa.int64(), "tampered": pa.string(), "proof": pa.list_(pa.string())}
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def height(n: int, fan: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def sweep(digests: list[str], fan: int, levels: int) -> list[list[str]]:
    """The digests of every level of a block, the leaves first, by label through a priority queue of messages."""
    queue = [((0, place), 0, d) for place, d in enumerate(digests)]  # (label of the receiver, order among its children, digest)
    made: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        label = queue[0][0]
        got = []
        while queue and queue[0][0] == label:
            got.append(heapq.heappop(queue)[2])
        level, place = label
        own = digest_of("".join(got)) if level else got[0]
        made[level].append(own)
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // fan), place % fan, own))
    return made


def suffixes(made: list[list[str]], fan: int, above: list[str]) -> list[list[str]]:
    """For each leaf of a block its siblings on the way up, as `left digests|right digests` by level, and then `above`:
    the labels of sweep() from the last to the first, each node leaving its children their suffixes in the queue."""
    top = len(made) - 1
    queue: list[tuple[tuple[int, int], list[str]]] = [((-top, -place), above) for place in range(len(made[top]))]
    heapq.heapify(queue)
    out: list[list[str]] = [[]] * len(made[0])
    while queue:
        (level, place), own = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = own
            continue
        run = made[level - 1][place * fan : (place + 1) * fan]
        for k in range(len(run)):
            heapq.heappush(queue, ((1 - level, -(place * fan + k)), ["".join(run[:k]) + "|" + "".join(run[k + 1 :]), *own]))
    return out


def fold(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof:
        left, _, right = step.partition("|")
        leaf = digest_of(left + leaf + right)
    return leaf


def _levels(n: int, fan: int, levels: int) -> int:
    """Levels that a round climbs in a tree of n leaves."""
    return levels if n > fan**levels else height(n, fan)


def climb(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, place, digest, n: nodes of the tree) -> the rounds, each with its block, and the roots (tree, digest)."""
    size, rounds = fan**levels, []
    while True:
        blocks = nodes.withColumn("block", F.expr(f"place div {size}L"))
        rounds.append(blocks)

        def up(key: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["place"].to_pylist(), table["digest"].to_pylist(), strict=True))
            n = table["n"][0].as_py()
            top = sweep([d for _, d in rows], fan, _levels(n, fan, levels))[-1]
            return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "digest": top, "n": [-(-n // size)]})

        nodes = settle(blocks.groupBy("tree", "block").applyInArrow(up, "tree long, place long, digest string, n long"), "merkle-round")
        if nodes.where("n > 1").isEmpty():
            return rounds, nodes.select("tree", "digest")


def _hand_down(blocks: DataFrame, suffix: DataFrame, extra: str, fan: int, levels: int) -> DataFrame:
    """The nodes of one round with their proofs, from the suffix of each block's root."""
    schema = "tree long, place long, digest string" + (f", {extra}" if extra else "") + ", proof array<string>"
    names = [x.split()[0] for x in schema.split(", ")]

    def down(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({x: pa.array([], KINDS[x]) for x in names})
        table = table.sort_by("place")
        n = table["n"][0].as_py()
        proofs = suffixes(sweep(table["digest"].to_pylist(), fan, _levels(n, fan, levels)), fan, above["proof"][0].as_py())
        return table.select(names[:-1]).append_column("proof", pa.array(proofs, KINDS["proof"]))

    return blocks.groupBy("tree", "block").cogroup(suffix.groupBy("tree", "block")).applyInArrow(down, schema)


def descend(rounds: list[DataFrame], suffix: DataFrame, extra: str = "", fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The first round's nodes (tree, place, digest and the columns named in extra) with `proof`: suffix has one
    (tree, proof) for each tree."""
    suffix = suffix.select("tree", F.lit(0).cast("long").alias("block"), "proof")
    for k, blocks in reversed(list(enumerate(rounds))):
        given = _hand_down(blocks, suffix, "" if k else extra, fan, levels)
        suffix = given if not k else settle(given.select("tree", F.col("place").alias("block"), "proof"), "merkle-suffixes")
    return suffix


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof array<string>, proof_sha256, folded_root, verified): every document's leaf, its
    siblings on the way to the root, and the root that its text, without line feeds where it is tampered with, leads to."""
    fields = [F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(fields).alias("digest"),
                         F.when(tampered, leaf_digest([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])).alias("tampered"))
    leaves = settle(leaves, "merkle-leaves")
    sources = settle(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "merkle-sources")
    sources = settle(ranked(sources, None, ["source"], "merkle-source-order", "tree"), "merkle-trees")
    n_sources = sources.count()
    # a source's number is joined by broadcast where there are few; else rows of a hot source are dealt by AQE
    numbered = settle(leaves.join(sources, leaves["source"].eqNullSafe(sources["source"])).select("tree", "n", "doc_id", "digest", "tampered"), "merkle-numbered")
    nodes = settle(ranked(numbered, "tree", ["doc_id", "digest", "tampered"], "merkle-order"), "merkle-nodes")
    rounds, subroots = climb(nodes, fan, levels)
    tops = settle(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(n_sources).cast("long").alias("n")), "merkle-tops")
    top_rounds, root = climb(tops, fan, levels)
    root = root.select("digest").first()
    root = root["digest"] if root else ""
    above = root_suffix(leaves.sparkSession)
    above = settle(descend(top_rounds, above, "", fan, levels).select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "proof"), "merkle-above")
    proved = descend(rounds, above.select("tree", "proof"), "doc_id long, tampered string", fan, levels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs = batch["proof"].to_pylist()
            given = zip(batch["digest"].to_pylist(), batch["tampered"].to_pylist(), proofs, strict=True)
            folded = [fold(t or d, p) for d, t, p in given]
            shas = [digest_of("".join(p).replace("|", "")) for p in proofs]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["doc_id"], batch["digest"], batch["proof"], pa.array(shas, pa.string()), pa.array(folded, pa.string())],
                                             names=["tree", "doc_id", "leaf", "proof", "proof_sha256", "folded_root"])

    judged = proved.mapInArrow(judge, "tree long, doc_id long, leaf string, proof array<string>, proof_sha256 string, folded_root string")
    out = meet(judged, above.select("tree", "subroot"), "tree", F.col("doc_id"))
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def root_suffix(spark) -> DataFrame:
    """Nothing stands above the root of all."""
    return spark.range(1).select(F.col("id").alias("tree"), F.array().cast("array<string>").alias("proof"))
