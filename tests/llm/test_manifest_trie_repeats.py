"""Prefix tries, Merkle manifests and repeated passages against brute force, and the cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import CLASH, clashing, odd

from pricewell.llm import merkle, prefix_trie, substring_dedup
from pricewell.llm.ranks import ranked

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- places ---------------------------------------------------------------------------------------------------


def test_places_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.choice([None, 1, 2, 3, 4, 5]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, x long, k long")
    got = ranked(df, "g", ["x", "k"], "test-places").collect()
    want = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            want[r[2]] = place
    assert {r["k"]: r["place"] for r in got} == want
    assert sorted(r["place"] for r in ranked(df, None, ["x"], "test-all-places").collect()) == list(range(500))
    same = spark.range(300).select(F.lit(7).cast("long").alias("g"), F.lit(1).alias("x"))
    assert sorted(r["place"] for r in ranked(same, "g", ["x"], "test-equal", keep=["g"]).collect()) == list(range(300))


# ---- prefix tries ---------------------------------------------------------------------------------------------


def brute_trie(rows):
    """rows (conv, turn, role, text) -> the contract's rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own_members in members.items():
        gain = (len(own_members) - 1) * (len(SPACE.findall(k[-1][1])) if k else 0)
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += gain
    ends = defaultdict(list)
    for c, turns in built.items():
        ends[tuple(turns)].append(c)
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items())


def trie_of(df, **how):
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(df, **how).collect())


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("length", "shard"), [(256, 400_000), (2, 5), (3, 1)])
def test_trie_against_brute_force(spark, length, shard):
    rng = random.Random(length)
    rows = []
    for c in [*range(60), -7, -20, 100, 107]:
        common = rng.choice([[("user", "hi there"), ("assistant", "yes  of course")], [("user", "hi there")], []])
        turns = common + [(rng.choice(["user", None, "assistant"]), rng.choice(["a", "b c", "", None, "d e f"])) for _ in range(rng.choice([0, 1, 1, 2, 3, 9]))]
        rows += [(c, rng.choice([k, None]) if rng.random() < 0.1 else k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(200 + k, j, "user", "the same") for k in range(30) for j in range(7)]  # copies, and a deep common way
    rows += [(240, j, "user", f"turn {j}") for j in range(12)] + [(None, 0, "user", "nobody"), (300, 1, "x", "tie"), (300, 1, "x", "tie"), (300, 1, "w", "tie")]
    df = spark.createDataFrame(rows, CONV).withColumn("keys", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("place", F.lit(3))
    assert trie_of(df, length=length, shard_turns=shard) == brute_trie(rows)


def test_trie_of_given_table_and_of_nothing(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_of(given) == brute_trie([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    assert trie_of(given.limit(0)) == Counter()
    one = spark.createDataFrame([(1, 0, "user", "alone"), (2, 0, "user", "alone")], CONV)  # conversation 1 gives its turn up (h = 3, no base)
    assert trie_of(one) == brute_trie([(1, 0, "user", "alone"), (2, 0, "user", "alone")])


def test_double_array_holds_what_it_was_given():
    rng = random.Random(5)
    sequences = sorted({tuple(rng.randrange(40 if k % 3 else 300) for _ in range(rng.randrange(7))) for k in range(900)})
    trie = prefix_trie.pack([list(s) for s in sequences])
    prefixes, states = {s[:d] for s in sequences for d in range(len(s) + 1)}, {(): 0}
    for p in sorted(prefixes, key=len):
        if p:
            states[p] = trie.child(states[p[:-1]], p[-1])
    assert min(states.values()) == 0 and len(set(states.values())) == len(prefixes)
    for p in list(prefixes)[:300]:
        for c in range(0, 300, 7):
            assert (trie.child(states[p], c) >= 0) == ((*p, c) in prefixes)


# ---- Merkle manifests -----------------------------------------------------------------------------------------


def brute_manifest(rows, fan=3):
    """rows (doc_id, source, lang, n_chars, text) -> the contract's rows."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def proof(levels, i):
        out = []
        for level in levels[:-1]:
            at = i // fan * fan
            out.append(("".join(level[at:i]), "".join(level[i + 1 : at + fan])))
            i //= fan
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = proof(trees[s], i) + proof(top, n)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            d = leaf((*r[:4], r[4].replace("\n", ""))) if bad else leaf(r)
            for a, b in steps:
                d = sha(a + d + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), d, d == top[-1][0]))
    return Counter(out)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROVED = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_against_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(k, rng.choice(["a", "a", "a", "b", None, "é", "Z", "z"]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "plain", "two\n\nlines"])) for k in range(90)]
    rows += [(None, "a", None, None, "x\n"), (None, "a", None, None, "x\n"), (3, "a", "en", 1, "again\n"), (3, "a", "en", 1, "again\n"), (7, "lone", None, None, "t\n" * 9)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("tree", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("digest", F.lit(None).cast("string")).withColumn("_range", F.lit(1))
    got = merkle.manifest(df, levels=levels)
    assert Counter(tuple(r) for r in got.select(PROVED).collect()) == brute_manifest(rows)
    assert all(r["verified"] == (merkle.fold(r["leaf"], r["proof"]) == r["folded_root"]) for r in got.collect())


def test_manifest_of_given_table_of_one_and_of_nothing(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (given, odd(spark), given.limit(1), given.limit(0)):
        want = brute_manifest([tuple(r) for r in df.select(FIELDS).collect()]) if df.count() else Counter()
        assert Counter(tuple(r) for r in merkle.manifest(df).select(PROVED).collect()) == want


# ---- repeated passages ----------------------------------------------------------------------------------------


def brute_repeats(rows, width=13):
    docs = [(i, SPACE.findall(t or "")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, w in docs:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, order(i)), order(i))
    out = []
    for i, w in docs:
        gone = {p for s in range(len(w) - width + 1) if least[tuple(w[s : s + width])] < order(i) for p in range(s, s + width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return Counter(out)


def repeats_of(df, **how):
    return Counter(tuple(r) for r in substring_dedup.remove_repeats(df, **how).collect())


def passages():
    """Shared passages at odd places, repetitions, edges of one word, a common phrase among other words, copies."""
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    shared = [" ".join(word() + str(k) for _ in range(n)) for k, n in enumerate((12, 13, 14, 40, 200))]
    rows = [(rng.randrange(60), rng.choice([" ", "\n", "\t "]).join(x for _ in range(rng.randrange(5)) for x in (rng.choice(shared), *(word() for _ in range(rng.randrange(20)))))) for _ in range(120)]
    rows += [(k, "same " * rng.randrange(10, 60)) for k in range(20)] + [(100 + k, f"{k} {k * 7} one two three four five six seven eight nine ten {k * k} {k + 9} x{k}") for k in range(80)]
    return rows + [(200 + k % 7, shared[4] + " and a tail") for k in range(30)] + [(None, shared[3]), (None, shared[3] + " new"), (300, "é\xa0ü " * 20), (301, "é\xa0ü " * 14)]


@pytest.mark.parametrize("how", [{}, {"hot_times": 0, "hot_least": 0}, {"core": 1}, {"core": 13}])
def test_repeats_against_brute_force(spark, how):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("x")).withColumn("a.b", F.lit(1))
    assert repeats_of(df, **how) == brute_repeats(rows)
    if not how:
        assert repeats_of(df, width=3, core=2) == brute_repeats(rows, 3)


def test_repeats_of_given_table_and_odd_rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (given, odd(spark), clashing(spark, CLASH), given.limit(0)):
        assert repeats_of(df) == brute_repeats([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "rolled", lambda h, at, n: np.zeros(len(at), np.uint64))
    ids = np.random.default_rng(2).integers(0, 2, 400)
    places = np.arange(400 - 12)
    order, starts = substring_dedup._count_windows(ids, places, 13)
    runs = np.split(order, starts[1:])
    windows = [{tuple(ids[p : p + 13]) for p in run} for run in runs]
    assert all(len(w) == 1 for w in windows) and len(set.union(*windows)) == len(runs)
