"""The corpus pipeline against a brute-force run of its five stages in plain Python."""

from collections import defaultdict

import public_tokenizers as P
import tiktoken
from test_ops import CLASH, brute_components, brute_counts, brute_hits, brute_quality, brute_secrets, brute_simhash, clashing

import corpus_pipeline
from pricewell.llm import byte_bpe, quality_rules


def redacted(text):
    out, at = [], 0
    for kind, a, b in brute_secrets(text):
        if b > at:
            out += [text[at:a], f"<{kind}>"] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def brute_pipeline(docs, benchmark):
    """docs: (doc_id, text, lang, source) with distinct ids -> {doc_id: token ids}."""
    kept = brute_quality([(lang, source, brute_counts(text or "")) for _, text, lang, source in docs], 50, quality_rules.CUTOFF)
    docs = [(i, text or "") for (i, text, _, _), k in zip(docs, kept) if k]
    names = brute_components([(i, brute_simhash(t)) for i, t in docs])
    groups = defaultdict(list)
    for (i, t), c in zip(docs, names):
        groups[c].append((i, t))
    docs = [min(g) for g in groups.values()]
    dirty = {k[0] for k in brute_hits(docs, benchmark) if k[4]}
    docs = [(i, redacted(t)) for i, t in docs if i not in dirty]
    tokens = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    return {i: reference.encode_ordinary(t) for i, t in docs}


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_pipeline(docs, items)
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len({r["doc_id"] for r in got}) and {r["doc_id"]: list(r["ids"]) for r in got} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got) and 0 < len(want) < len(docs)


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    """Every stage takes null, empty, repeated and nameless rows, clashing extra columns, and a table without rows."""
    spark.createDataFrame([(1, "two three four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = [(k, f"number {k} " + " ".join(f"word{k}x{j}" for j in range(40))) for k in range(10, 30)]
    df = clashing(spark, [*CLASH, *long, (40, "a token=abcdefgh b " + " ".join(f"tail{j}" for j in range(30)))])
    for rows in (df, df.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            if name == "byte_bpe":
                assert made.columns == ["doc_id", "n_tokens", "ids"] and made.count() == docs.count()
                break
            assert made.schema == df.schema, name
            docs = made
        assert docs.count() == (0 if rows is not df else 21) and all("token=abcdefgh" not in r["text"] for r in docs.collect())
