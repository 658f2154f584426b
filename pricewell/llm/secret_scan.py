"""Secret scans with one combined deterministic automaton for all rules.

The automaton's pass gives, for each rule, the places where matches end. For each run of such places the rule's
reversed automaton finds the leftmost start after the last match, and the rule's own automaton the longest end from
there: leftmost, longest, non-overlapping matches per rule. A match whose value is shorter than the rule's minimum is
consumed, then dropped. Spans are in code points, end exclusive.

Rules end in a repeated class, so that a match's end is the last of a run of accepting places.

Defined results: a null text is empty; an empty text has no spans; rows of equal doc_id are separate rows; null doc_ids
are kept; a text is scanned whole, however long; an empty table gives no rows; of other columns, scan() reads none and
redact() keeps all as they are, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, _parse, _reversed, compile_dfa, folded, longest, scan
from .common import bytes_of, slices


@dataclass(frozen=True)
class Rule:
    """least: the shortest match that counts; where assigns, the shortest value after the first : or =."""

    kind: str
    regex: str
    least: int
    assigns: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
#: The first three are the base rules, in the order that breaks ties of start.
RULES = (
    Rule("assign", f"({folded('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?{VALUE}+", 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{3,}", 24),
    Rule("forge", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", 39),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-+", 5),
)
BATCH_BYTES = 4 << 20


@lru_cache(4)
def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """The combined unanchored automaton, and for each rule the anchored one, forward and reversed."""
    trees = [_parse(r.regex) for r in rules]
    return compile_dfa(trees), [compile_dfa([t], False) for t in trees], [compile_dfa([_reversed(t)], False) for t in trees]


def spans_of(rules: tuple[Rule, ...], compiled: tuple[Dfa, list[Dfa], list[Dfa]], texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end), in code points and sorted."""
    combined, forward, backward = compiled
    joined = b"\n".join(texts)
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    places, bits = scan(combined, np.frombuffer(joined, np.uint8))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for r, rule in enumerate(rules):
        own = places[(bits >> r) & 1 == 1]
        ends = own[np.append(np.diff(own) > 1, True)[: len(own)]] + 1
        docs, last, before = np.searchsorted(begins, ends - 1, side="right") - 1, 0, -1
        for doc, end in zip(docs.tolist(), ends.tolist(), strict=True):
            floor = last = int(begins[doc]) if doc != before else last
            before = doc
            if end <= floor:
                continue
            start = longest(backward[r], joined, end, floor, -1)
            if start == end:
                continue
            last = end = longest(forward[r], joined, start, int(begins[doc + 1]) - 1, 1)
            match = joined[start:end]
            if rule.assigns:
                match = match[_value_at(match) :]
            if len(match) >= rule.least:
                out[doc].append((start - int(begins[doc]), r, end - int(begins[doc])))
    for doc, found in enumerate(out):
        if found:
            text = texts[doc]
            point = (lambda x: x) if text.isascii() else (lambda x, t=text: len(t[:x].decode("utf-8", "replace")))
            out[doc] = sorted((point(a), r, point(b)) for a, r, b in found)
    return out


def _value_at(match: bytes) -> int:
    """Where the value of an assignment begins: after the first : or =, blanks and a quote."""
    at = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1
    while match[at : at + 1] == b" ":
        at += 1
    return at + (match[at : at + 1] in (b'"', b"'"))


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about BATCH_BYTES of text."""
    for batch in slices(batches, 4096):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column].cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES)))
            part = batch.slice(at, until - at)
            yield part, bytes_of(part[column])
            at = until


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): all secrets of each text, by start, then rule order."""
    compiled = automata(rules)
    kind = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, "text"):
            spans = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in x] for x in spans_of(rules, compiled, texts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind.field("spans").type)], schema=kind)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, each secret's place taken by <kind>; n_chars, where there is one, follows the text."""
    compiled, names = automata(rules), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may hold dots, quotes and the like
    lower = [n.lower() for n in names]
    own = f"c{lower.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, own):
            new = []
            for text, null, found in zip(texts, batch[own].is_null().to_pylist(), spans_of(rules, compiled, texts), strict=True):
                whole, parts, at = text.decode(), [], 0
                for a, r, b in found:
                    if b > at:
                        parts += [whole[at : max(a, at)], f"<{rules[r].kind}>"] if a >= at else []
                        at = b
                new.append(None if null else "".join([*parts, whole[at:]]))
            arrays = [pa.array(new, pa.string()) if n == own else batch.column(i) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    out = plain.mapInArrow(run, plain.schema)
    if "n_chars" in lower:
        chars = f"c{lower.index('n_chars')}"
        out = out.withColumn(chars, F.when(F.col(own).isNull(), F.col(chars)).otherwise(F.length(own)).cast(plain.schema[chars].dataType))
    return out.toDF(*names)
