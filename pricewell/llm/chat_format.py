"""Chat formatting by a grammar round trip.

    conversation := turn*        turn := "### " label ": " body "</turn>\\n"

A body is first rendered as it is. The rendered text is then parsed back by the grammar's deterministic parser; turns
that do not come back as they were are rendered again with escapes (a backslash before every backslash and control
string), until the parsed turns equal the source. Plain texts stay untouched.

Defined results: a null text is empty; a null role is the empty role; equal turn numbers follow role and text; null
turn numbers come first; rows with a null conv_id form one conversation; repeated rows are turns of their own; an empty
table gives no rows; only conv_id, turn, role and text are read, whatever other columns there are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {v: k for k, v in LABELS.items()}
CONTROL = re.compile(r"\\|### |</turn>")
TOKEN = re.compile(r"\\(\\|### |</turn>)|### |</turn>")

SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>, n_escaped long"


def label_of(role: str) -> str:
    return LABELS.get(role) or "@" + quote(role, safe="")


def role_of(label: str) -> str:
    return ROLES.get(label) or unquote(label[1:])


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return TOKEN.sub(lambda m: m[1] or m[0], text)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The text, and each body's place in it in code points."""
    parts, spans, at = [], [], 0
    for (role, text), e in zip(turns, escaped, strict=True):
        head, body = f"{OPEN}{label_of(role)}{SEP}", escape(text) if e else text
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE + "\n"]
        at = spans[-1][1] + len(CLOSE) + 1
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, or None where it does not follow the grammar."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at) or (colon := text.find(SEP, at)) < 0:
            return None
        label, at = text[at + len(OPEN) : colon], colon + len(SEP)
        if label not in ROLES and not label.startswith("@"):
            return None
        body, begin = [], at
        for m in TOKEN.finditer(text, at):
            if m[1]:
                body += [text[begin : m.start()], m[1]]
                begin = m.end()
            elif m[0] == CLOSE:
                break
            else:
                return None
        else:
            return None
        body.append(text[begin : m.start()])
        at = m.end()
        if not text.startswith("\n", at):
            return None
        at += 1
        turns.append((role_of(label), "".join(body)))
    return turns


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[bool]]:
    """Renders, parses back, and escapes what does not come back, until the turns are identical."""
    escaped = [False] * len(turns)
    while True:
        text, spans = render(turns, escaped)
        if parse(text) == turns:
            return text, spans, escaped
        bad = [e or parse(render([turn], [False])[0]) != [turn] for turn, e in zip(turns, escaped, strict=True)]
        escaped = bad if bad != escaped else [True] * len(turns)


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its turns rendered as one text, and the spans (code points) that count for the loss."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_escaped", pa.int64())])
        for batch in slices(batches):
            out = []
            for conv, rows in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                turns = [(r["role"], r["text"]) for r in rows]
                text, spans, escaped = round_trip(turns)
                loss = [{"start": a, "end": b} for (role, _), (a, b) in zip(turns, spans, strict=True) if role == loss_role]
                out.append({"conv_id": conv, "n_turns": len(turns), "formatted": text, "loss_spans": loss, "n_escaped": sum(escaped)})
            yield pa.RecordBatch.from_pylist(out, kind)

    return grouped.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted texts: (conv_id, turns array<struct<role, text>>, loss_text, formatted_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string()), ("formatted_chars", pa.int64())])
        for batch in slices(batches):
            out = []
            for conv, text, spans in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                if (turns := parse(text)) is None:
                    raise ValueError(f"conversation {conv} does not follow the grammar")
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append({"conv_id": conv, "turns": [{"role": r, "text": t} for r, t in turns], "loss_text": loss, "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, kind)

    return formatted.mapInArrow(run, "conv_id long, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long")
