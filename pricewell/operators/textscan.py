"""Text-quality scans, item extraction from JSON and HTML, decoding with fallbacks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: UTF-8 text read as GB18030 tends to these characters (fixed values).
GARBLED = ("锟斤拷", "鈥", "銆", "鐨", "涓€", "Ã", "â€")


def scan_lines(docs: DataFrame, garbled: tuple[str, ...] = GARBLED) -> DataFrame:
    """(doc_id, line_no, problem): replacement characters, runs of question marks beside CJK, garbled tokens."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    tokens = F.lit(False)
    for g in garbled:
        tokens = tokens | F.col("line").contains(g)
    problem = F.when(F.col("line").contains("�"), "replacement_char").when(F.col("line").rlike(r"[一-鿿]\?{2,}|\?{2,}[一-鿿]|\?{4,}"), "question_burst").when(tokens, "garbled")
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), problem.alias("problem"), F.length("line").alias("line_chars")).where("problem is not null")


def _texts(f: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """A column function that maps f over Arrow batches of texts; texts of ASCII alone are themselves and stay in the JVM."""

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())

    def apply(column: Column | str) -> Column:
        text = F.col(column) if isinstance(column, str) else column
        return F.when(F.length(text) == F.octet_length(text), text).otherwise(run(F.when(F.length(text) != F.octet_length(text), text)))

    return apply


def repair_lines(lines: DataFrame) -> DataFrame:
    """The column `line` read back as UTF-8 where it was decoded as GB18030 and that gives good text, else as it was."""

    def mend(text: str) -> str:
        try:
            return text.encode("gb18030").decode("utf-8")
        except UnicodeError:
            return text

    return lines.withColumn("repaired", _texts(mend)("line"))


def damaged_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): every line of the texts, with its UTF-8 bytes decoded as GB18030 where that can be undone."""

    def damage(text: str) -> str:
        try:
            bad = text.encode("utf-8").decode("gb18030")
            return bad if bad.encode("gb18030") == text.encode("utf-8") else text
        except UnicodeError:
            return text

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), _texts(damage)("line").alias("line"))


def decode_content(files: DataFrame) -> DataFrame:
    """Text of binary files: UTF-8 with or without mark, else GB18030."""

    def one(content: bytes) -> str:
        for kind in ("utf-8-sig", "gb18030"):
            try:
                return content.decode(kind)
            except UnicodeError:
                pass
        return content.decode("utf-8", "replace")

    @arrow_udf("string")
    def text_of(contents: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in contents.to_pylist()], pa.string())

    good = F.is_valid_utf8(F.col("content").cast("string")) & ~F.startswith(F.hex("content"), F.lit("EFBBBF"))
    return files.withColumn("text", F.when(good, F.col("content").cast("string")).otherwise(text_of(F.when(~good, F.col("content")))))


def items_from_html(pages: DataFrame, pattern: str, placeholders: tuple[str, ...] = ("", "0", "-1")) -> DataFrame:
    """Distinct (ID, title) pairs that the pattern's two groups find in the column html."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("ID"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("title"))
    rows = pages.select(F.explode(found).alias("x")).select(F.trim(F.col("x")["ID"]).alias("ID"), F.trim(F.col("x")["title"]).alias("title"))
    return rows.where(~F.col("ID").isin(*placeholders) & (F.col("title") != "")).distinct()


ID_KEYS, TITLE_KEYS = ("ID", "Id", "id", "value"), ("title", "Title", "name", "Name", "text")


def items_from_json(responses: DataFrame, column: str = "body") -> DataFrame:
    """Distinct (ID, title) pairs of objects at any depth of the JSON texts; malformed texts, and those nested some thousand
    levels deep, give none."""

    def walk(top) -> Iterator[tuple[str, str]]:
        todo = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                i, t = (next((x[k] for k in keys if x.get(k) not in (None, "")), None) for keys in (ID_KEYS, TITLE_KEYS))
                if i is not None and isinstance(t, str):
                    yield str(i), t.strip()
                todo += x.values()
            elif isinstance(x, list):
                todo += x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch[column].to_pylist():
                try:
                    rows += [{"ID": i, "title": t} for i, t in walk(json.loads(text or "null"))]
                except (ValueError, RecursionError):  # malformed, or nested beyond what the parser takes
                    pass
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("ID", pa.string()), ("title", pa.string())]))

    return responses.select(column).mapInArrow(run, "ID string, title string").distinct()


def union_items(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.distinct()


def flatten_response(responses: DataFrame) -> DataFrame:
    """Rows of nested quote responses (A: groups with data), with the order of groups and of rows in them."""
    groups = responses.select("task_key", F.posexplode_outer("A").alias("group_order_index", "g"))
    rows = groups.select("task_key", "group_order_index", F.col("g.title").alias("group_title"), F.posexplode("g.data").alias("group_row_index", "r"))
    return rows.select("task_key", "group_order_index", "group_title", "group_row_index", "r.*")


def intent(text: Column, ordered: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first intent one of whose words is in a message; a digit 1-9 alone is a choice."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit("query")
    for name, words in reversed(ordered):
        hit = F.lit(False)
        for w in words:
            hit = hit | plain.contains(w)
        out = F.when(hit, name).otherwise(out)
    return F.when(plain == "", "empty").when(plain.rlike("^[1-9]$"), "choice").otherwise(out)
