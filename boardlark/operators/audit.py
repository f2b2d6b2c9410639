"""Markdown quality audit: rows of (id, severity, code, line, excerpt), the first of each code in a record.

A record is judged by itself: fences, tables and blank lines carry state from line to line, so one Arrow pass reads each text once, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boardlark.operators.markdown import cells, is_row, is_rule

RANK = {"P0": 0, "P1": 1, "P2": 2}
#: Where Python's lines end.
BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# --- Fixed values: patterns of record-wide codes, (severity, code, pattern). ---
RECORD = (
    ("P0", "dangerous_raw_html", r"(?i)</?(?:script|style|iframe|object|embed|form|input|textarea|button)\b"),
    ("P0", "data_uri", r"(?i)\bdata:(?:image|application)/"),
    ("P0", "unsafe_link", r"(?i)(?<!\\)!?(?<!\\)\[[^\]\n]*\]\(\s*(?:javascript|data):"),
    ("P1", "raw_html", r"(?i)</?(?:p|div|section|article|table|thead|tbody|tr|td|th|ul|ol|li|h[1-6]|img|a|br|span|strong|em|b|i)\b"),
    ("P1", "empty_link_destination", r"(?<!\\)!?(?<!\\)\[[^\]\n]*\]\(\s*\)"),
)
# --- Fixed values: patterns of line-wise codes, on lines outside fences and without inline code. ---
LINE = (
    ("P1", "unclosed_link_destination", r"(?<!\\)!?(?<!\\)\[[^\]\n]*\]\([^)\n]*\z"),
    ("P2", "link_destination_space", r"""(?<!\\)!?(?<!\\)\[[^\]\n]*\]\((?!<)[^\s)\n]+[ \t]+(?!["'][^)\n]*\))[^)\n]*\)"""),
    ("P2", "html_entity", r"(?i)&(?:nbsp|amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-f]+);"),
    ("P2", "inline_bullet", r"(?<=\S)[ \t]+(?=[•▪○]\s*\S)"),
    ("P2", "inline_dash_label", r"(?<=[^\s\-\d])(?=-[ \t]+[가-힣A-Za-z][가-힣A-Za-z\d]{0,14}[ \t:])"),
    ("P2", "inline_ordered_marker", r"(?<=[가-힣\)\]\d])(?=\d+\)\s+\S)|(?<=[\.\)\]\d])(?=[가-사]\.\s+[가-힣A-Za-z])"),
)
OPEN_TEXT = r"(?<!\\)!?(?<!\\)\[[^\]\n]*\z"


def table_scan(content: str) -> dict[str, tuple[str, int, str]]:
    """Table codes of one text: code to (severity, line, line's text).  A lone separator row counts as a row without separator."""
    found: dict[str, tuple[str, int, str]] = {}
    rows = content.splitlines()
    k = 0
    while k < len(rows):
        if not is_row(rows[k]):
            k += 1
            continue
        if k + 1 == len(rows) or not is_rule(rows[k + 1]):
            found.setdefault("table_row_without_separator", ("P2", k + 1, rows[k]))
            k += 1
            continue
        head = cells(rows[k])
        if not any(head):
            found.setdefault("empty_table_header", ("P1", k + 1, rows[k]))
        end = k + 1
        while end < len(rows) and is_row(rows[end]):
            if len(cells(rows[end])) != len(head):
                found.setdefault("table_column_mismatch", ("P1", end + 1, rows[end]))
            end += 1
        k = end
    return found


_BREAK = re.compile(BREAKS)
_COMPILED = {code: re.compile(p.replace(r"\z", r"\Z")) for _, code, p in (*RECORD, *LINE)}
_OPEN_TEXT = re.compile(OPEN_TEXT.replace(r"\z", r"\Z"))
_CODE = re.compile(r"`[^`\n]*`")
_ESCAPED = re.compile(r"\\.|[^`]", re.S)
_INDENT = re.compile(r"[ \t]{4,}[^\s]")
SEVERITY = {code: s for s, code, _ in (*RECORD, *LINE)} | {
    "html_comment": "P1", "repeated_blank_lines": "P2", "unclosed_fence": "P0", "unbalanced_strong": "P1", "unbalanced_inline_code": "P1", "unclosed_link_text": "P1",
    "accidental_code_indent": "P2", "empty_content": "P0", "table_row_without_separator": "P2", "empty_table_header": "P1", "table_column_mismatch": "P1",
}


def _short(text: str, most: int = 180) -> str:
    v = " ".join(text.split())
    return v if len(v) <= most else v[: most - 1] + "…"


def issues_of(content: str | None) -> list[tuple[str, str, int | None, str]]:
    """The issues of one record as (severity, code, line, excerpt), the first line of each code; line None where no line shows it by itself."""
    content = content or ""
    if not content.strip():
        return [("P0", "empty_content", None, "")]
    rows = _BREAK.split(content)
    found: dict[str, tuple[int | None, str]] = {}
    marks = [x.strip().startswith(("```", "~~~")) for x in rows]

    def first(code: str, shows) -> None:
        """A record-wide code, with the first line that shows it."""
        k = next((k for k, x in enumerate(rows) if shows(k, x)), None)
        found[code] = (None, "") if k is None else (k + 1, rows[k])

    for _, code, _ in RECORD:
        if _COMPILED[code].search(content):
            first(code, lambda _, x, p=_COMPILED[code]: p.search(x))
    if "<!--" in content or "-->" in content:
        first("html_comment", lambda _, x: "<!--" in x)
    if "\n\n\n" in content:
        first("repeated_blank_lines", lambda k, _: k >= 2 and not (rows[k].strip() or rows[k - 1].strip() or rows[k - 2].strip()))
    if any(marks) and any(sum(x.strip().startswith(m) for x in rows) % 2 for m in ("```", "~~~")):
        first("unclosed_fence", lambda k, _: marks[k])
    ticks = "`" in content
    bare = [_CODE.sub("", x) for x in rows] if ticks else rows
    if sum(x.count("**") for x in bare) % 2:
        first("unbalanced_strong", lambda _, x: "**" in x)
    # Without inline code a line's text is its bare text, so what the whole record lacks no line has; anchored patterns need a bracket.
    wanted = [(code, _COMPILED[code]) for _, code, p in LINE if ticks or ("[" in content if p.endswith(r"\z") else _COMPILED[code].search(content))]
    fenced = False
    for k, (x, b, mark) in enumerate(zip(rows, bare, marks)):
        inside, fenced = fenced or mark, fenced != mark
        if inside:
            continue
        hit = [code for code, p in wanted if code not in found and p.search(b)]
        if ticks and "`" in b and len(_ESCAPED.sub("", b)) % 2:
            hit.append("unbalanced_inline_code")
        if "[" in b and "[^" not in b and _OPEN_TEXT.search(b):
            hit.append("unclosed_link_text")
        if _INDENT.match(x) and not (rows[k - 1].strip() if k else ""):
            hit.append("accidental_code_indent")
        for code in hit:
            found.setdefault(code, (k + 1, x))
    tables = table_scan(content) if "|" in content else {}
    out = [(SEVERITY[code], code, line, _short(text)) for code, (line, text) in found.items()]
    return out + [(s, code, line, _short(text)) for code, (s, line, text) in tables.items()]


def audit(records: DataFrame) -> DataFrame:
    """All issues of records (id, content): id, severity, code, line, excerpt.  One narrow pass; each row is judged by itself, whatever its id.  An empty
    record has that one issue."""
    schema = StructType.fromDDL("id string, severity string, code string, line int, excerpt string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("content")
            for at in range(0, len(ids), 256):
                rows = [(i, *issue) for i, c in zip(ids[at : at + 256], texts.slice(at, 256).to_pylist()) for issue in issues_of(c)]
                columns = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], schema.names)

    return records.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, schema)


def _rank(column: str = "severity") -> Column:
    return F.col(column).substr(2, 1).cast("int")


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count("*").alias("n"))


def examples(issues: DataFrame, most: int = 3) -> DataFrame:
    """The first issues of each code, by record id."""
    by = Window.partitionBy("severity", "code").orderBy("id", "line")
    return issues.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)


def fails(issues: DataFrame, on: str = "P1") -> DataFrame:
    """One row: total, failing, and whether the gate is shut."""
    bad = F.count_if(_rank() <= RANK[on])
    return issues.agg(F.count("*").alias("total"), bad.alias("failing"), (bad > 0).alias("failed"))
