"""Several values packed in one field: a quote-aware tokenizer that emits values with their places.

One pass of a finite-state machine over the field tracks quoting, escapes and nesting depth and
notes every delimiter outside quotes. The field's one kind of delimiter is then the strongest kind
seen, and the pieces between its delimiters are cleaned of list marks, numbering and quotes.

Defined results: null and blank fields and empty lists hold no value; a field without a delimiter
holds one; empty pieces take no number; repeated values count each time; an unclosed quote or bracket
is ordinary text. Work is per row and needs no shuffle; a field is held by one task whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from casetrail.session import ship

PAIRS = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "«": "»", "`": "`"}
OPEN, CLOSE = {"[": "]", "{": "}", "(": ")"}, {"]", "}", ")"}
ARROWS = ("->", "→", "=>", "⇒", "➔", "➜", "⟶", "-->", "==>", "›", "»")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Kinds of delimiters, the strongest first. "number" stands for marks such as "2." and "(2)".
STRENGTH = ("line", "tab", "number", "bar", "semicolon", "arrow", "word", "more", "amp", "plus", "bullet", "slash", "comma")
WORDS = re.compile(r"\s(?:followed by|and then|then)\s", re.I)
NUMBER = re.compile(r"(?:(?<=\s)|^)(?:#(\d{1,3})[.):]?|\((\d{1,3})\)|(\d{1,3})[.)])(?=\s)")
MARK = re.compile(r"^(?:[-*•·‣◦▪–—]\s+|[•·‣◦▪]\s*|(?:#\d{1,3}[.):]?|\(\d{1,3}\)|\d{1,3}[.)])\s+)")


def _quoted(text: str, at: int) -> int:
    """The place after the quotation that opens at ``at``, or -1 if none does. A doubled closing
    mark and a mark after a backslash stand for themselves."""
    close, i, n = PAIRS[text[at]], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == close:
            if i + 1 < n and text[i + 1] == close:
                i += 2
                continue
            if i + 1 < n and (text[i + 1].isalnum()):  # an apostrophe within a word
                i += 1
                continue
            return i + 1
        else:
            i += 1
    return -1


def _unquote(piece: str) -> str:
    p = piece.strip()
    if len(p) >= 2 and p[0] in PAIRS and _quoted(p, 0) == len(p):
        close, body, out, i = PAIRS[p[0]], p[1:-1], [], 0
        while i < len(body):
            c = body[i]
            if c == "\\" and i + 1 < len(body):
                d = body[i + 1]
                if d == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", body[i + 2:i + 6]):
                    out.append(chr(int(body[i + 2:i + 6], 16)))
                    i += 6
                    continue
                out.append(ESCAPES.get(d, d))
                i += 2
                continue
            if c == close and body[i + 1:i + 2] == close:
                i += 1
            out.append(c)
            i += 1
        return "".join(out).strip()
    return re.sub(r"\\([\"'\\])", r"\1", p)


def _listed(text: str) -> list[str] | None:
    """The raw members of a bracketed list, or None if the text is none."""
    if len(text) < 2 or OPEN.get(text[0]) != text[-1] or NUMBER.match(text):
        return None
    inner, depth, start, i, out, fresh = text[1:-1], 0, 0, 0, [], True
    while i < len(inner):
        c = inner[i]
        if fresh and c in PAIRS and (end := _quoted(inner, i)) > 0:
            i, fresh = end, False
            continue
        if c in OPEN:
            depth += 1
        elif c in CLOSE:
            depth -= 1
            if depth < 0:
                return None
        elif c in ",;" and depth == 0:
            out.append(inner[start:i])
            start, fresh, i = i + 1, True, i + 1
            continue
        if not c.isspace():
            fresh = False
        i += 1
    return None if depth else [*out, inner[start:]]


def _delimiters(text: str) -> dict[str, list[tuple[int, int]]]:
    """Places of every delimiter outside quotes and brackets, by kind."""
    found: dict[str, list[tuple[int, int]]] = {}
    i, n, depth, fresh = 0, len(text), 0, True

    def note(kind: str, length: int) -> int:
        found.setdefault(kind, []).append((i, i + length))
        return i + length

    while i < n:
        c = text[i]
        if fresh and c in PAIRS and (end := _quoted(text, i)) > 0:
            i, fresh = end, False
            continue
        m = NUMBER.match(text, i) if c in "#(" or c.isdigit() else None
        if m and (i == 0 or text[i - 1].isspace()):
            i, fresh = note("number", m.end() - i), True
            continue
        if c in OPEN and OPEN[c] in text[i:]:
            depth += 1
        elif c in CLOSE and depth:
            depth -= 1
        elif depth == 0:
            step = 0
            if c in "\r\n\u2028\u2029":
                step = note("line", 1)
            elif c == "\t":
                step = note("tab", 1)
            elif c == "\\" and i + 1 < n:
                i += 2
                fresh = False
                continue
            elif c in "|¦‖":
                step = note("bar", 1)
            elif c in ";；":
                step = note("semicolon", 1)
            elif arrow := next((a for a in sorted(ARROWS, key=len, reverse=True) if text.startswith(a, i)), ""):
                step = note("arrow", len(arrow))
            elif c.isspace() and (m := WORDS.match(text, i)):
                step = note("word", m.end() - i)
            elif c in "•·‣◦▪":
                step = note("bullet", 1)
            elif c in ",，、":
                step = note("comma", 1)
            elif c in ">&+/" and i and text[i - 1].isspace() and i + 1 < n and text[i + 1].isspace():
                step = note({">": "more", "&": "amp", "+": "plus", "/": "slash"}[c], 1)
            if step:
                i, fresh = step, True
                continue
        if not c.isspace():
            fresh = False
        i += 1
    numbers = found.get("number", [])
    read = [int(re.search(r"\d+", text[a:b])[0]) for a, b in numbers]
    if len(read) < 2 or read != list(range(read[0], read[0] + len(read))) or text[:numbers[0][0]].strip():
        found.pop("number", None)
    return found


def split_values(text: str | None) -> list[str]:
    """Every value of a packed field, in order.

    >>> split_values('lichen planus,"depression, postpartum"')
    ['lichen planus', 'depression, postpartum']
    """
    if text is None or not (t := text.strip()):
        return []
    pieces = _listed(t)
    if pieces is None:
        found = _delimiters(t)
        kind = next((k for k in STRENGTH if k in found), None)
        if kind is None:
            pieces = [t]
        else:
            pieces, start = [], 0
            for a, b in found[kind]:
                pieces.append(t[start:a])
                start = b
            pieces.append(t[start:])
            if kind == "number":
                pieces = [p.strip().rstrip(",;") for p in pieces]
    out = []
    for p in pieces:
        p = MARK.sub("", p.strip(), count=1)
        v = _unquote(p)
        if v:
            out.append(v)
    return out


def split_packed(df: DataFrame, key: str, field: str, at_least: int = 1) -> DataFrame:
    """(key, item_no, item): one row per value of ``field`` in fields holding at least so many.
    Only the two columns are read, whatever others the table has."""
    ship(df.sparkSession)
    source = df.select(key, field)
    kind = source.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("item_no", IntegerType()), StructField("item", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [split_values(t) for t in batch.column(1).to_pylist()]
            values = [v if len(v) >= at_least else [] for v in values]
            rows = pa.array([i for i, v in enumerate(values) for _ in v], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows),
                pa.array([k for v in values for k in range(1, len(v) + 1)], pa.int32()),
                pa.array([x for v in values for x in v], pa.string())], names=[key, "item_no", "item"])

    return source.mapInArrow(run, schema)
