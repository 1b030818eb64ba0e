"""Markdown read back: units, pipe tables, HTML tables and what their cells hold. Errors are values, never exceptions."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from leafwork.functions.text import utrim

MAX_TABLE_BYTES, MAX_DEPTH, MAX_COLS, MAX_ROWS, MAX_CELLS, ENTITY = 8 << 20, 64, 200, 10_000, 2_000_000, 16
TAG = re.compile(r"""<!--.*?-->|<\s*[!?][^>]*>|<\s*(/?)\s*([A-Za-z0-9-]+)((?:[^>'"]|'[^']*'|"[^"]*")*)>""", re.S)
#: A tag without attributes, and a whole cell without tags in it.
BARE, PLAIN_CELL = re.compile(r"<(/?)([A-Za-z0-9-]+)>"), re.compile(r"<(t[dh])>([^<]*)</\1>")
ATTRIBUTE = re.compile(r"""([\w-]+)\s*(?:=\s*("[^"]*"|'[^']*'|\S+))?""")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


class Malformed(ValueError):
    pass


class TooLarge(ValueError):
    pass


def tag_after(text: str, at: int) -> tuple[int, int, str, str, bool, bool] | None:
    """(start, end, name, attributes, closes, is empty) of the next tag; comments are skipped, a tag without an end is malformed."""
    while (start := text.find("<", at)) >= 0:
        m = BARE.match(text, start)
        if m:
            return start, m.end(), m[2].lower(), "", bool(m[1]), False
        m = TAG.match(text, start)
        if not m:
            raise Malformed("a tag has no end")
        at = m.end()
        if m[2]:
            return start, at, m[2].lower(), m[3].rstrip("/ \t\r\n"), bool(m[1]), not m[1] and m[3].rstrip().endswith("/")
    return None


def tags(text: str):
    """Each tag of a text, as of ``tag_after``."""
    at = 0
    while tag := tag_after(text, at):
        at = tag[1]
        yield tag


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v[1:-1] if v[:1] in "\"'" and v else v) for k, v in ATTRIBUTE.findall(text)}


def decode(text: str) -> str:
    """Entities with a name or number and at most 16 bytes to their end; others stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in NAMED:
            return NAMED[name]
        try:
            number = int(name[2:], 16) if name[:2] in ("#x", "#X") else int(name[1:]) if name[:1] == "#" else -1
            return chr(number) if 0 <= number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF else m[0]
        except ValueError:
            return m[0]

    return re.sub(rf"&([^&;]{{0,{ENTITY - 1}}});", one, text)


def _span(value: str | None, most: int) -> int:
    if value is None:
        return 1
    if not value.isdigit() or int(value) == 0:
        raise Malformed("a span is no positive number")
    if int(value) > most:
        raise TooLarge("a span exceeds its limit")
    return int(value)


def html_table_rows(raw: str) -> list[tuple[bool, list[tuple[str, int, int]]]]:
    """(is header, cells (inner, colspan, rowspan)) of one balanced table. Only the first row is a header; nested tables stay inside their cell."""
    if len(raw.encode()) > MAX_TABLE_BYTES:
        raise TooLarge("the table exceeds 8 MiB")
    rows: list[tuple[bool, list[tuple[str, int, int]]]] = []
    stack: list[tuple[str, int, tuple[int, int]]] = []
    row, done, last, depth = None, False, 0, 0
    while tag := tag_after(raw, last):
        start, last, name, attrs, closes, empty = tag
        end = last
        if name == "table" and not closes:
            if depth == 0 and (done or raw[:start].strip()):
                raise Malformed("text or a table beside the table")
            if depth >= MAX_DEPTH:
                raise TooLarge("tables are nested too deep")
            if empty:
                done = depth == 0 or done
            else:
                stack.append((name, end, (1, 1)))
                depth += 1
        elif name == "table" or (name in ("tr", "td", "th") and depth == 1 and closes):
            if not stack or stack[-1][0] != name:
                raise Malformed(f"{name} closes what isn't open")
            _, begin, spans = stack.pop()
            if name == "table":
                done = done or not stack
                depth -= 1
            elif name == "tr":
                rows.append((not rows, row))
                row = None
            elif row is None:
                raise Malformed("a cell outside of a row")
            else:
                row.append((raw[begin:start], *spans))
        elif name == "tr" and depth == 1:
            if row is not None or empty:
                raise Malformed("a row within a row")
            row = []
            stack.append((name, end, (1, 1)))
            while len(row) <= MAX_COLS and (cell := PLAIN_CELL.match(raw, last)):
                row.append((cell[2], 1, 1))
                last = cell.end()
        elif name in ("td", "th") and depth == 1:
            if row is None or stack[-1][0] in ("td", "th"):
                raise Malformed("a cell out of place")
            a = attributes(attrs) if attrs else {}
            spans = _span(a.get("colspan"), MAX_COLS), _span(a.get("rowspan"), MAX_ROWS)
            if empty:
                row.append(("", *spans))
            else:
                stack.append((name, end, spans))
        if len(rows) > MAX_ROWS or (row and len(row) > MAX_COLS):
            raise TooLarge("the table exceeds its limits")
    if not done or stack or row is not None or raw[last:].strip():
        raise Malformed("the table isn't closed")
    return rows


def top_tables(html: str) -> tuple[list[str], list[str]]:
    """Texts between, and the sources of, the tables at the top level of a cell."""
    texts, found, depth, begin, start = [], [], 0, 0, 0
    for a, b, name, _, closes, empty in tags(html):
        if name != "table":
            continue
        if not closes:
            if depth == 0:
                texts.append(html[begin:a])
                start = a
            depth += not empty
        else:
            depth -= 1
        if depth < 0:
            raise Malformed("a table closes that isn't open")
        if depth > MAX_DEPTH:
            raise TooLarge("tables are nested too deep")
        if depth == 0:
            found.append(html[start:b])
            begin = b
    if depth:
        raise Malformed("a table isn't closed")
    return [*texts, html[begin:]], found


def cell_lines(inner: str) -> tuple[list[str], bool, list[str]]:
    """Lines of a cell's text, whether it held tables or images, and the images' sources."""
    texts, found = top_tables(inner)
    text, images, parts, at = "".join(texts), [], [""], 0
    had = bool(found)
    for a, b, name, attrs, closes, _ in tags(text):
        if not closes and name in ("img", "br"):
            parts[-1] += text[at:a]
            at = b
            if name == "br":
                parts.append("")
            else:
                had = True
                if (src := attributes(attrs).get("src")) is not None:
                    images.append(decode(src))
    parts[-1] += text[at:]
    return [x for x in (decode(p).strip() for p in parts) if x], had, images


def units(markdown: str) -> list[tuple[str, str]]:
    """(kind, raw): text, gfm-table, html-table, separator and image, in order; blank lines part texts."""
    lines, out, i = markdown.split("\n"), [], 0
    special = lambda t: t[:1] == "|" or re.match(r"(?i)<table[\s/>]", t) or re.fullmatch("-{3,}", t) or re.fullmatch(r"!\[image\]\([^)]*\)\s*", t)
    while i < len(lines):
        t, begin = lines[i].strip(), i
        if not t:
            i += 1
            continue
        if t.startswith("<table") and re.match(r"<table[\s/>]", t):
            depth, kind = 0, "html-table"
            while i < len(lines):
                for _, _, name, _, closes, empty in tags(lines[i]):
                    depth += (name == "table" and not empty) * (-1 if closes else 1)
                i += 1
                if depth <= 0:
                    break
            html_table_rows("\n".join(lines[begin:i]))
        elif t[0] == "|":
            kind = "gfm-table"
            while i < len(lines) and lines[i].lstrip()[:1] == "|":
                i += 1
        else:
            kind = "separator" if re.fullmatch("-{3,}", t) else "image" if special(t) else "text"
            i += 1
            while kind == "text" and i < len(lines) and lines[i].strip() and not special(lines[i].strip()):
                i += 1
        out.append((kind, "\n".join(lines[begin:i])))
    return out


def _guarded(f, empty):
    def run(x):
        if x is None:
            return (*empty, None)
        try:
            return (*f(x), None)
        except TooLarge:
            return (*empty, "OUTPUT_TOO_LARGE")
        except Malformed:
            return (*empty, "PARSE_ERROR")

    return run


UNITS = StructType().add("units", ArrayType(StructType().add("kind", StringType()).add("raw", StringType()))).add("error", StringType())
CELL = StructType().add("inner", StringType()).add("col_span", IntegerType()).add("row_span", IntegerType())
ROWS = StructType().add("rows", ArrayType(StructType().add("header", BooleanType()).add("cells", ArrayType(CELL)))).add("error", StringType())
LINES = StructType().add("lines", ArrayType(StringType())).add("had_non_text", BooleanType()).add("img_srcs", ArrayType(StringType())).add("error", StringType())
SPLIT = StructType().add("texts", ArrayType(StringType())).add("tables", ArrayType(StringType())).add("error", StringType())


@F.pandas_udf(UNITS)
def split_units(texts: pd.Series) -> pd.DataFrame:
    named = lambda t: ([{"kind": k, "raw": r} for k, r in units(t)],)
    return pd.DataFrame(list(map(_guarded(named, (None,)), texts)), columns=UNITS.names)


@F.arrow_udf(ROWS)
def parse_html_table(texts: pa.Array) -> pa.Array:
    """Built column by column, as cells are many."""
    ends, cell_ends, rows, errors, headers, cells = [0], [0], [], [], [], []
    one = _guarded(lambda t: (html_table_rows(t),), (None,))
    for text in texts.to_pylist():
        found, error = one(text)
        for header, line in found or ():
            headers.append(header)
            cells += line
            cell_ends.append(len(cells))
        ends.append(len(headers))
        rows.append(found is not None)
        errors.append(error)
    inner, wide, high = zip(*cells) if cells else ((), (), ())
    cell = pa.StructArray.from_arrays([pa.array(inner, pa.string()), pa.array(wide, pa.int32()), pa.array(high, pa.int32())], CELL.names)
    line = pa.StructArray.from_arrays([pa.array(headers, pa.bool_()), pa.ListArray.from_arrays(pa.array(cell_ends, pa.int32()), cell)], ["header", "cells"])
    table = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line, mask=pa.array([not x for x in rows], pa.bool_()))
    return pa.StructArray.from_arrays([table, pa.array(errors, pa.string())], ROWS.names)


@F.pandas_udf(LINES)
def html_cell_lines(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(_guarded(cell_lines, (None, None, None)), texts)), columns=LINES.names)


@F.pandas_udf(SPLIT)
def split_cell_tables(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(_guarded(top_tables, (None, None)), texts)), columns=SPLIT.names)


def parse_gfm_table(raw: Column) -> Column:
    """Rows of a pipe table, array<array<string>>, without rules; escaped bars and inline tags stay as they are."""
    lines = F.filter(F.transform(F.split(raw, "\n"), utrim), lambda x: x.startswith("|"))

    def cells(line: Column) -> Column:
        parts = F.transform(F.split(F.substring(line, 2, 1 << 30), r"(?<!\\)\|", -1), utrim)
        return F.when(line.endswith("|") & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    rows = F.transform(lines, cells)
    return F.filter(rows, lambda r: (F.size(r) > 0) & ~F.forall(r, lambda c: c.rlike("^:?-{3,}:?$")))


def explode_units(markdown: DataFrame) -> DataFrame:
    """(doc_id, markdown) to doc_id, pos, kind, raw; documents that can't be read give one row with ``error``."""
    read = markdown.select("doc_id", split_units("markdown").alias("u"))
    return read.select("doc_id", "u.error", F.posexplode_outer("u.units").alias("pos", "unit")).select("doc_id", "pos", "unit.kind", "unit.raw", "error")
