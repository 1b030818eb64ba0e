"""Nested documents: blocks whose children, cells and captions hold blocks again, given as JSON text per document.

The recursion is walked once per document in Arrow batches: to Markdown with nested tables as HTML, and to a flat table of all
nodes, from which tables are classified by the same relational operator as flat ones. Depth over 64 is an error.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from leafwork.functions import text as T
from leafwork.operators import tables

MAX_DEPTH = 64
NODE = StructType()
for _name, _type in (("table_id", StringType()), ("r", IntegerType()), ("c", IntegerType()), ("text", StringType()), ("col_span", IntegerType()), ("row_span", IntegerType()), ("has_blocks", StringType()), ("has_table", StringType()), ("words", ArrayType(StringType()))):
    NODE = NODE.add(_name, _type)


def _nested(block: dict):
    table = block.get("table") or {}
    for r, row in enumerate(table.get("cells") or ()):
        for c, cell in enumerate(row):
            yield f"{r}.{c}", cell.get("blocks") or []
    yield "caption", table.get("captionBlocks") or []
    yield "children", block.get("children") or []


def walk(blocks: list[dict], path: str = "", depth: int = 0):
    """(path, block, texts nearby) of every block, depth first in source order."""
    if depth > MAX_DEPTH:
        raise RecursionError("blocks are nested too deep")
    for i, block in enumerate(blocks):
        near = [blocks[k]["text"] for k in (i - 2, i - 1, i + 1) if 0 <= k < len(blocks) and blocks[k].get("type") != "table" and blocks[k].get("text") is not None]
        at = f"{path}/{i}"
        yield at, block, near
        for name, inner in _nested(block):
            yield from walk(inner, f"{at}/{name}", depth + 1)


@F.pandas_udf(ArrayType(NODE))
def _cells(documents: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[dict] | None:
        try:
            found = []
            for path, block, near in walk(json.loads(text or "[]")):
                table = block.get("table") if block.get("type") == "table" else None
                if not table:
                    continue
                words = [x for x in (table.get("caption"), *near) if x is not None]
                for r, row in enumerate(table["cells"][: table["rows"]]):
                    for c, cell in enumerate(row[: table["cols"]]):
                        inner = cell.get("blocks") or []
                        has = any(b.get("type") == "table" and b.get("table") for b in inner)
                        found.append({"table_id": path, "r": r, "c": c, "text": cell["text"], "col_span": cell["colSpan"], "row_span": cell["rowSpan"], "has_blocks": str(bool(inner)), "has_table": str(has), "words": words})
            return found
        except (ValueError, KeyError, TypeError, RecursionError):
            return None

    return documents.map(one)


def table_cells(documents: DataFrame) -> DataFrame:
    """(doc_id, blocks as JSON) to the cells of all tables, nested ones too: table_id (the document and the table's path), r, c, text, spans, words."""
    rows = documents.select("doc_id", F.explode(_cells("blocks")).alias("x"))
    return rows.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), "x.table_id").alias("table_id"), "x.r", "x.c", "x.text", "x.col_span", "x.row_span",
        (F.col("x.has_blocks") == "True").alias("has_blocks"), (F.col("x.has_table") == "True").alias("has_table"), "x.words",
    )


def classify_table_tree(documents: DataFrame) -> DataFrame:
    """table_id and the classification of every table of every document, in the light of its caption and the texts nearby."""
    cells = table_cells(documents)
    context = cells.groupBy("table_id").agg(F.first("words").alias("words"))
    return tables.classify(cells.drop("words", "doc_id"), context)


# Rules of the text, for use inside of an Arrow batch, where the walk needs them at every depth.


#: Texts that ``sanitize`` and ``escape`` leave as they are, as of ``T.TIDY`` and ``T.INERT``.
TIDY = re.compile(r"(?:[!-~]++(?: [!-~]++)*+)?+")
INERT = re.compile(r"""(?:[!"%-)+-;=-\[\]^a-{}]++(?: [!"%-)+-;=-\[\]^a-{}]++)*+)?+""")


def sanitize(text: str) -> str:
    if TIDY.fullmatch(text):
        return text
    text = re.sub("[\U000f0000-\U000ffffd]", lambda m: T.PUA.get(ord(m[0]), T.SEAL if ord(m[0]) in T.SEALS else chr(0x2460 + T.CIRCLED.index(ord(m[0]))) if ord(m[0]) in T.CIRCLED else ""), text)
    text = re.sub("[\uf020-\uf0ff]", lambda m: T.PUA.get(ord(m[0]), m[0]), text)
    shapes = T.SHAPES
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if not re.fullmatch(rf"\s*(?:모서리가 둥근 |둥근 )?\s*(?:{shapes})\s*입니다\s*\.?\s*", x)]
    text = re.sub(" {2,}", " ", "\n".join(lines)).strip()
    words = text.split(" ")
    single = [w for w in words if re.fullmatch("[\uac00-\ud7af\u3131-\u318e]", w)]
    spread = len(words) >= 3 and len(single) * 10 >= len(words) * 7 and any(w not in T.DATE_UNITS for w in single)
    return "".join(words) if spread and len(text.encode("utf-16-le")) <= 60 else text


VERBATIM = re.compile(r"\\[|$]|\$\$(?:\\.|[^\\])*?\$\$|\$(?:\\.|[^\\$\n])+\$", re.S)


def escape(text: str) -> str:
    if INERT.fullmatch(text):
        return text
    text, out, at = sanitize(text), [], 0

    def part(x: str, head: bool) -> str:
        x = x.replace("\\", "\\\\")
        x = re.sub(r"^([ \t$]*)(#{1,6}[ \t])" if head else r"(?<=\n)([ \t$]*)(#{1,6}[ \t])", r"\1\\\2", x, flags=re.M if head else 0)
        x = re.sub(r"([~*_`|])", r"\\\1", x)
        return re.sub(r"<(?!/?(?:u|sup|sub)>)(?=[A-Za-z/!?])", r"\\<", x)

    for m in VERBATIM.finditer(text):
        out += [part(text[at : m.start()], at == 0), m[0]]
        at = m.end()
    return "".join([*out, part(text[at:], at == 0)])


def spans_text(spans: list[dict]) -> str:
    """Styled runs: white space stays outside of the marks, placeholders are left out."""
    out = []
    for s in spans:
        if s.get("placeholder"):
            continue
        core = s["text"].strip()
        if not core:
            out.append(s["text"])
            continue
        lead, tail = s["text"][: len(s["text"]) - len(s["text"].lstrip())], s["text"][len(s["text"].rstrip()) :]
        if s.get("code"):
            out.append(f"{lead}`{core}`{tail}")
            continue
        mark = "*" * (2 * bool(s.get("bold")) + bool(s.get("italic")))
        strike = "~~" * bool(s.get("strike"))
        shown = f"{strike}{mark}{escape(core)}{mark}{strike}"
        out.append(lead + (f"<u>{shown}</u>" if s.get("underline") else shown) + tail)
    return "".join(out)


def _html_text(text: str) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"&lt;(/?(?:u|sup|sub))&gt;", r"<\1>", text) if "&lt;" in text else text


def _noted(block: dict, text: str, clean) -> str:
    return f"{text} (주: {clean(block['footnoteText'])})" if block.get("footnoteText") is not None and block.get("text") is not None else text


def _caption_html(table: dict, depth: int) -> str:
    inner = table.get("captionBlocks") or []
    if any(b["type"] == "table" for b in inner):
        return "<br>".join(_captioned(b["table"], depth) if b["type"] == "table" else _html_text(_noted(b, sanitize(b["text"]), sanitize)) for b in inner if b.get("table") or b.get("text") is not None)
    return _html_text(sanitize(table["caption"])) if (table.get("caption") or "").strip() else ""


def _captioned(table: dict, depth: int) -> str:
    caption = _caption_html(table, depth + 1)
    return (caption + "<br>" if caption else "") + table_html(table, depth + 1)


def _cell_html(cell: dict, depth: int) -> str:
    if not cell.get("blocks"):
        return _html_text(sanitize(cell["text"])).replace("\n", "<br>")
    out = []
    for b in cell["blocks"]:
        if b["type"] == "table":
            out += [_captioned(b["table"], depth)] if b.get("table") else []
        elif b["type"] == "image":
            out += [f'<img src="{_html_text(b["text"]).replace(chr(34), "&quot;")}" alt="image">'] if b.get("text") is not None else []
        elif b["type"] == "separator":
            out.append("<hr>")
        elif b.get("text") is not None:
            spans = b.get("spans") or []
            text = "".join(s["text"] for s in spans if not s.get("placeholder")) if any(s.get("placeholder") for s in spans) else b["text"]
            if text:
                out.append(_html_text(_noted(b, sanitize(text), sanitize)).replace("\n", "<br>"))
    return "<br>".join(out)


def table_html(table: dict, depth: int) -> str:
    if depth > MAX_DEPTH:
        raise RecursionError("tables are nested too deep")
    rows, cols, covered, lines = table["rows"], table["cols"], set(), []
    for r in range(rows):
        line = ""
        for c in range(cols):
            if (r, c) in covered:
                continue
            cell = table["cells"][r][c]
            wide, high = min(max(cell["colSpan"], 1), cols - c), min(max(cell["rowSpan"], 1), rows - r)
            if wide > 1 or high > 1:
                covered |= {(r + i, c + j) for i in range(high) for j in range(wide)}
            tag = "th" if r == 0 or cell.get("isHeader") else "td"
            line += f"<{tag}" + f' colspan="{wide}"' * (wide > 1) + f' rowspan="{high}"' * (high > 1) + f">{_cell_html(cell, depth)}</{tag}>"
        lines.append(f"<tr>{line}</tr>\n")
    return "<table>\n" + "".join(lines) + "</table>"


def _cell_text(cell: dict) -> str:
    blocks = cell.get("blocks") or []
    if not any(b.get("spans") is not None or (b["type"] == "image" and b.get("text") is not None) for b in blocks):
        return escape(sanitize(cell["text"])).replace("\n", "<br>")
    shown = lambda b: f"![image]({b['text']})" if b["type"] == "image" and b.get("text") is not None else _noted(b, spans_text(b["spans"]) if b.get("spans") is not None else escape(b["text"]), escape)
    return "<br>".join(shown(b) for b in blocks if b.get("spans") is not None or b.get("text") is not None).replace("\n", "<br>")


def table_markdown(table: dict, depth: int) -> str:
    rows, cols, cells = table["rows"], table["cols"], table["cells"]
    if rows == 0 or cols == 0:
        return ""
    every = [x for row in cells[:rows] for x in row[:cols]]
    structured = any(b["type"] == "separator" or (b["type"] == "table" and b.get("table")) for x in every for b in x.get("blocks") or ())
    if structured or table.get("renderAsTable") or any(x["colSpan"] > 1 or x["rowSpan"] > 1 for x in every):
        return table_html(table, depth)
    if cols == 1:
        source = sanitize(cells[0][0]["text"]) if rows == 1 else "\n".join(escape(row[0]["text"]) for row in cells[:rows])
        lines = [x.strip() for x in source.split("\n") if x.strip()]
        if rows > 1:
            return "\n".join(lines)
        return "\n".join(f"**{escape(x)}**" if re.match(r"[0-9]+\.\s", x) else ("  " if re.match("[가-\ud7af]\\.\\s", x) else "") + escape(x) for x in lines)
    out = ["| " + " | ".join(map(_cell_text, row[:cols])) + " |" for row in cells[:rows]]
    return "\n".join([out[0], "| " + " | ".join(["---"] * cols) + " |", *out[1:]]).rstrip()


def _captioned_markdown(table: dict, depth: int) -> str:
    inner, out = table.get("captionBlocks") or [], ""
    if any(b["type"] == "table" for b in inner):
        for b in inner:
            if b["type"] == "table" and b.get("table"):
                shown = _captioned_markdown(b["table"], depth + 1)
                out += shown + "\n\n" if shown else ""
            elif b.get("text") is not None:
                out += f"**{_noted(b, escape(b['text']), escape)}**\n\n"
    elif (table.get("caption") or "").strip():
        out = f"**{escape(table['caption'])}**\n\n"
    return out + table_markdown(table, depth)


def markdown(blocks: list[dict], depth: int = 0, out: str = "") -> str:
    """Blocks of any depth as Markdown, without the final trim."""
    if depth > MAX_DEPTH:
        raise RecursionError("blocks are nested too deep")
    for b in blocks:
        kind, text = b["type"], b.get("text")
        if kind == "heading" and text:
            out += "#" * min(max(b.get("level") or 2, 1), 6) + " " + _noted(b, escape(text), escape) + "\n\n"
        elif kind == "separator" or (kind == "image" and text is not None):
            out += "\n" * bool(out) + (f"![image]({text})" if kind == "image" else "---") + "\n\n"
        elif kind == "list" and text is not None:
            clean, ordered = sanitize(text), b.get("listType") == "ordered"
            marked = re.match(r"[0-9]+\.\s", clean) if ordered else clean.startswith("- ")
            out += ("" if marked else "1. " if ordered else "- ") + _noted(b, escape(clean), escape) + "\n"
            if b.get("children") is not None:
                out = markdown(b["children"], depth + 1, out)
        elif kind == "table" and b.get("table"):
            shown = _captioned_markdown(b["table"], depth + 1)
            out += shown + "\n\n" if shown else ""
        elif kind == "paragraph" and text is not None:
            shown = spans_text(b["spans"]) if b.get("spans") else escape(text)
            href = (b.get("href") or "").strip()
            if re.match("(?i)https:|http:|mailto:|tel:|#", href):
                shown = f"[{shown}]({re.sub('[()<>' + chr(34) + chr(39) + '`' + r'\t\n\f\r ]', lambda m: f'%{ord(m[0]):02X}', href)})"
            out += "> " * bool(b.get("quote")) + _noted(b, shown, escape) + "\n\n"
    return out


RESULT = StructType().add("markdown", StringType()).add("error", StringType())


@F.pandas_udf(RESULT)
def _markdown_of(documents: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return markdown(json.loads(text or "[]")).strip(), None
        except RecursionError:
            return None, "OUTPUT_TOO_LARGE"
        except (ValueError, KeyError, TypeError, IndexError):
            return None, "PARSE_ERROR"

    return pd.DataFrame([one(x) for x in documents], columns=RESULT.names)


def tree_markdown(documents: DataFrame) -> DataFrame:
    """(doc_id, blocks as JSON) to doc_id, markdown, error."""
    return documents.select("doc_id", _markdown_of("blocks").alias("m")).select("doc_id", "m.markdown", "m.error")
