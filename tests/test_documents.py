"""Document operators on small authored documents whose answers are known."""

import json

import pytest
from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.operators import chunks, layout_text, markdown, post, tables, tree, units


def one(spark, column, **values):
    """The value of a column expression over one row."""
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for n, v in values.items()))
    return row.select(column(*[F.col(n) for n in names]).alias("x")).first().x


def blocks(spark, rows):
    names = ["kind", "text", "level", "page_number", "list_type", "list_depth", "href", "footnote", "quote", "rendered"]
    types = "string string int long string int string string boolean string".split()
    data = [(d, i, *[r.get(n) for n in names]) for d, i, r in rows]
    return spark.createDataFrame(data, "doc_id long, idx long, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def doc(spark, *rows):
    return blocks(spark, [(1, i, r) for i, r in enumerate(rows)])


@pytest.mark.parametrize(
    "text, want",
    [
        ("a*b_c~d`e|f", r"a\*b\_c\~d\`e\|f"), ("# not a heading", r"\# not a heading"), ("x # y\n  ## z", "x # y\n \\## z"), ("####### seven", "####### seven"), ("$a*b$ and *", r"$a*b$ and \*"),
        ("$$x\n_y$$ _", "$$x\n_y$$ \\_"), (r"\| \$ \a", r"\| \$ \\a"), ("<b> <u>x</u> < 3 <sup>", r"\<b> <u>x</u> < 3 <sup>"), ("$ # 1", r"$ \# 1"), ("cost $5", "cost $5"), ("  a   b  ", "a b"),
    ],
)
def test_escape(spark, text, want):
    assert one(spark, T.escape_gfm, t=text) == want == tree.escape(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("꽃 밭 길", "꽃밭길"), ("3031 년 9 월", "3031 년 9 월"), ("시 분 초", "시 분 초"), ("둥근 마름모입니다.\n강가", "강가"), ("번개 입니다", ""), ("\uf06e\U000f00e1\U000f02b4\U000f1999", "■(인)④"), ("l\r\n\r\nm", "l\n\nm"),
    ],
)
def test_sanitize(spark, text, want):
    assert one(spark, T.sanitize, t=text) == want == tree.sanitize(text)


def test_scalars(spark):
    assert [one(spark, T.is_list_marker, t=x) for x in ("① a", "가. a", "(12) a", "1) a", "1)a", "□ x", "1234. a", "(가나다라) x")] == [True, True, True, True, False, True, False, False]
    assert [one(spark, T.cell_type, t=x) for x in ("", "1,234.5", "-3 %", "2024.1.2", "12년 3월", "1.2.3", "short", "longer than twelve", "500백만원", ",")] == [
        "empty", "number", "number", "date", "date", "short", "short", "long", "number", "short",
    ]
    assert all(one(spark, T.is_label_cell, t=x) for x in ("직급", "Unit / qty", "Ferry:", "강물:", "단 가"))
    assert not any(one(spark, T.is_label_cell, t=x) for x in ("", "7장", "제4회", "88초", "배를 타하세요", "boat and mast", "꽃 밭 길 강 물 배 돛 새 섬"))
    assert one(spark, T.safe_href, t=" HTTPS://a/(b) c'd ") == "HTTPS://a/%28b%29%20c%27d" and one(spark, T.safe_href, t="javascript:alert(1)") is None
    assert one(spark, T.has_diagram_word, t="업무  추진 체계") and not one(spark, T.has_diagram_word, t="체계")
    for x, want in ((2.5, 3.0), (-2.5, -2.0), (0.49999999999999994, 0.0), (-0.2, -0.0), (1.5, 2.0)):
        got = one(spark, layout_text.js_round, x=x)
        assert (got, str(got)) == (want, str(want))
    assert one(spark, lambda t: layout_text.rewrite_text(t, F.lit(14)), t=" ⼀ A ") == "一 A" and one(spark, lambda t: layout_text.rewrite_text(t, F.lit(14)), t="0 1 0-1 2") == "010-12"
    assert one(spark, layout_text.pdf_date, t="zD:202403") == "2024-03-01T00:00:00" and one(spark, layout_text.keywords, t=" ,; ") == [] and one(spark, layout_text.keywords, t="  ") is None
    assert one(spark, layout_text.ascii_hex, t="4 8 6>zz") == b"H`" and one(spark, layout_text.ascii_hex, t="4g>") is None
    assert [one(spark, lambda n, s=s: layout_text.note_mark(n, s), n=9) for s in ("DIGIT", "ROMAN_CAPITAL", "LATIN_SMALL", "HANGUL_SYLLABLE", "CIRCLED_DIGIT")] == ["9)", "IX)", "i)", "자)", "⑨)"]


def test_markdown(spark):
    rows = doc(
        spark, {"kind": "heading", "level": 3, "text": "Rivers"}, {"kind": "paragraph", "text": "depth <m> | 4*5"}, {"kind": "paragraph", "text": "a call", "href": "vbscript:y"},
        {"kind": "list", "text": "- marked"}, {"kind": "list", "text": "bare", "footnote": "see_2"}, {"kind": "list", "list_type": "ordered", "text": "first"},
        {"kind": "list", "list_type": "ordered", "text": "7. seventh"}, {"kind": "separator"}, {"kind": "image", "text": "map.gif"}, {"kind": "paragraph", "text": "bell \uf0fc"},
        {"kind": "heading", "level": 9, "text": "deep"}, {"kind": "heading", "text": ""}, {"kind": "table", "rendered": "| x |"}, {"kind": "paragraph", "text": "said", "quote": True, "href": "mailto:a@b.c"},
    )
    want = (
        "### Rivers\n\ndepth \\<m> \\| 4\\*5\n\na call\n\n- marked\n- bare (주: see\\_2)\n1. first\n7. seventh\n\n---\n\n\n![image](map.gif)\n\nbell ✔\n\n###### deep\n\n| x |\n\n> [said](mailto:a@b.c)"
    )
    assert markdown.blocks_to_markdown(rows).first().markdown == want
    once, again = (markdown.blocks_to_markdown(rows.repartition(n)).first().markdown for n in (1, 5))
    assert once == again


def test_pages(spark):
    rows = doc(spark, {"kind": "paragraph", "text": "lead"}, {"kind": "paragraph", "text": "one", "page_number": 1}, {"kind": "paragraph", "text": "more"}, {"kind": "paragraph", "text": "three", "page_number": 3})
    got = [(r.page_number, r.markdown) for r in markdown.blocks_to_pages(rows).orderBy("page_number").collect()]
    assert got == [(1, "lead\n\none\n\nmore"), (2, ""), (3, "three")]
    seen = spark.createDataFrame([(1, 5), (2, 9)], "doc_id long, page_number long")
    assert markdown.blocks_to_pages(rows, evidence=seen).count() == 5
    assert markdown.blocks_to_pages(doc(spark, {"kind": "paragraph", "text": "x"})).count() == 0
    bad = markdown.blocks_to_pages(doc(spark, {"kind": "paragraph", "text": "x", "page_number": 0})).first()
    wide = markdown.blocks_to_pages(doc(spark, {"kind": "paragraph", "text": "x", "page_number": 1}, {"kind": "paragraph", "text": "y", "page_number": 100_001})).first()
    edge = markdown.blocks_to_pages(doc(spark, {"kind": "paragraph", "text": "x", "page_number": 1}, {"kind": "paragraph", "text": "y", "page_number": 100_000}))
    assert (bad.error.code, wide.error.code, edge.where("error is not null").count(), edge.count()) == ("PARSE_ERROR", "OUTPUT_TOO_LARGE", 0, 100_000)
    pages = markdown.blocks_to_pages(rows)
    assert sorted(r.page_number for r in markdown.select_pages(pages, [0.6, 1.5, 2.5]).collect()) == [2, 3] and markdown.select_pages(pages, "2-9").count() == 2
    assert markdown.select_pages(pages, "1,2").count() == 0 and sorted(r.page_number for r in markdown.select_page_list(pages, "3abc, 1-1, 9").collect()) == [1, 3]


def test_chunks(spark):
    rows = doc(
        spark, {"kind": "paragraph", "text": "Timetable"}, {"kind": "heading", "level": 2, "text": "Boats"}, {"kind": "heading", "level": 4, "text": "Night boats"}, {"kind": "paragraph", "text": "They sail late."},
        {"kind": "list", "text": "Ticket"}, {"kind": "list", "text": "Window seat", "list_depth": 2}, {"kind": "list", "text": "Deck", "list_depth": 1}, {"kind": "separator"}, {"kind": "table", "rendered": "| a | b |"},
        {"kind": "heading", "level": 3, "text": "Cabins", "page_number": 12}, {"kind": "image", "text": "cabin.png"}, {"kind": "heading", "level": 2, "text": "Harbour"}, {"kind": "paragraph", "text": ""}, {"kind": "paragraph", "text": "quiet"},
    )
    got = [(r.type, list(r.breadcrumb), r.text, r.first_block, r.last_block, r.page) for r in chunks.blocks_to_chunks(rows).orderBy("id").collect()]
    night = ["Boats", "Night boats"]
    assert got == [
        ("text", [], "Timetable", 0, 0, None), ("heading", [], "## Boats", 1, 1, None), ("heading", ["Boats"], "#### Night boats", 2, 2, None),
        # an item of depth 0 is under nothing but headings, like the text before it; deeper ones are under the last shallower one
        ("text", night, "They sail late.\n\n- Ticket", 3, 4, None), ("text", [*night, "Ticket"], "- Window seat\n- Deck", 5, 6, None),
        # what isn't an item is under all items that none of a lower depth has closed
        ("text", [*night, "Ticket", "Deck"], "---", 7, 7, None), ("table", [*night, "Ticket", "Deck"], "| a | b |", 8, 8, None),
        ("heading", ["Boats"], "### Cabins", 9, 9, 12), ("text", ["Boats", "Cabins"], "![image](cabin.png)", 10, 10, None), ("heading", [], "## Harbour", 11, 11, None), ("text", ["Harbour"], "quiet", 13, 13, None),
    ]
    assert [r.id for r in chunks.blocks_to_chunks(rows).orderBy("id").collect()] == [f"c{i:04d}" for i in range(1, 12)]
    assert chunks.blocks_to_chunks(rows, "block").count() == 13
    deep = doc(spark, {"kind": "list", "text": "x", "list_depth": 40}, {"kind": "paragraph", "text": "y"})
    assert chunks.blocks_to_chunks(deep).where("error is not null").count() == 1


def grid(rows, **more):
    cell = lambda x: {"colSpan": 1, "rowSpan": 1} | (x if isinstance(x, dict) else {"text": x})
    return {"type": "table", "table": {"rows": len(rows), "cols": len(rows[0]), "cells": [[cell(x) for x in r] for r in rows], "hasHeader": True} | more}


def cells(spark, *rows):
    return spark.createDataFrame([("t", r, c, x if isinstance(x, str) else x[0], *((1, 1) if isinstance(x, str) else x[1:])) for r, row in enumerate(rows) for c, x in enumerate(row)], "table_id string, r int, c int, text string, col_span int, row_span int")


def test_tables(spark):
    merged = cells(spark, [("A & B", 2, 1), ""], [("left", 1, 2), "x\ny"], ["", "below"])
    assert tables.table_markdown(merged).first().markdown == '<table>\n<tr><th colspan="2">A &amp; B</th></tr>\n<tr><td rowspan="2">left</td><td>x<br>y</td></tr>\n<tr><td>below</td></tr>\n</table>'
    assert tables.table_markdown(cells(spark, ["a|b", "c"], ["1", "2\n3"])).first().markdown == "| a\\|b | c |\n| --- | --- |\n| 1 | 2<br>3 |"
    assert tables.table_markdown(cells(spark, ["1. one\n가. two\n\nthree"])).first().markdown == "**1. one**\n  가. two\nthree"
    assert tables.table_markdown(cells(spark, ["a\nb"], ["*"])).first().markdown == "a\nb\n\\*"
    ragged = spark.createDataFrame([("t", 0, 0, "a"), ("t", 0, 1, "b"), ("t", 1, 0, "c")], "table_id string, r int, c int, text string")
    assert tables.table_markdown(ragged).first().error == "PARSE_ERROR"
    assert tables.shape(spark.range(201).selectExpr("'t' table_id", "0 r", "cast(id as int) c")).first().error == "OUTPUT_TOO_LARGE"
    placed = spark.createDataFrame([(1, 0, 0, None, "a", 2, 2), (1, 1, 0, None, "b", 1, 1), (1, 2, 1, None, "c", 3, 1), (1, 3, 0, 0, "d", 1, 1)], "table_id long, ord int, r int, c int, text string, col_span int, row_span int")
    assert sorted(tuple(x)[1:] for x in tables.build_table(placed).collect()) == [(0, 0, "a\nd", 2, 2), (0, 2, "b", 1, 1), (1, 2, "c", 3, 1)]


def test_classification(spark):
    rivers = grid([["river", "length", "mouth"], ["Elbe", "1094", "sea"], ["Oder", "840", "sea"], ["Isar", "292", "river"]])
    bands = [["start", "", "", "", "", "stop"], [""] * 6, [""] * 6, ["", "", "wait", "", "", ""], [""] * 6]
    holder = grid([[{"text": "", "blocks": [rivers]}]])
    small = grid([["p", "q"]])
    docs = spark.createDataFrame([(7, json.dumps([rivers, {"type": "paragraph", "text": "흐름도"}, grid(bands), holder, small]))], "doc_id long, blocks string")
    got = {r.table_id: r for r in tree.classify_table_tree(docs).collect()}
    assert set(got) == {"7/0", "7/2", "7/3", "7/3/0.0/0", "7/4"}
    # all cells filled, one schema of rows, every column of one type: every part of the score is 1, and nothing speaks for a layout
    full = got["7/0"]
    assert (full.kind, full.confidence, full.semantic_score, full.non_tabular_score) == ("semantic-table", 1, 1, 0) and got["7/3/0.0/0"].kind == "semantic-table"
    assert full.reasons == ["repeated-row-schema", "grid-regularity", "high-active-density", "column-type-consistency"]
    # 3 of 30 slots; 3 of 5 rows and 3 of 6 columns empty: 0.4 * 6/11 + 0.5 * (0.6 - 0.1) / 0.6 + 0.15 for the word nearby
    assert got["7/2"].kind == "non-tabular-layout" and got["7/2"].non_tabular_score == round(0.4 * 6 / 11 + 0.5 * 0.5 / 0.6 + 0.15, 2)
    assert {"diagram-context-keyword", "spacer-bands", "extreme-sparsity"} <= set(got["7/2"].reasons)
    assert (got["7/3"].kind, got["7/3"].reasons, got["7/4"].kind, got["7/4"].reasons) == ("non-tabular-layout", ["nested-structure-wrapper"], "uncertain", ["low-evidence"])


def test_trees(spark):
    inner = grid([["in", "v"], ["A", "1"]])
    merged = grid([[{"text": "all", "colSpan": 2}, ""], [{"text": "left", "rowSpan": 2}, {"text": "right", "blocks": [inner]}], ["", "below"]], caption="cap *")
    spans = {"type": "paragraph", "text": "x", "spans": [{"text": " a ", "bold": True, "italic": True}, {"text": "b*", "strike": True, "underline": True}, {"text": "c", "code": True}, {"text": "hint", "placeholder": True}]}
    deep = leaf = {"type": "list", "text": "0"}
    for i in range(66):
        leaf["children"] = [{"type": "list", "text": str(i)}]
        leaf = leaf["children"][0]
    shallow = json.loads(json.dumps(deep))
    at = shallow
    for _ in range(64):
        at = at["children"][0]
    at.pop("children")
    docs = spark.createDataFrame([(i, json.dumps([b])) for i, b in enumerate((merged, spans, deep, shallow))] + [(9, "not json")], "doc_id long, blocks string")
    got = {r.doc_id: r for r in tree.tree_markdown(docs).collect()}
    assert got[0].markdown == (
        '**cap \\***\n\n<table>\n<tr><th colspan="2">all</th></tr>\n<tr><td rowspan="2">left</td><td><table>\n<tr><th>in</th><th>v</th></tr>\n<tr><td>A</td><td>1</td></tr>\n</table></td></tr>\n<tr><td>below</td></tr>\n</table>'
    )
    assert got[1].markdown == "***a*** <u>~~b\\*~~</u>`c`" and got[2].error == "OUTPUT_TOO_LARGE" and got[3].error is None and got[9].error == "PARSE_ERROR"


@pytest.mark.parametrize(
    "text, plain, html",
    [
        ("CO<sub>2</sub> over m<sup>3</sup> and 10<sup>a-b</sup>, **dry** <u>air</u> by [chart](http://sea.test/c)", "CO_2 over m^3 and 10^(a-b), dry air by chart", None),
        ("keel ![sail](s.gif)<i>mast</i>", "keel <i>mast</i>", None),
        ("deck  \n\n\nrope **  loose** end", "deck\n\nrope **  loose** end", None),
        ("| port | depth |\n| --- | --- |\n| Bremen \\| Nord | > 9 |", None, "<table>\n <tr>\n  <th>\n   port\n  </th>\n  <th>\n   depth\n  </th>\n </tr>\n <tr>\n  <td>\n   Bremen | Nord\n  </td>\n  <td>\n   &gt; 9\n  </td>\n </tr>\n</table>"),
        ("tide\n\n<table><tr><th>ebb</th><td><table><tr><td>low</td></tr></table>flow</td></tr></table>", None,
         "tide\n\n<table>\n <tr>\n  <th>\n   ebb\n  </th>\n  <td>\n   <table>\n    <tr>\n     <td>\n      low\n     </td>\n    </tr>\n   </table>\n   flow\n  </td>\n </tr>\n</table>"),
    ],
)
def test_postprocessing(spark, text, plain, html):
    if plain is not None:
        assert one(spark, post.plain, t=text) == plain
    if html is not None:
        assert one(spark, post.html_tables, t=text) == html
    assert one(spark, post.strip_scripts, t="m<sup>3</sup>/s<SUB>") == "m3/s<SUB>"


def test_units(spark):
    md = "one\ntwo\n\n| a \\| b | c |\n| --- | --- |\n| 1 | |\n<table><tr><td colspan='2'>x<br>&#x41;&amp;</td></tr>\n</table>\n---\n![image](p.png)\n\nlast"
    got = [(r.kind, r.raw) for r in units.explode_units(spark.createDataFrame([(1, md)], "doc_id long, markdown string")).orderBy("pos").collect()]
    assert [k for k, _ in got] == ["text", "gfm-table", "html-table", "separator", "image", "text"] and got[0][1] == "one\ntwo"
    assert one(spark, units.parse_gfm_table, t=got[1][1]) == [["a \\| b", "c"], ["1"]] or one(spark, units.parse_gfm_table, t=got[1][1]) == [["a \\| b", "c"], ["1", ""]]
    rows = one(spark, units.parse_html_table, t=got[2][1]).rows
    assert rows[0].header and rows[0].cells[0].col_span == 2
    lines = one(spark, units.html_cell_lines, t=rows[0].cells[0].inner + "<img src='a&amp;b'><table></table>")
    assert (lines.lines, lines.had_non_text, lines.img_srcs) == (["x", "A&"], True, ["a&b"])
    assert [one(spark, units.parse_html_table, t=x).error for x in ("<table><tr><td>x</tr></table>", "<table><tr></tr></table> y", "<table><tr><td colspan=201></td></tr></table>", "<table")] == ["PARSE_ERROR", "PARSE_ERROR", "OUTPUT_TOO_LARGE", "PARSE_ERROR"]
    split = one(spark, units.split_cell_tables, t="a<table><tr><td><table></table></td></tr></table>b")
    assert split.texts == ["a", "b"] and len(split.tables) == 1
