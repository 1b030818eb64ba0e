"""Order tables at size: what is done once, and quick ways that must give what the general ones give."""

import pyarrow as pa
import pytest


def test_package_blocks_store_no_metadata(spark, monkeypatch):
    """Nothing reads it there, and to store it made and opened every package again."""
    from leafwork.operators import results
    from leafwork.plans.nested_queries import make_package, paragraph

    kept, stored = [], results.stored
    monkeypatch.setattr(results, "stored", lambda df: kept.append(df.columns) or stored(df))
    files = spark.createDataFrame([(1, bytearray(make_package([paragraph("a")])))], "doc_id long, content binary")
    assert [r.text for r in results.package_blocks(files)[0].collect()] == ["a"]
    assert kept and not any("title" in columns for columns in kept)


def test_cells_go_through_no_window(spark):
    from leafwork.sources import package

    rows = package.package_rows(spark.createDataFrame([], "doc_id long, content binary"))
    plan = package.tree(rows)["cells"]._jdf.queryExecution().analyzed().toString()
    cells = plan[plan.index("Filter (kind") :]
    assert "Window" in plan and "Window" not in cells[: cells.index("MapInArrow")]


def test_arrow_values_are_those_of_to_pylist():
    from leafwork.sources.package import values

    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.int32()))]))
    odd = pa.array([[{"a": None, "b": [1, None]}], None, [], [None, {"a": "x", "b": None}], [{"a": "y", "b": []}]], kind)
    for at in range(5):
        for n in range(5 - at + 1):
            assert values(odd.slice(at, n)) == odd.slice(at, n).to_pylist()


@pytest.mark.parametrize(("inside", "plain"), [
    ("<p><run><t>a</t><t>b</t></run><linesegarray><lineseg/></linesegarray></p><p><run><t> </t></run></p><p/>", True), ("", True), ("<p><run><t>a<tab/>b</t></run></p>", False),
    ("<p><run><tbl/></run></p>", False), ("<p><run><ctrl><fieldBegin/></ctrl><t>a</t></run></p>", False), ("<p><x><t>a</t></x></p>", False), ("<x/>", False),
])
def test_plain_cells(inside, plain):
    from leafwork.sources.package import read_xml
    from leafwork.sources.sections import plain_lines, texts_of

    holder = read_xml(f"<subList>{inside}</subList>".encode())
    assert plain_lines(holder) == (texts_of(holder) if plain else None)


def _plain_measures(cells):
    """What ``tables.MEASURES`` are, by a walk over one table."""
    kinds = ("empty", "number", "date", "short", "short")
    filled, lines = [x for x in cells if x["type"]], {}
    for x in cells:
        lines.setdefault(x["r"], []).append(x)
    said = [s for r, line in lines.items() if r > 0 and (s := [(x["c"], kinds[x["type"]]) for x in line if x["type"]])]
    one, shares, mean = lambda x: x["row_span"] == x["col_span"] == 1, [], len(cells) / len(lines)
    for c in sorted({x["c"] for x in cells}):
        of = [x["type"] for x in filled if x["c"] == c and x["r"] > 0 and x["col_span"] == 1]
        shares += [max(map(of.count, of)) / len(of)] if len(of) > 1 else []
    spread = 0.0
    for line in lines.values():
        spread += abs(len(line) - mean)
    return {
        "rows": max(x["r"] + x["row_span"] for x in cells), "cols": max(x["c"] + x["col_span"] for x in cells), "active": sum(x["row_span"] * x["col_span"] for x in filled),
        "body": sum(x["r"] > 0 for x in cells), "merged": sum(x["r"] > 0 and not one(x) for x in cells), "regular": sum(one(x) or (x["r"] == 0 and x["row_span"] == 1) for x in cells),
        "nested": sum(x["nested"] for x in cells), "anchors": len(cells), "used_rows": len({x["r"] + i for x in filled for i in range(x["row_span"])}),
        "used_cols": len({x["c"] + i for x in filled for i in range(x["col_span"])}), "schemas": len(said), "mode": max(map(said.count, said), default=0), "lines": len(lines),
        "mean": mean, "spread": spread / len(lines), "even": sum(shares) / len(shares) if shares else 0.0,
    }


def test_measures_of_many_tables_at_once():
    import random

    from leafwork.operators import tables

    rng, made = random.Random(5), []
    for n in range(60):
        slots = [(r, c) for r in range(rng.randint(1, 6)) for c in range(rng.randint(1, 5)) if rng.random() < 0.8] or [(0, 0)]
        span = lambda: rng.choice((1, 1, 1, 3))
        made.append([{"r": r, "c": c, "row_span": span(), "col_span": span(), "nested": rng.random() < 0.2, "type": rng.randint(0, 4) * (n % 7 > 0)} for r, c in slots])
    kind = pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("nested", pa.bool_()), ("type", pa.int8())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(made, kind)], names=["table_id", "cells"])
    want = [{"table_id": i, **_plain_measures(x)} for i, x in enumerate(made)]
    for most in (1, 50, 1 << 19):  # tables by themselves, in parts, all at once
        tables.PART_CELLS, usual = most, tables.PART_CELLS
        assert [row for b in tables._measured(iter([batch])) for row in b.to_pylist()] == want
        tables.PART_CELLS = usual


def test_few_and_many_spans_cover_the_same(spark, monkeypatch):
    import random

    from leafwork.operators import tables

    rng, rows = random.Random(6), []
    for t in range(40):  # areas that don't overlap, some with cells below them, or two in one slot
        for r in range(0, 6, 2):
            for c in range(0, 6, 3):
                high, wide = rng.randint(1, 2), rng.randint(1, 3)
                rows += [(t, r, c, "a", wide, high)] + [(t, r + i, c + j, "b", 1, 1) for i in range(2) for j in range(3) if (i, j) != (0, 0) and rng.random() < 0.7]
                rows += [(t, r, c, "c", 1, 1)] if rng.random() < 0.05 else []
    cells = spark.createDataFrame(rows, "table_id int, r int, c int, text string, col_span int, row_span int")
    shown = lambda: sorted(map(tuple, tables.visible_cells(cells).select("table_id", "r", "c", "text", "col_span", "row_span").collect()))
    few = shown()
    monkeypatch.setattr(tables, "FEW_SPANS", 0)
    assert few == shown() and 0 < len(few) < len(rows)


@pytest.mark.parametrize("name", ["classify_orders", "classify_spanned_orders"])
def test_cells_are_measured_many_at_once(spark, name):
    import __spark_entry__ as E

    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_quick_types(spark):
    from pyspark.sql import functions as F

    from leafwork.functions import text as T

    cases = ["1", "-1.5", "1.", "1.5.2", "2024-01-02", "2024-01-02\n", "99-1", " 7 ", "+3", "+", "1\n", "1,000 kg", "a", "a" * 13, "", " ", None, " 5", "2024-01-02x", "12.34원"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, text string").coalesce(1)
    t = T.utrim(F.coalesce(F.col("text"), F.lit("")))
    slow = F.when(t == "", "empty").when(T.is_number(t), "number").when(T.is_date(t), "date").when(F.char_length(t) <= 12, "short").otherwise("long")
    got = rows.select("text", T.cell_type(F.col("text")).alias("a"), slow.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got], got


NEVER = "(?!)"
TEXTS = [
    "| a | b |\n| --- | --- |\n| 1 | x\\|y & <u>z</u> \\* |\n|  | <b> |", "before\n<TABLE>\n<tr ><td>1</td> <th colspan=2>a\n b</th></TR></Table>\nafter", "| a |\n| - |", "<table><tr><td>", "<tab>|",
    "<table><tr><td>1</td><td>2</td><td/><td rowspan='2'>x<br>y</td><td>3</td></tr><!-- c --><tr><td>4</td>z</tr></table>", "a  b", " $1$ # _x_", "가 나 다 라", "a < b", "",
]


def _read(text):
    from leafwork.operators import post, tree, units

    def tried(f, x):
        try:
            return f(x)
        except ValueError as e:
            return repr(e)

    cell = {"text": text, "colSpan": 1, "rowSpan": 1}
    table = [{"type": "table", "table": {"rows": 2, "cols": 2, "cells": [[cell, cell | {"rowSpan": 2}], [cell | {"colSpan": 2}, cell]]}}]
    return post.html_tables_text(text), tried(units.html_table_rows, text), tried(units.cell_lines, text), tree.escape(text), tree.sanitize(text), tree.markdown(table)


def test_quick_ways_of_the_readers_change_nothing(monkeypatch):
    import re

    from leafwork.operators import post, tree, units

    quick = [_read(t) for t in TEXTS]
    monkeypatch.setattr(post, "MARKED", re.compile(""))
    for owner, name in ((units, "BARE"), (units, "PLAIN_CELL"), (tree, "TIDY"), (tree, "INERT")):
        monkeypatch.setattr(owner, name, re.compile(NEVER))
    assert quick == [_read(t) for t in TEXTS]
    assert quick[5][1] == [(True, [("1", 1, 1), ("2", 1, 1), ("", 1, 1), ("x<br>y", 1, 2), ("3", 1, 1)]), (False, [("4", 1, 1)])]


def test_wide_rows_are_still_too_large():
    from leafwork.operators import units

    row = lambda n: f"<table><tr>{'<td>x</td>' * n}</tr></table>"
    assert len(units.html_table_rows(row(200))[0][1]) == 200
    with pytest.raises(units.TooLarge):
        units.html_table_rows(row(201))


def test_html_tables_as_columns(spark):
    """Nulls, faults and tables without rows keep their places in a batch."""
    from pyspark.sql import functions as F

    from leafwork.operators import post, units

    texts = ["<table><tr><th>a</th></tr><tr></tr></table>", None, "<table>", "<table></table>", "<table><tr><td colspan=300>x</td></tr></table>", "<table><tr><td colspan=2>b</td><td>c</td></tr></table>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", units.parse_html_table("t").alias("p"), post.html_tables("t").alias("h")).orderBy("i").collect()
    assert [r.p.error for r in rows] == [None, None, "PARSE_ERROR", None, "OUTPUT_TOO_LARGE", None] and [r.h is None for r in rows] == [False, True] + [False] * 4
    plain = lambda p: p.rows and [(x.header, [tuple(c) for c in x.cells]) for x in p.rows]
    assert [plain(r.p) for r in rows] == [[(True, [("a", 1, 1)]), (False, [])], None, None, [], None, [(True, [("b", 2, 1), ("c", 1, 1)])]]
    assert spark.createDataFrame([], "t string").select(F.explode(units.parse_html_table("t").rows)).count() == 0
