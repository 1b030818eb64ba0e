"""Large batches and wide tables: what a step holds at a time, and that nothing is lost by it."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F


def test_rows_are_values_one_at_a_time(spark):
    """A batch of many rows is not turned into Python values as a whole, and what is made of it comes in few batches."""
    from leafwork.sources.package import map_rows

    def run(row):
        import gc

        dicts = [d for d in gc.get_objects() if type(d) is dict] if row["id"] % 1000 == 0 else []
        alive = sum(isinstance(x, bytes) and len(x) == 4096 for d in dicts for x in d.values())
        yield row["id"], alive

    files = spark.range(3000).coalesce(1).select("id", F.expr("cast(repeat('x', 4096) as binary)").alias("content"))
    found = map_rows(files, run, "id long, alive long")
    assert found.agg(F.count("*"), F.countDistinct("id")).first()[:] == (3000, 3000)
    assert found.agg(F.max("alive")).first()[0] < 10


def test_validation_reads_a_package_once_and_takes_odd_ones(spark):
    from leafwork.sources.package import MIMETYPE, validate

    def made(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members:
                z.writestr(name, data)
        return bytearray(out.getvalue())

    head = "<head secCnt='99999999999999999999'/>"
    files = [
        (1, made(("mimetype", b"\xff\xfe"), ("Contents/header.xml", head))), (2, made()), (3, bytearray(b"no")), (3, made(("mimetype", MIMETYPE), ("a.xml", "<a>"))), (None, made(("x/", ""), ("mimetype", MIMETYPE))),
    ]
    rows = validate(spark.createDataFrame(files, "doc_id long, content binary")).collect()
    assert len(rows) == 5  # one for each file, with a doc_id or without
    of = {(r.doc_id, r.error, r.entry_count): [x.message for x in r.issues] for r in rows}
    assert "secCnt=99999999999999999999, but found 0 sectionN.xml files" in of[1, None, 2] and of[1, None, 2][0].startswith("Content is")
    assert len(of[2, None, 0]) == 5 and of[3, "ZIP_BOMB", 0] == [] and any("well-formedness" in x for x in of[3, None, 2])
    assert of[None, None, 1][0] == "First ZIP entry is 'x/', expected 'mimetype'"


def _python_evaluations(df):
    """The most Python steps that one stage of the plan chains."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    most = now = 0
    for line in lines:
        now = 0 if "Exchange" in line or "FileScan" in line else now + any(x in line for x in ("MapInArrow", "ArrowEvalPython"))
        most = max(most, now)
    return most


@pytest.mark.parametrize("name", ["encrypted_packages", "hwpx_valid"])
def test_few_python_steps_in_a_stage(spark, name):
    """Each step has a worker of its own for each core of an executor."""
    import __spark_entry__ as E

    assert _python_evaluations(E.queries()[name](spark, "/root/testdata/sf0.001")) <= 2


@pytest.mark.parametrize("name", ["table_shape_orders", "table_gfm_orders", "table_html_orders", "classify_orders", "classify_spanned_orders", "tree_markdown_orders"])
def test_cells_are_neither_shuffled_nor_sorted(spark, name):
    """Line items are dealt out and sorted once; what is made of them, 25 cells an order, is not."""
    import __spark_entry__ as E

    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_covered_cells_with_two_in_a_slot(spark):
    """Cells that come one by one and packed give the same, also where two cells share a slot and a span covers both."""
    from leafwork.operators import tables

    rows = [(1, 0, 0, "a", 2, 1), (1, 0, 1, "b", 1, 1), (1, 0, 1, "c", 1, 1), (1, 1, 0, "d", 1, 1), (1, 1, 1, "e", 1, 1), (1, 1, 1, "f", 1, 1), (2, 0, 0, "g", 1, 3), (2, 2, 0, "h", 1, 1), (2, 3, 0, "i", 1, 1)]
    cells = spark.createDataFrame(rows, "table_id int, r int, c int, text string, col_span int, row_span int").repartition(3)
    assert sorted((x.table_id, x.text) for x in tables.visible_cells(cells).collect()) == [(1, t) for t in "adef"] + [(2, "g"), (2, "i")]
    html = {x.table_id: x.markdown for x in tables.table_html(cells).collect()}
    assert html == {x.table_id: x.markdown for x in tables.table_html(tables.packed(cells)).collect()}
    assert html[2] == '<table>\n<tr><th rowspan="3">g</th></tr>\n<tr></tr>\n<tr></tr>\n<tr><td>i</td></tr>\n</table>'
    assert [x[:] for x in tables.shape(cells).orderBy("table_id").collect()] == [x[:] for x in tables.shape(tables.packed(cells)).orderBy("table_id").collect()] == [(1, 2, 2, None), (2, 4, 1, "PARSE_ERROR")]


def _bold_by_hand(text):
    """Bold marks of one line taken one by one."""
    out, copied, open_at = [], 0, None
    at = text.find("**")
    while at >= 0:
        if not (at and text[at - 1] == "\\"):
            if open_at is not None and not text[at - 1].isspace():
                out += [text[copied:open_at], text[open_at + 2 : at]]
                copied, open_at = at + 2, None
            elif open_at is None and at + 2 < len(text) and not text[at + 2].isspace():
                open_at = at
        at = text.find("**", at + 2)
    return "".join([*out, text[copied:]])


def test_bold_is_unwrapped_without_python(spark):
    """Whole texts don't go to a Python worker, in batches of many rows; the result is that of a walk over the marks."""
    import random

    import __spark_entry__ as E
    from leafwork.operators.post import unwrap_bold

    for name in ("plain_documents", "bold_documents"):
        assert "Python" not in E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(5)
    texts = ["".join(rng.choices(["*", "**", "\\", " ", "a", "é", "\n", "\u00a0", "\x1c", "\u2028", "\r", "$1", "𝒳"], [5, 6, 2, 4, 6, 1, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 24))) for _ in range(20_000)]
    texts += ["**" + "a* b " * 200_000 + "c**", " **a" * 100_000, "**a** " * 100_000, "\\**" * 100_000, "**" * 99_999, "*" * 100_001, None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", unwrap_bold(F.col("text")).alias("got")).collect()
    assert len(rows) == len(texts)
    assert [r.text for r in rows if r.got != (None if r.text is None else "\n".join(map(_bold_by_hand, r.text.split("\n"))))] == []
