"""Queries of the unit reader, of laid-out text and of detection over the driver's tables."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators import layout_text as L
from leafwork.operators import tables, units
from leafwork.plans import adapters as A
from leafwork.plans.document_queries import _GFM
from leafwork.sources import detect

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = tables.table_gfm(A.order_tables(spark, sf_dir))
    return md.select(F.col("table_id").alias("doc_id"), F.concat(F.lit("before\nit\n\n"), "markdown", F.lit("\n---\n![image](a.png)\nafter")).alias("markdown"), F.col("markdown").alias("table"))


@query(_GFM + """, u AS (SELECT table_id AS doc_id, unnest([{'pos': 0, 'kind': 'text', 'raw': concat('before', chr(10), 'it')}, {'pos': 1, 'kind': 'gfm-table', 'raw': markdown},
            {'pos': 2, 'kind': 'separator', 'raw': '---'}, {'pos': 3, 'kind': 'image', 'raw': '![image](a.png)'}, {'pos': 4, 'kind': 'text', 'raw': 'after'}]) AS x FROM md)
        SELECT doc_id, x.pos AS pos, x.kind AS kind, x.raw AS raw FROM u""")
def units_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.explode_units(_table_text(spark, sf_dir).select("doc_id", "markdown")).drop("error")


@query(f"WITH {A.ORDER_CELLS_SQL} SELECT table_id AS doc_id, r, string_agg(text, '~' ORDER BY c) AS cells FROM order_cells GROUP BY table_id, r")
def gfm_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table_text(spark, sf_dir).select("doc_id", F.posexplode(units.parse_gfm_table(F.col("table"))).alias("r", "row"))
    return rows.select("doc_id", "r", F.array_join("row", "~").alias("cells"))


@query(f"WITH {A.ORDER_CELLS_SQL} SELECT table_id AS doc_id, r, r = 0 AS header, string_agg(text, '~' ORDER BY c) AS cells FROM order_cells GROUP BY table_id, r")
def html_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = tables.table_html(A.order_tables(spark, sf_dir))
    rows = html.select(F.col("table_id").alias("doc_id"), units.parse_html_table("markdown").alias("p")).select("doc_id", F.posexplode("p.rows").alias("r", "row"))
    return rows.select("doc_id", "r", "row.header", F.array_join(F.transform("row.cells", lambda c: c["inner"]), "~").alias("cells"))


@query("""SELECT page_id, array_to_string([url, 'a & b'], '~') AS lines, page_id::VARCHAR || '.png' AS images FROM pages""")
def cell_lines_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    inner = F.concat(F.lit(" "), url, F.lit("<br/>a &#38; b<img src='"), F.col("page_id").cast("string"), F.lit(".png'><table><tr><td>no</td></tr></table><br> "))
    read = A.read(spark, sf_dir, "pages").select("page_id", units.html_cell_lines(inner).alias("c"))
    return read.select("page_id", F.array_join("c.lines", "~").alias("lines"), F.array_join("c.img_srcs", "~").alias("images"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text items: quantity and discount make the transform, the price and line number the place."""
    n = F.row_number().over(A.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return A.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("sequence"), F.when(F.col("l_linenumber") == 5, "  ").otherwise(F.concat(F.lit("\ufeff "), "l_returnflag", F.lit(" x "))).alias("text"),
        F.col("l_quantity").alias("a"), (F.col("l_discount") * 3000).alias("b"), (F.col("l_tax") * -100).alias("c"), (F.col("l_quantity") / 2).alias("d"),
        (F.col("l_extendedprice") / 100 - 300).alias("e"), (F.col("l_suppkey") + 0.5).alias("f"), (F.col("l_quantity") - 1).alias("width"), F.lit(9.5).alias("height"),
    )


def _round_sql(x: str) -> str:
    return f"(floor({x}) + CASE WHEN {x} - floor({x}) >= 0.5 THEN 1.0 ELSE 0.0 END)"


def _hypot_sql(a: str, b: str) -> str:
    top = f"greatest(abs({a}), abs({b}))"
    return f"CASE WHEN {top} = 0 THEN 0.0 ELSE sqrt((abs({a}) / {top}) * (abs({a}) / {top}) + (abs({b}) / {top}) * (abs({b}) / {top})) * {top} END"


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS sequence FROM lineitem),
        t AS (SELECT l_orderkey AS doc_id, sequence, concat(l_returnflag, ' x') AS text, l_quantity AS a, l_discount * 3000 AS b, l_tax * -100 AS c, l_quantity / 2 AS d, l_extendedprice / 100 - 300 AS e, l_suppkey + 0.5::DOUBLE AS f,
            l_quantity - 1 AS w FROM i WHERE l_linenumber <> 5),
        s AS (SELECT *, {_round_sql("greatest(" + _hypot_sql("a", "b") + ", " + _hypot_sql("c", "d") + ")")} AS font_size, abs(b) > abs(a) * 4.0 AS up FROM t),
        p AS (SELECT doc_id, sequence, text, {_round_sql("e")} - CASE WHEN up AND b > 0 THEN greatest(1.0, font_size) ELSE 0.0 END AS x, {_round_sql("f")} AS y,
            CASE WHEN up THEN greatest(1.0, font_size) ELSE {_round_sql("w")} END AS width, 10.0::DOUBLE AS height, font_size, font_size = 0 OR w = 0 AS is_hidden, CASE WHEN up THEN greatest(1.0, {_round_sql("w")}) END AS rotated_length FROM s)
        SELECT doc_id, sequence, text, x + 0.0 AS x, y, width, height, font_size, is_hidden, rotated_length, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, sequence) AS rank FROM p""")
def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.project_items(_items(spark, sf_dir)).drop("error").withColumn("x", F.col("x") + 0.0)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(event_id::VARCHAR, '-', user_id::VARCHAR) WHEN event_id % 3 = 1 THEN 'ABC' ELSE concat('A B C ', event_type) END AS text FROM events""")
def rewrites_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit(" "), i.cast("string"), F.lit(" - "), F.col("user_id").cast("string"))).when(i % 3 == 1, "A B C").otherwise(F.concat(F.lit("A B C "), "event_type"))
    return A.read(spark, sf_dir, "events").select("event_id", L.rewrite_text(raw, F.lit(14)).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT00:00:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created_at, concat(event_type, '|', user_id::VARCHAR) AS keywords, 'T' AS title FROM events""")
def metadata_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    none = F.lit(None).cast("string")
    raw = A.read(spark, sf_dir, "events").select(
        "event_id", F.lit(" T\ufeff").alias("title"), F.lit(" ").alias("author"), none.alias("creator"), none.alias("subject"),
        F.concat_ws(" ;, ", "event_type", "user_id").alias("keywords"), F.concat(F.lit("x D:"), stamp).alias("creation_date"), none.alias("modified_date"),
    )
    return L.metadata(raw).select("event_id", "created_at", F.array_join("keywords", "|").alias("keywords"), "title")


@query("""SELECT c_custkey, concat('(', c_custkey % 40 + 1, ')') AS digit, concat(chr((65 + c_custkey % 26)::INT), ')') AS latin,
        concat(CASE (c_custkey % 40 + 1) // 10 WHEN 4 THEN 'xl' ELSE repeat('x', ((c_custkey % 40 + 1) // 10)::INT) END, ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(c_custkey % 40 + 1) % 10 + 1], '.') AS roman FROM customer""")
def note_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 40 + 1
    return A.read(spark, sf_dir, "customer").select(
        "c_custkey", L.note_mark(n, "DIGIT", "(").alias("digit"), L.note_mark(F.col("c_custkey") % 26 + 1, "LATIN_CAPITAL").alias("latin"), L.note_mark(n, "ROMAN_SMALL", "", ".").alias("roman")
    )


@query("SELECT o_orderkey, concat(hex(o_orderstatus), hex(o_orderpriority)) AS bytes FROM orders")
def hex_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat(F.hex("o_orderstatus"), F.lit(" \n"), F.lower(F.hex("o_orderpriority")), F.lit(" > rest"))
    return A.read(spark, sf_dir, "orders").select("o_orderkey", F.hex(L.ascii_hex(coded)).alias("bytes"))


def _zip(*names: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n), "x")
    return out.getvalue()


def compound(*names: str) -> bytes:
    """A compound file of three sectors with the named streams."""
    head = detect.OLE + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<4I", 1, 1, 0, 4096) + struct.pack("<4I", 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<I", 0) + b"\xff" * 432
    fat = struct.pack("<2I", 0xFFFFFFFD, 0xFFFFFFFE) + b"\xff" * 504
    rows = b""
    for i, (name, kind) in enumerate([("Root Entry", 5), *[(n, 2) for n in names]]):
        raw = (name + "\0").encode("utf-16-le")
        right = i + 1 if 0 < i < len(names) else 0xFFFFFFFF
        rows += raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, 0xFFFFFFFF, right, 1 if kind == 5 and names else 0xFFFFFFFF) + bytes(48)
    return head + fat + rows.ljust(512, b"\0")


#: Recipes of small files by name, with what they are.
FILES = {
    "empty": (b"", "unknown"), "short-pdf": (b"%P", "unknown"), "pdf": (b"%PDF-1.7", "pdf"), "png": (detect.PNG, "image"), "webp": (b"RIFF\0\0\0\0WEBP", "image"), "hwp3": (detect.HWP3 + b"..", "hwp3"),
    "hwpml": (b"\xef\xbb\xbf <?xml version='1.0'?><HWPML/>", "hwpml"), "xml": (b"<?xml version='1.0'?><a/>", "unknown"), "zip-xlsx": (_zip("xl/workbook.xml"), "xlsx"), "zip-docx": (_zip("word/document.xml"), "docx"),
    "zip-pptx": (_zip("ppt/presentation.xml"), "pptx"), "zip-hwpx": (_zip("Contents/content.hpf"), "hwpx"), "zip-other": (_zip("readme.txt"), "unknown"), "zip-broken": (b"PK\x03\x04not-a-zip", None),
    "cfb-workbook": (compound("Workbook"), "xls"), "cfb-fileheader": (compound("FileHeader"), "hwp"), "cfb-other": (compound("Other"), "unknown"), "cfb-broken": (detect.OLE, "unknown"),
}
_NAMES = ", ".join(f"({i}, '{n}', {'NULL' if k is None else repr(k)}, {str(b[:4] == detect.ZIP).lower()}, {str(b[:4] == detect.OLE[:4]).lower()}, {str(b[:4] == detect.PDF).lower()})" for i, (n, (b, k)) in enumerate(FILES.items()))


@query(f"SELECT page_id, f.name, f.kind, f.zip AS is_zip, f.ole AS is_old_hwp, f.pdf AS is_pdf FROM pages JOIN (VALUES {_NAMES}) f(i, name, kind, zip, ole, pdf) ON page_id % {len(FILES)} = i")
def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe for each page, by its id."""
    files = spark.createDataFrame([(i, n, bytearray(b)) for i, (n, (b, _)) in enumerate(FILES.items())], "i int, name string, content binary")
    rows = A.read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % len(FILES)).alias("i")).join(F.broadcast(files), "i")
    content = F.col("content")
    found = detect.detect(rows.select("page_id", "name", "content"))
    return found.select("page_id", "name", "kind", detect.is_zip(content).alias("is_zip"), detect.is_old_hwp(content).alias("is_old_hwp"), detect.is_pdf(content).alias("is_pdf"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.streaming.documents import windowed_counts

    return windowed_counts(A.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
