"""From the tables to what the operators take: blocks, cells and items; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions.text import SPACES, chars_sql, decode_entities, decode_entities_sql, utrim

DROPPED = ("script", "style", "nav", "footer", "head")
BLANKS = "[ \\t\\r\\n]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.html to doc_id, idx, kind, level, text: headings, paragraphs and list items in order."""
    html = F.col("html")
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    parts = F.split(F.regexp_replace(html, r"(?i)<(h[1-6]|p|li)\b[^>]*>", "\x01$1\x02"), "\x01")
    found = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(parts).alias("pos", "part")).where("pos > 0")
    tag = F.lower(F.substring_index("part", "\x02", 1))
    body = F.regexp_replace(F.substring_index("part", "\x02", -1), r"(?s)<[^>]*>", " ")
    return found.select(
        "doc_id",
        (F.col("pos") - 1).cast("long").alias("idx"),
        F.when(tag.startswith("h"), "heading").when(tag == "li", "list").otherwise("paragraph").alias("kind"),
        F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("level"),
        utrim(decode_entities(F.regexp_replace(body, BLANKS, " "))).alias("text"),
    )


def _html_blocks_sql() -> str:
    html = "html"
    for tag in DROPPED:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    body = decode_entities_sql("regexp_replace(regexp_replace(split_part(part, chr(2), 2), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')")
    return f"""html_parts AS (SELECT page_id AS doc_id, string_split(regexp_replace({html}, '(?i)<(h[1-6]|p|li)\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM pages),
        html_rows AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM html_parts),
        html_blocks AS (SELECT doc_id, pos - 1 AS idx, CASE WHEN lower(part)[1] = 'h' THEN 'heading' WHEN lower(part)[1:2] = 'li' THEN 'list' ELSE 'paragraph' END AS kind,
            CASE WHEN lower(part)[1] = 'h' THEN part[2]::INT END AS level, trim({body}, {chars_sql(SPACES)}) AS text FROM html_rows WHERE pos > 0)"""


HTML_BLOCKS_SQL = _html_blocks_sql()


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.text line by line: the first is a heading of level one, the others are paragraphs."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return rows.select(
        "doc_id",
        F.col("idx").cast("long").alias("idx"),
        F.when(F.col("idx") == 0, "heading").otherwise("paragraph").alias("kind"),
        F.when(F.col("idx") == 0, 1).alias("level"),
        "text",
    )


LINE_BLOCKS_SQL = """line_rows AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        line_blocks AS (SELECT doc_id, idx, CASE WHEN idx = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN idx = 0 THEN 1 END AS level, text
            FROM (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS idx FROM line_rows))"""


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: what the user says is a heading; every third turn carries a page number, so pages start late and have gaps."""
    turn = F.col("turn")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        turn.alias("idx"),
        F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"),
        F.when(F.col("role") == "user", 2).alias("level"),
        "text",
        F.when(turn % 3 == 1, 2 * F.floor(turn / 2) + 1).cast("long").alias("page_number"),
    )


TURN_BLOCKS_SQL = """turn_blocks AS (SELECT conv_id AS doc_id, turn AS idx, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS kind,
            CASE WHEN role = 'user' THEN 2 END AS level, text, CASE WHEN turn % 3 = 1 THEN 2 * (turn // 2) + 1 END AS page_number FROM conversations)"""

HEADER = ("line", "quantity", "price", "flag", "shipped")


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order: a header row, then its line items. table_id, cells array<struct(r, c, text)>.

    Lines are read, dealt out and sorted once; an order's first line takes all of them, and nothing after that moves or sorts cells."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    line = F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.collect_list(line).over(whole).alias("lines"), F.row_number().over(order).alias("r")).where("r = 1")
    texts = lambda x: F.array(
        x["l_linenumber"].cast("string"), x["l_quantity"].cast("int").cast("string"), F.format_string("%.2f", x["l_extendedprice"]), x["l_returnflag"], F.date_format(x["l_shipdate"], "yyyy-MM-dd")
    )
    rows = F.concat(F.array(F.array(*map(F.lit, HEADER))), F.transform("lines", texts))
    cells = F.flatten(F.transform(rows, lambda row, r: F.transform(row, lambda t, c: F.struct(r.alias("r"), c.alias("c"), t.alias("text")))))
    return items.select(F.col("l_orderkey").alias("table_id"), cells.alias("cells"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of ``order_tables``: table_id, r, c, text, col_span, row_span."""
    return order_tables(spark, sf_dir).select("table_id", F.inline("cells")).withColumns({"col_span": F.lit(1), "row_span": F.lit(1)})


ORDER_CELLS_SQL = f"""order_lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r FROM lineitem),
        order_cells AS (
            SELECT table_id, 0 AS r, c, text FROM (SELECT DISTINCT l_orderkey AS table_id FROM lineitem), (VALUES {', '.join(f"({i}, '{h}')" for i, h in enumerate(HEADER))}) h(c, text)
            UNION ALL SELECT l_orderkey, r, c, text FROM (SELECT l_orderkey, r, unnest([0, 1, 2, 3, 4]) AS c,
                unnest([l_linenumber::VARCHAR, l_quantity::INT::VARCHAR, format('{{:.2f}}', l_extendedprice), l_returnflag, strftime(l_shipdate, '%Y-%m-%d')]) AS text FROM order_lines))"""
