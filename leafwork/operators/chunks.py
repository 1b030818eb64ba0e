"""Structural chunks: headings, tables and runs of text, each with the headings and list items above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.operators.blocks import heading_level, in_order, joined, with_fragments

MAX_CHUNKS = 100_000
#: Depths of nested lists that breadcrumbs follow. Deeper items are an error row, never cut silently.
LIST_LEVELS = 12


def list_depth() -> Column:
    """The given depth, else 0 for list items and for paragraphs with a list mark."""
    marked = (F.col("kind") == "paragraph") & T.is_list_marker(F.coalesce("text", F.lit("")))
    return F.coalesce("list_depth", F.when((F.col("kind") == "list") | marked, 0))


def _alive(levels: dict[int, Column]) -> Column:
    """Texts of the entries that no later entry of a lower level has closed, from the lowest level up."""
    kept, highest = [], F.lit(-1).cast("long")
    for entry in levels.values():
        kept.append(F.when(entry["idx"] > highest, entry["text"]))
        highest = F.greatest(highest, F.coalesce(entry["idx"], F.lit(-1)))
    return F.filter(F.array(*kept), lambda x: x.isNotNull())


def blocks_to_chunks(blocks: DataFrame, granularity: str = "section") -> DataFrame:
    """doc_id, id, type, breadcrumb, text, page, first_block, last_block, error.

    Headings and tables are chunks of their own; other blocks with the same breadcrumb in a row are one chunk
    (``granularity='section'``) or one each ('block'). Blocks without Markdown are skipped.
    """
    rows = with_fragments(blocks).where(T.utrim(F.col("frag")) != "")
    rows = rows.withColumn("heading", F.col("kind") == "heading").withColumn("own", F.trim(T.utrim(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("rank", F.when(F.col("heading"), heading_level())).withColumn("depth", F.when(~F.col("heading") & (F.col("kind") != "table"), list_depth()))
    earlier = in_order().rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct("idx", F.col("own").alias("text"))
    last = lambda which: F.last(F.when(which, entry), True).over(earlier)
    columns = {f"h{n}": last(F.col("rank") == n) for n in range(1, 7)}
    columns |= {f"l{n}": last(F.col("depth") == n) for n in range(LIST_LEVELS)}
    columns["section"] = F.coalesce(F.max(F.when(F.col("heading"), F.col("idx"))).over(earlier), F.lit(-1))
    rows = rows.withColumns(columns)
    # a heading leaves out those of its own level and below; a list item leaves out items of its depth and deeper
    heads = {n: F.when(F.col("rank").isNull() | (F.lit(n) < F.col("rank")), F.col(f"h{n}")) for n in range(1, 7)}
    items = {
        n: F.when((F.col(f"l{n}.idx") > F.col("section")) & ~F.col("heading") & (F.col("depth").isNull() | (F.lit(n) < F.col("depth"))), F.col(f"l{n}"))
        for n in range(LIST_LEVELS)
    }
    rows = rows.withColumn("breadcrumb", F.concat(_alive(heads), _alive(items)))
    alone = F.col("heading") | (F.col("kind") == "table") | F.lit(granularity == "block")
    before = in_order()
    same = ~alone & ~F.lag("alone").over(before) & (F.col("breadcrumb") == F.lag("breadcrumb").over(before))
    rows = rows.withColumn("alone", alone)
    rows = rows.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("starts").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy("doc_id", "run").agg(
        F.max(F.when(F.col("heading"), "heading").when(F.col("kind") == "table", "table").otherwise("text")).alias("type"),
        F.first("breadcrumb").alias("breadcrumb"),
        joined(F.collect_list(F.struct("idx", "kind", "frag"))).alias("text"),
        F.min_by("page_number", F.when(F.col("page_number").isNotNull(), F.col("idx"))).alias("page"),
        F.min("idx").alias("first_block"),
        F.max("idx").alias("last_block"),
        F.max("depth").alias("deepest"),
    )
    bad = (F.col("run") > MAX_CHUNKS) | (F.coalesce("deepest", F.lit(0)) >= LIST_LEVELS)
    return chunks.select(
        "doc_id",
        F.concat(F.lit("c"), F.when(F.col("run") < 10_000, F.lpad(F.col("run").cast("string"), 4, "0")).otherwise(F.col("run").cast("string"))).alias("id"),
        "type", "breadcrumb", "text", "page", "first_block", "last_block",
        F.when(bad, F.struct(F.lit("OUTPUT_TOO_LARGE").alias("code"), F.lit("too many chunks or too deep a list").alias("message"))).alias("error"),
    )
