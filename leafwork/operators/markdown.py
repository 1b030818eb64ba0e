"""Blocks to Markdown, whole documents and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.operators.blocks import in_order, joined, with_fragments

MAX_PAGES, MAX_BYTES = 100_000, 256 << 20


def too_large(what: Column) -> Column:
    return F.when(what, F.struct(F.lit("OUTPUT_TOO_LARGE").alias("code"), F.lit("the projection exceeds its limit").alias("message")))


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: one row per document, blocks in order of idx."""
    rows = with_fragments(blocks)
    return rows.groupBy("doc_id").agg(joined(F.collect_list(F.struct("idx", "kind", "frag"))).alias("markdown"))


def page_of_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with page: the last number given so far, before the first one the first. Documents without numbers give no rows."""
    before = in_order().rowsBetween(Window.unboundedPreceding, 0)
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    page = F.coalesce(F.last("page_number", True).over(before), F.first("page_number", True).over(whole))
    return blocks.withColumn("page", page).where("page is not null")


def check_evidence(evidence: DataFrame) -> DataFrame:
    """(doc_id, ord, page_number) to doc_id, error: null where the page numbers of a document are positive and rise from one to the next,
    and are at most MAX_PAGES."""
    before = F.lag("page_number").over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = evidence.withColumn("bad", F.col("page_number").isNull() | (F.col("page_number") < 1) | F.coalesce(F.col("page_number") <= before, F.lit(False)))
    wrong = F.struct(F.lit("PARSE_ERROR").alias("code"), F.lit("page evidence must be positive and rise").alias("message"))
    found = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("bad").alias("bad"))
    return found.select("doc_id", F.coalesce(too_large(F.col("n") > MAX_PAGES), F.when(F.col("bad"), wrong)).alias("error"))


def blocks_to_pages(blocks: DataFrame, render: Callable[[Column], Column] | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, markdown: every page from the first to the last, empty ones included.

    ``render`` makes a page's text from its blocks, array<struct(idx, kind, frag, text)> in order, and isn't called for
    empty pages; ``evidence`` (doc_id, page_number) adds pages without blocks, and with ``ord`` its order is checked. Documents with a page
    number below one, more than MAX_PAGES pages or unsound evidence have one row with ``error`` instead.
    """
    render = render or joined
    if evidence is not None and "ord" in evidence.columns:
        unsound = check_evidence(evidence).where("error IS NOT NULL").select("doc_id", F.lit(None).cast("long").alias("page_number"), F.lit(None).cast("string").alias("markdown"), "error")
        keep = lambda df: df.join(unsound.select("doc_id"), "doc_id", "left_anti")
        return blocks_to_pages(keep(blocks), render, keep(evidence).drop("ord")).unionByName(unsound)
    rows = page_of_blocks(with_fragments(blocks))
    pages = rows.groupBy("doc_id", F.col("page").alias("page_number")).agg(
        render(F.array_sort(F.collect_list(F.struct("idx", "kind", "frag", "text")))).alias("markdown")
    )
    seen = pages.select("doc_id", "page_number")
    if evidence is not None:
        seen = seen.unionByName(evidence.select("doc_id", "page_number").join(seen.select("doc_id").distinct(), "doc_id", "left_semi"))
    span = seen.groupBy("doc_id").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"))
    bad = F.when(F.col("first") < 1, F.struct(F.lit("PARSE_ERROR").alias("code"), F.lit("page numbers must be positive").alias("message"))).otherwise(
        too_large(F.col("last") - F.col("first") >= MAX_PAGES)
    )
    every = span.withColumn("error", bad).select(
        "doc_id", "error", F.explode(F.when(F.col("error").isNull(), F.sequence("first", "last")).otherwise(F.array(F.lit(None).cast("long")))).alias("page_number")
    )
    found = every.join(pages, ["doc_id", "page_number"], "left")
    return found.select("doc_id", "page_number", F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).alias("markdown"), "error")


def bytes_of(pages: DataFrame) -> DataFrame:
    """doc_id, bytes, error: documents whose pages together exceed MAX_BYTES."""
    return pages.groupBy("doc_id").agg(F.sum(F.octet_length("markdown")).alias("bytes")).withColumn("error", too_large(F.col("bytes") > MAX_BYTES))


def select_pages(pages: DataFrame, wanted: list[float] | str) -> DataFrame:
    """Rows of the chosen pages. Numbers of at least 1 are rounded half away from zero; a text is one range a-b of at most 10,000."""
    if isinstance(wanted, str):
        a, dash, b = wanted.partition("-")
        ok = dash and a.strip().isdigit() and b.strip().isdigit() and 1 <= int(a) <= int(b) and int(b) - int(a) <= 10_000
        return pages.where(F.col("page_number").between(int(a), int(b)) if ok else F.lit(False))
    numbers = sorted({int(x + 0.5) for x in wanted if x == x and 1 <= x < float("inf")})
    return pages.where(F.col("page_number").isin(numbers) if numbers else F.lit(False))


def select_page_list(pages: DataFrame, wanted: str) -> DataFrame:
    """The lenient form: a comma list of numbers and ranges, read as far as they are digits and clipped to the pages there are."""
    last = pages.groupBy("doc_id").agg(F.max("page_number").alias("last"))
    part = F.explode(F.split(F.lit(wanted), ","))
    ends = last.select("doc_id", "last", part.alias("part")).select(
        "doc_id",
        "last",
        F.regexp_extract("part", r"^\s*(\d{1,9})", 1).alias("a"),
        F.coalesce(F.nullif(F.regexp_extract("part", r"^\s*\d{1,9}\s*-\s*(\d{1,9})", 1), F.lit("")), F.when(~F.col("part").rlike(r"^\s*\d+\s*-"), F.regexp_extract("part", r"^\s*(\d{1,9})", 1)), F.lit("")).alias("b"),
    )
    spans = ends.where("a <> '' and b <> ''").select("doc_id", F.greatest(F.col("a").cast("long"), F.lit(1)).alias("from"), F.least(F.col("b").cast("long"), "last").alias("to"))
    chosen = spans.where("from <= to").select("doc_id", F.explode(F.sequence("from", "to")).alias("page_number")).distinct()
    return pages.join(chosen, ["doc_id", "page_number"], "left_semi")
