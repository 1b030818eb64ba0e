"""What all block operators share. A block is a row (doc_id, idx, kind, text, ...); absent columns count as null.

kind is paragraph, heading, list, table, image or separator. A table block brings its text in ``rendered``
(see ``tables.table_markdown``), a paragraph with styled runs its Markdown in ``inline`` (see ``runs.styled``). Operators partition by doc_id once, and windows and regrouping reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import text as T

TYPES = {
    "level": "int", "page_number": "long", "list_type": "string", "list_depth": "int", "href": "string", "footnote": "string", "quote": "boolean", "rendered": "string", "inline": "string",
}


def full(blocks: DataFrame) -> DataFrame:
    """``blocks`` with every column of a block."""
    return blocks.withColumns({c: F.lit(None).cast(t) for c, t in TYPES.items() if c not in blocks.columns})


def in_order(*more: str) -> Window:
    return Window.partitionBy("doc_id").orderBy("idx", *more)


def heading_level() -> Column:
    level = F.col("level")
    return F.when(level.isNull() | (level == 0), 2).otherwise(F.least(F.greatest(level, F.lit(1)), F.lit(6)))


def fragment(shown: Column, note: Column, item: Column) -> Column:
    """The Markdown of a block, ending with a line break unless empty, from its escaped text, its note and (for lists) its visible text."""
    text = F.col("text")
    ordered = F.coalesce(F.col("list_type") == "ordered", F.lit(False))
    marked = F.when(ordered, item.rlike(T.NUMBERED)).otherwise(item.startswith("- "))
    link = T.safe_href(F.col("href"))
    paragraph = T.let(link, lambda to: F.when(to.isNull(), shown).otherwise(F.concat(F.lit("["), shown, F.lit("]("), to, F.lit(")"))))
    return F.coalesce(
        F.when(F.col("kind") == "heading", F.when(text != "", F.concat(F.repeat(F.lit("#"), heading_level()), F.lit(" "), shown, note, F.lit("\n\n"))))
        .when(F.col("kind") == "image", F.concat(F.lit("![image]("), text, F.lit(")\n\n")))
        .when(F.col("kind") == "separator", F.lit("---\n\n"))
        .when(F.col("kind") == "list", F.concat(F.when(marked, "").when(ordered, "1. ").otherwise("- "), shown, note, F.lit("\n")))
        .when(F.col("kind") == "table", F.when(F.col("rendered") != "", F.concat("rendered", F.lit("\n\n"))))
        .otherwise(F.concat(F.when(F.col("quote"), "> ").otherwise(""), paragraph, note, F.lit("\n\n"))),
        F.lit(""),
    )


def fragment_sql(kinds: tuple[str, ...] = ("heading", "list", "paragraph")) -> str:
    """The twin for blocks with kind, level and text only."""
    esc = T.escape_gfm_sql("text")
    item = T.sanitize_sql("text")
    level = "CASE WHEN level IS NULL OR level = 0 THEN 2 ELSE least(greatest(level, 1), 6) END"
    cases = {
        "heading": f"WHEN kind = 'heading' THEN CASE WHEN text <> '' THEN concat(repeat('#', {level}), ' ', {esc}, chr(10), chr(10)) END",
        "list": f"WHEN kind = 'list' THEN concat(CASE WHEN starts_with({item}, '- ') THEN '' ELSE '- ' END, {esc}, chr(10))",
        "paragraph": f"WHEN kind = 'paragraph' THEN concat({esc}, chr(10), chr(10))",
    }
    return f"coalesce(CASE {' '.join(cases[k] for k in kinds)} END, '')"


def joined(fragments: Column) -> Column:
    """array<struct(idx, kind, frag)> to Markdown. Images and separators stand after an empty line."""
    ordered = F.transform(
        F.array_sort(fragments), lambda b: F.concat(F.when(b["kind"].isin("image", "separator") & (b["frag"] != ""), "\n").otherwise(""), b["frag"])
    )
    return T.utrim(F.array_join(ordered, ""))


def with_fragments(blocks: DataFrame) -> DataFrame:
    """``blocks`` with frag, its Markdown. Escaping is computed once per row in a projection of its own."""
    written = F.col("kind").isin("heading", "list", "paragraph")
    note = F.when(F.col("footnote").isNotNull(), F.concat(F.lit(" (주: "), T.escape_gfm(F.col("footnote")), F.lit(")"))).otherwise("")
    rows = full(blocks).withColumns(
        {"__shown": F.when(written, F.coalesce(F.when(F.col("kind") == "paragraph", F.col("inline")), T.escape_gfm(F.col("text")))), "__note": note, "__item": F.when(F.col("kind") == "list", T.sanitize(F.col("text")))}
    )
    return rows.withColumn("frag", fragment(F.col("__shown"), F.col("__note"), F.col("__item"))).drop("__shown", "__note", "__item")
