"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's frequent-items sketch, ``approx_top_k``) names the digests that may be frequent.
Their true counts and winners are computed by a map-side-combined aggregate and broadcast (at most ``HEAVY`` rows and
the few that share a 64-bit hash with them), so copies of a hot text are settled where they are read. All other digests
are settled by one ordinary shuffle; the sketch's error bound keeps each of their groups small.

Defined cases: a null text counts as empty; texts that differ only in runs of ASCII white space are equal; a null
``doc_id`` loses against any other; of several rows with the same smallest ``doc_id`` exactly one is kept; an empty
table gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import cut

#: Digests that are broadcast, and counters of the summary. Their ratio fixes the summary's error.
HEAVY, COUNTERS = 1000, 10_000


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with each run of ASCII white space as one blank."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def heavy_winners(digests: DataFrame) -> DataFrame:
    """(doc_id, digest) rows to the verified frequent digests: digest, winner (smallest doc_id), copies."""
    short = F.xxhash64("digest")
    found = (
        digests.select(short.alias("h"))
        .agg(F.expr(f"approx_top_k(h, {HEAVY}, {COUNTERS})").alias("top"))
        .select(F.explode("top.item").alias("h"))
    )
    return (
        digests.withColumn("h", short)
        .join(F.broadcast(found), "h", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = cut(docs.select(docs["doc_id"], text_digest(docs["text"]).alias("digest")))
    heavy = cut(heavy_winners(digests))
    split = digests.join(F.broadcast(heavy), "digest", "left")
    loses = F.col("copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("winner"))
    settled = split.where(loses).select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(False).alias("kept"), "digest"
    )
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("doc_id").asc_nulls_last())
    rest = split.where(~loses).select(
        "doc_id",
        F.min("doc_id").over(group).alias("keep_id"),
        F.coalesce("copies", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        "digest",
    )
    return settled.unionByName(rest).withColumnRenamed("digest", "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that repeat the text of a row with a smaller doc_id."""
    keyed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), text_digest(docs["text"]).alias("digest"))
    heavy = cut(heavy_winners(cut(keyed.select(F.col("id").alias("doc_id"), "digest")))).select("digest", "winner", F.lit(True).alias("heavy"))
    left = keyed.join(F.broadcast(heavy), "digest", "left").where(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("winner")))
    order = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last())
    return left.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
