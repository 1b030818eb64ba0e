"""The registered queries of the corpus operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import queries_sql
from leafwork.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.warc import derive, responses

    return derive(responses(table(spark, sf_dir, "pages"))).drop("date", "declared_digest", "block")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk (one for most documents): the ids, and the text that comes back from them."""
    from leafwork.llm.pieces import decode, encode

    return decode(encode(table(spark, sf_dir, "documents")), keep_ids=True).select(
        "doc_id",
        "chunk",
        "n_chunks",
        (F.octet_length("ids") / 2).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids16_crc32"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.wavelet import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from every embedding. Of those whose id is divisible by 100, an excerpt under noise (the last three quarters) is
    looked up among all. One row per recording: its class of equal fingerprints, the number of asked classes it aligns with, and the
    best of these alignments."""
    from leafwork.llm.fingerprints import lookup, recordings

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    first = F.floor(F.size("vector") / 4).cast("int") + 1
    excerpts = vectors.where("id % 100 = 0").withColumn("vector", F.slice("vector", first, F.greatest(F.size("vector"), F.lit(0))))
    return lookup(recordings(vectors), recordings(excerpts, noise=0.5))[1]


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored trees of all documents with three edits: words inserted at a third, twelve characters replaced at half, the last five deleted."""
    from leafwork.llm.edits import edit_trees, store_trees

    trees, n = store_trees(table(spark, sf_dir, "documents")), F.char_length("text")
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    first, second = " two new words", "other words "
    end = F.greatest(n + len(first) + len(second) - F.least(F.lit(12), n + len(first) - half) - 5, F.lit(0))
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("stop"), F.lit(new).alias("replacement"))
    edits = F.array(edit(third, third, first), edit(half, half + 12, second), edit(end, end + 5, ""))
    return edit_trees(trees.withColumn("edits", edits), keep_trees=False)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.url_filter import report

    return report(table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.merkle import report

    return report(table(spark, sf_dir, "documents"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.llm.turns import report

    return report(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_exact_dedup, op3_warc, op4_sentencepiece, op5_packing, op6_token_files, op7_chroma, op8_toxicity, op9_simhash, op10_token_counts, op11_url_filter,
        op12_merkle, op13_turns,
    )
}

SQL = queries_sql.SQL | {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
        FROM t""",
    "op3_warc": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        i AS (SELECT *, md5(concat_ws('|', 'response', coalesce(url, ''), page_id::VARCHAR, h)) AS m,
            concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(h)) AS heads FROM p),
        r AS (SELECT *, concat('<urn:uuid:', m[1:8], '-', m[9:12], '-3', m[14:16], '-8', m[18:20], '-', m[21:32], '>') AS rid, concat('sha256:', sha256(h)) AS pd FROM i),
        t AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
            regexp_replace(regexp_replace(regexp_replace(h,
            '(?is)<!--.*?-->|<(?:script|style|noscript|template|svg)\b.*?</(?:script|style|noscript|template|svg)\s*>|<title\b.*?</title\s*>', ' ', 'g'),
            '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|main|aside|blockquote|pre)\b[^>]*>', chr(10), 'g'),
            '<[A-Za-z/!?][^>]*>', ' ', 'g'),
            '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&amp;', '&'),
            '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), concat(' ', chr(10))) AS plain,
            concat('status: 200', chr(13), chr(10), 'source-headers: ', replace(heads, concat(chr(13), chr(10)), '; '), chr(13), chr(10), 'source-digest: ', pd, chr(13), chr(10),
                'title: ', trim(regexp_replace(regexp_extract(h, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '[ \t\r\n]+', ' ', 'g')), chr(13), chr(10),
                'links: ', len(regexp_extract_all(h, '(?i)<a\s[^>]*href')), chr(13), chr(10)) AS fields FROM r),
        b AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, fields AS block FROM t
              UNION ALL SELECT *, 'conversion', 'text/plain', plain FROM t),
        k AS (SELECT *, md5(concat_ws('|', warc_type, rid)) AS q FROM b)
        SELECT page_id, warc_type, concat('<urn:uuid:', q[1:8], '-', q[9:12], '-3', q[14:16], '-8', q[18:20], '-', q[21:32], '>') AS record_id,
               rid AS refers_to, url AS target_uri, content_type, heads AS source_headers, pd AS source_digest,
               concat('sha256:', sha256(block)) AS block_digest, strlen(block)::BIGINT AS content_length
        FROM k""",
}
