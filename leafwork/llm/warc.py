"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response gives a ``metadata`` record (application/warc-fields: status, source headers, digests, title, number of links)
and a ``conversion`` record (text/plain). Both name the response in WARC-Refers-To, keep its target URI and date, and carry the
digest of the source payload's bytes, and the digest that the source itself declared, as well as that of their own block.
Record ids are name-based, so a run that is repeated gives the same ids. All of it is column expressions over the response
rows: nothing is shuffled, and what both records need is computed before a response becomes two rows.

Defined cases: a null payload counts as empty; a null target URI leaves WARC-Target-URI out and counts as empty in ids;
a response without a record id gets one from its URI and payload; binary payloads are read as the charset of their headers
says (Latin-1, else UTF-8 with what isn't valid replaced); rows with an error and records that aren't responses are left out
by ``derive``; repeated rows give repeated records with equal ids; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.common import map_batches

DATE = "2024-01-01T00:00:00Z"
#: What is left out of the text, tags that break a line, and other tags.
UNSEEN = r"(?is)<!--.*?-->|<(?:script|style|noscript|template|svg)\b.*?</(?:script|style|noscript|template|svg)\s*>|<title\b.*?</title\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|main|aside|blockquote|pre)\b[^>]*>"
TAGS = r"<[A-Za-z/!?][^>]*>"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}
#: Bytes of a file that are unpacked at a time, of the largest record, of a file, and of the records that are passed on together.
PIECE, MAX_RECORD, MAX_FILE, TOGETHER = 1 << 20, 256 << 20, 1 << 30, 16 << 20


def record_id(*parts: Column) -> Column:
    """urn:uuid from the MD5 of the parts, marked as a name-based UUID (version 3)."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-3"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def html_text(html: Column) -> Column:
    """The visible text: a line for each block of the page, runs of blanks as one."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), BREAKS, "\n"), TAGS, " ")
    plain = text
    for entity, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    text = F.when(F.contains(html, F.lit("&")), plain).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]{2,}|[\t\r\f]", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def responses(pages: DataFrame) -> DataFrame:
    """Response rows from (page_id, url, html): page_id, record_id, target_uri, date, http_headers, payload."""
    html = F.coalesce(pages["html"], F.lit(""))
    return pages.select(
        pages["page_id"],
        record_id(F.lit("response"), pages["url"], pages["page_id"].cast("string"), html).alias("record_id"),
        pages["url"].alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string")).alias("http_headers"),
        html.alias("payload"),
    )


def _decoded(payload: Column, headers: Column) -> Column:
    latin = F.lower(headers).rlike(r"charset=\"?(?:iso-8859-1|latin-?1|us-ascii)\b")
    return F.when(latin, F.decode(payload, "ISO-8859-1")).otherwise(F.make_valid_utf8(payload.cast("string")))


def derive(source: DataFrame) -> DataFrame:
    """Response rows to two records each: the source's key columns, warc_type, record_id, refers_to, target_uri, date,
    content_type, source_headers, source_digest, declared_digest, block_digest, content_length, block.

    ``payload`` is text or bytes; ``payload_digest``, where there is one, is what the source declared."""
    types = dict(source.dtypes)
    if "error" in types:
        source = source.where("error is null")
    if "warc_type" in types:
        source = source.where("warc_type = 'response'")
    raw, headers = F.coalesce(source["payload"], F.lit("").cast(types["payload"])), F.coalesce(source["http_headers"], F.lit(""))
    declared = source["payload_digest"] if "payload_digest" in types else F.lit(None).cast("string")
    keys = [c for c in ("page_id",) if c in source.columns]
    rows = source.select(
        *keys, "record_id", "target_uri", "date", headers.alias("source_headers"), declared.alias("declared_digest"),
        digest(raw).alias("source_digest"), (_decoded(raw, headers) if types["payload"] == "binary" else raw).alias("page"),
    )
    title = F.trim(F.regexp_replace(F.regexp_extract("page", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"[ \t\r\n]+", " "))
    fields = F.concat(
        F.lit("status: "), F.regexp_extract("source_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1),
        F.lit("\r\nsource-headers: "), F.replace(F.col("source_headers"), F.lit("\r\n"), F.lit("; ")),
        F.lit("\r\nsource-digest: "), F.col("source_digest"),
        F.coalesce(F.concat(F.lit("\r\ndeclared-digest: "), F.col("declared_digest")), F.lit("")),
        F.lit("\r\ntitle: "), title,
        F.lit("\r\nlinks: "), F.regexp_count("page", F.lit(r"(?i)<a\s[^>]*href")).cast("string"), F.lit("\r\n"),
    )
    known = F.coalesce("record_id", record_id(F.lit("response"), F.col("target_uri"), F.col("source_digest")))
    rows = rows.select(*keys, known.alias("refers_to"), "target_uri", "date", "source_headers", "source_digest", "declared_digest", fields.alias("fields"), html_text(F.col("page")).alias("text"))
    made = lambda kind, mime, block: F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), F.col(block).alias("block"))
    both = F.array(made("metadata", "application/warc-fields", "fields"), made("conversion", "text/plain", "text"))
    return rows.withColumn("r", F.explode(both)).select(
        *keys, "r.warc_type", record_id(F.col("r.warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date",
        "r.content_type", "source_headers", "source_digest", "declared_digest", digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def record_text(r: DataFrame) -> Column:
    """The record as it stands in a file, without compression."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", r["warc_type"]), line("WARC-Record-ID", r["record_id"]), line("WARC-Date", r["date"]),
        line("WARC-Refers-To", r["refers_to"]), line("WARC-Target-URI", r["target_uri"]), line("WARC-Block-Digest", r["block_digest"]),
        line("WARC-Source-Payload-Digest", r["source_digest"]), line("WARC-Source-Declared-Digest", r["declared_digest"]), line("Content-Type", r["content_type"]),
        line("Content-Length", r["content_length"].cast("string")), F.lit("\r\n"), r["block"], F.lit("\r\n\r\n"),
    )


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """One .warc.gz file per partition, a gzip member per record; gives name and n of each file when run."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, n = f"{TaskContext.get().partitionId():07d}.warc.gz", 0
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for text in batch["record"]:
                    out.write(gzip.compress(text.encode(), mtime=0))
                    n += 1
        store.move(part, f"{path}/{name}")
        yield {"name": [name], "n": [n]}

    return map_batches(records.select(record_text(records).alias("record")), run, "name string, n long")


def _unpacked(data: bytes) -> Iterator[bytes | str]:
    """The bytes of a file piece by piece; a text says what is wrong with a gzip member, whose rest is left out."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            fed = at
            while not member.eof and fed < len(data):
                yield member.decompress(member.unconsumed_tail or data[fed : fed + PIECE], 8 * PIECE)
                fed += 0 if member.unconsumed_tail else PIECE
            if not member.eof:
                yield "cut off inside a gzip member"
                return
            at = min(fed, len(data)) - len(member.unused_data)
        except zlib.error:
            yield "broken gzip member"
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return


def _parsed(data: bytes) -> Iterator[tuple[int, dict, bytes, str | None]]:
    """(offset in the unpacked file, header fields, block, error) of each record. After a fault it goes on at the next record."""
    kept, begin = bytearray(), 0

    def drop(n: int) -> None:
        nonlocal begin
        begin += n
        del kept[:n]

    def whole(final: bool) -> Iterator[tuple[int, dict, bytes, str | None]]:
        while True:
            drop(len(kept) - len(kept.lstrip(b"\r\n")))
            if not kept or (not final and len(kept) < 5):
                return
            error, end = None, kept.find(b"\r\n\r\n")
            if kept[:5] != b"WARC/":
                error = "no record where one should begin"
            elif end < 0:
                if not final and len(kept) < PIECE:
                    return
                error = "cut off inside the header" if final else "a header without an end"
            else:
                lines = bytes(kept[:end]).decode("utf-8", "replace").split("\r\n")[1:]
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                size = head.get("content-length", "")
                if not (size.isascii() and size.isdigit()):
                    error = "no Content-Length"
                elif int(size) > MAX_RECORD:
                    error = "record too large"
                elif len(kept) >= end + 4 + int(size):
                    yield begin, head, bytes(kept[end + 4 : end + 4 + int(size)]), None
                    drop(end + 4 + int(size))
                    continue
                elif not final:
                    return
                else:
                    error = "cut off inside the block"
            yield begin, {}, b"", error
            to = kept.find(b"\nWARC/", 1)
            drop(to + 1 if to >= 0 else len(kept) if final else max(1, len(kept) - 5))

    for piece in _unpacked(data):
        if isinstance(piece, str):
            yield from whole(False)
            yield begin, {}, b"", piece
            drop(len(kept))
        else:
            kept += piece
            yield from whole(False)
    yield from whole(True)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of .warc and .warc.gz files: path, offset, error, warc_type, record_id, refers_to, target_uri, date, content_type,
    block_digest, payload_digest, http_headers, payload (bytes).

    What isn't well formed is a row with ``error`` and its offset in the unpacked file, and reading goes on at the next record;
    a file over MAX_FILE bytes is such a row as a whole. A task holds one file as it is stored and one record unpacked."""
    heads = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest")
    names = ("path", "offset", "error", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "http_headers", "payload")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows, size = [], 0
                for offset, head, block, error in _parsed(data):
                    http, payload = None, block
                    if head.get("warc-type") == "response":
                        http, _, payload = block.partition(b"\r\n\r\n")
                        http = http.decode("utf-8", "replace")
                    rows.append((path, offset, error, *map(head.get, heads), http, None if error else payload))
                    size += len(block)
                    if size > TOGETHER or len(rows) > 1000:
                        yield dict(zip(names, zip(*rows)))
                        rows, size = [], 0
                if rows:
                    yield dict(zip(names, zip(*rows)))

    text = "string, ".join(n + " " for n in names[3:12]) + "string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    read = map_batches(files.where(F.col("length") <= MAX_FILE).select("path", "content"), run, f"path string, offset long, error string, {text}, payload binary")
    large = files.where(F.col("length") > MAX_FILE).select("path", F.lit(0).cast("long").alias("offset"), F.lit("file too large").alias("error"))
    return read.unionByName(large, allowMissingColumns=True)
