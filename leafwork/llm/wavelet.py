"""Token ids in wavelet-matrix files.

A file holds the ids of consecutive documents as a wavelet matrix: one bit-plane for each bit of an id, highest first, each
plane in the order that a stable sort by the bits above it gives. Planes are stored in zstd-compressed blocks of ``BLOCK``
bytes with the number of ones before each block, so that access, counting and search decompress a block or two per plane.

File: ``LWWM1``, an 8-byte little-endian header length, a JSON header (numbers of ids and bits, place of the shard, and for
each plane its zeros and the ends of its blocks), the compressed table of documents (doc_id or null, number of ids), then the planes.

``write`` deals documents by ranges of (doc_id, hash of the text), one range to a task, so that rows that share a doc_id, or
have none, are spread as well; a task starts a new file after ``FILE_TOKENS`` ids and holds one file at a time. Names follow
from the range and the place in it; a task that runs again writes the same files. ``read`` goes through Spark's ``binaryFile`` source.

Defined cases: a null text counts as empty and gives the end id alone; null doc_ids come first; rows that repeat a doc_id
follow each other in the order of their texts' hashes; an empty table writes no file and reads as an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.llm.common import cut, map_batches, shared_dir

MAGIC, END_ID = b"LWWM1", 2
BLOCK, FILE_TOKENS = 16_384, 2_000_000


def build(ids: np.ndarray, docs: list[tuple[int | None, int]], shard: int = 0, first: int = 0) -> bytes:
    """The bytes of a file. docs: (doc_id, number of ids) in order; first: ids in earlier files of the shard."""
    bits, pack = max(1, int(ids.max()).bit_length() if len(ids) else 1), zstandard.ZstdCompressor(level=1).compress
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, body = [], []
    for level in range(bits - 1, -1, -1):
        bit = (ids & ids.dtype.type(1 << level)) != 0
        raw = np.packbits(bit, bitorder="little").tobytes()
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        ones = np.cumsum([0, *(int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in blocks)]).tolist()
        packed = [pack(b) for b in blocks]
        planes.append({"zeros": int(len(ids) - ones[-1]), "ones": ones[:-1], "ends": np.cumsum([len(p) for p in packed]).tolist()})
        body += packed
        ids = np.concatenate((ids[~bit], ids[bit]))
    table = pack(json.dumps(docs).encode())
    header = json.dumps({"n": len(ids), "bits": bits, "shard": shard, "first": first, "table": len(table), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(header)), header, table, *body])


class WaveletMatrix:
    """Reads a file: token access, counts and places of an id, or all ids."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = struct.unpack("<Q", data[5:13])[0]
        self.head = json.loads(data[13 : 13 + size])
        at = 13 + size
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.docs = [tuple(x) for x in json.loads(self.unpack(data[at : at + self.head["table"]]))]
        at += self.head["table"]
        self.n, self.bits, self.data, self.places, self.blocks = self.head["n"], self.head["bits"], data, [], {}
        for plane in self.head["planes"]:
            self.places.append([at + x for x in [0, *plane["ends"]]])
            at = self.places[-1][-1]

    def block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.blocks:
            if len(self.blocks) > 256:
                self.blocks.clear()
            a, b = self.places[level][k : k + 2]
            self.blocks[level, k] = np.frombuffer(self.unpack(self.data[a:b]), np.uint8)
        return self.blocks[level, k]

    def bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // 8 // BLOCK)[i // 8 % BLOCK]) >> (i & 7) & 1

    def rank(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i >= self.n:
            return self.n - self.head["planes"][level]["zeros"]
        k, byte = i // 8 // BLOCK, i // 8 % BLOCK
        block = self.block(level, k)
        part = int(block[byte]) & ((1 << (i & 7)) - 1)
        return self.head["planes"][level]["ones"][k] + int(np.bitwise_count(block[:byte]).sum()) + part.bit_count()

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.head["planes"]):
            ones, bit = self.rank(level, i), self.bit(level, i)
            i = plane["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for level, plane in enumerate(self.head["planes"]):
            a, b = self.rank(level, begin), self.rank(level, end)
            if value >> (self.bits - 1 - level) & 1:
                begin, end = plane["zeros"] + a, plane["zeros"] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        a, b = self._range(value, begin, self.n if end is None else end)
        return b - a

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id; it must have that many."""
        i = self._range(value, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self.select(level, bit, i - self.head["planes"][level]["zeros"] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane says where the sorted halves go."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            raw = b"".join(self.unpack(self.data[a:b]) for a, b in zip(self.places[level], self.places[level][1:]))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros, up = self.head["planes"][level]["zeros"], np.empty_like(values)
            up[~bit] = values[:zeros]
            up[bit] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = up
        return values


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under another name, then rename: a reader never sees half a file."""
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def write(docs: DataFrame, folder: str, file: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files into ``folder``; returns shard, name, n of each file, written by then."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def files(batches: Iterator[dict]) -> Iterator[dict]:
        from leafwork.llm.tokens import ended_words

        words = ended_words(file)
        docs, ids, size, k, first, shard = [], [], 0, 0, 0, TaskContext.get().partitionId()

        def done() -> dict:
            name = f"{shard:07d}-{k:05d}.lwm"
            _put(folder, name, build(np.concatenate(ids), docs, shard, first))
            return {"shard": [shard], "name": [name], "n": [size]}

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                own = np.append(words(text or ""), np.uint16(END_ID))
                docs.append((doc_id, len(own)))
                ids.append(own)
                size += len(own)
                if size >= FILE_TOKENS:
                    yield done()
                    docs, ids, size, k, first = [], [], 0, k + 1, first + size
        if docs:
            yield done()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return cut(map_batches(dealt, files, "shard int, name string, n long"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Files to one row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for data in batch["content"]:
                matrix = WaveletMatrix(data)
                ids, at = matrix.all().astype("<u4"), matrix.head["first"]
                ends = np.cumsum([n for _, n in matrix.docs])
                yield {
                    "shard": [matrix.head["shard"]] * len(ends),
                    "doc_id": [d for d, _ in matrix.docs],
                    "at": (ends - [n for _, n in matrix.docs] + at).tolist(),
                    "n_tokens": [n for _, n in matrix.docs],
                    "ids_crc32": [crc32(ids[e - n : e].tobytes()) for e, (_, n) in zip(ends.tolist(), matrix.docs)],
                }

    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.lwm").load(folder).select("content")
    rows = cut(map_batches(blobs, run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"))
    # one row per shard in the window; a shard is a task's range of documents
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, F.col("shard") == F.col("k")).select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Write the files of ``docs`` into the shared folder and read them back."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    if not write(docs, folder, file).take(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(docs.sparkSession, folder)
