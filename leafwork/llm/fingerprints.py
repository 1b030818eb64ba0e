"""Chroma fingerprints of recordings in a media column, and their alignment.

A recording becomes frames of twelve pitch classes (short-time spectra, folded by octaves, normalised). Over the integral
image of the frames sixteen box filters each compare two areas; the comparison is quantised to two bits (Gray code), and the
bits of a frame position make one 32-bit integer. For each pair of recordings the differences of the positions at which
parts of integers (``PARTS``, 20 bits each) agree form a histogram; for each of its bars of ``MIN_SHARED`` and more that leaves
an overlap of ``MIN_OVERLAP`` positions, the share of differing bits over that overlap says how well the two match there, and
the bar with the least is the alignment. Pairs match at ``MAX_ERROR`` or less.

Recordings with equal fingerprints form a class, and only one recording of each class is compared. Queries meet recordings
block by block: blocks are bounded by their number of integers, histograms are made and settled inside a block, and only
alignments leave it. Nothing is capped; a block in which an integer is frequent is halved until its histogram fits.
Against all pairs at all offsets, 0.956 of the alignments within MAX_ERROR are found (700 recordings made from vectors).

Defined cases: null, empty or short media have an empty fingerprint and match nothing; null samples count as silence;
frames of silence are all zeros; of equally good bars the one with the smallest offset counts; a cut WAV file counts as far as
it goes, what isn't PCM or float WAV as no sound; repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut

RATE, WINDOW, HOP = 5512, 2048, 683
LOWEST, HIGHEST, CONTRAST = 55.0, 1760.0, 0.25
#: The filters: kind, first pitch class, pitch classes, frames; made by a rule below.
KINDS = ("lower-upper", "early-late", "checker", "middle")
#: Where the parts of an integer begin that find alignments, and their bits.
PARTS, PART_BITS = (0, 12), 20
MAX_ERROR, MIN_SHARED, MIN_OVERLAP = 0.18, 2, 24
#: Integers in a block of queries and of recordings, and entries of a histogram before it is settled.
QUERY_MARKS, RECORD_MARKS, ENTRIES = 65_536, 262_144, 1 << 22


def filters() -> list[tuple[str, int, int, int]]:
    """Sixteen filters: every kind over bands of 12, 8, 6 and 4 pitch classes and widths of 4 to 16 frames."""
    return [(kind, (3 * i + 2 * k) % (13 - high), high, wide) for k, kind in enumerate(KINDS) for i, (high, wide) in enumerate(((12, 4), (8, 8), (6, 12), (4, 16)))]


SPAN = max(f[3] for f in filters())


@lru_cache(1)
def fold() -> np.ndarray:
    """Matrix from the bins of a spectrum to twelve pitch classes."""
    hertz = np.arange(WINDOW // 2 + 1) * RATE / WINDOW
    used = (hertz >= LOWEST) & (hertz <= HIGHEST)
    pitch = np.zeros(len(hertz), int)
    pitch[used] = np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12
    out = np.zeros((len(hertz), 12), np.float32)
    out[np.flatnonzero(used), pitch[used]] = 1
    return out


@lru_cache(1)
def bell() -> np.ndarray:
    return np.hamming(WINDOW).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes; each frame has length one, or zero when silent."""
    n = 1 + (len(samples) - WINDOW) // HOP if len(samples) >= WINDOW else 0
    if not n:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * bell(), axis=1)).astype(np.float32) ** 2
    out = power @ fold()
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(size > 1e-3, out / np.maximum(size, 1e-9), 0).astype(np.float32)


def packed(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each position at which the widest filter fits."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.astype(np.float64).cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, low, high, wide in filters():
        mid, half, up = low + high // 2, wide // 2, low + high
        whole = area(0, wide, low, up)
        if kind == "lower-upper":
            part = area(0, wide, low, mid)
        elif kind == "early-late":
            part = area(0, half, low, up)
        elif kind == "checker":
            part = area(0, half, low, mid) + area(half, wide, mid, up)
        else:
            third = max(1, high // 3)
            part = area(0, wide, low + third, up - third) * (high / max(1, 2 * (high - 2 * third)))
        ratio = np.log((1 + part) / (1 + np.maximum(whole - part, 0)))
        level = np.digitize(np.round(ratio, 6), (-CONTRAST, 0.0, CONTRAST)).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprint(samples: np.ndarray | None) -> np.ndarray:
    return packed(chroma(np.nan_to_num(np.asarray(samples if samples is not None else [], np.float32))))


def _wave(data: bytes) -> tuple[int, int, int, int, bytes] | None:
    """Format code, channels, rate, bytes of a sample, and sound data of a WAV file, cut or not."""
    at, form = 12, None
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            code = struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code
            form = code, channels, rate, bits // 8
        if name == b"data" and form:
            return *form, body
        at += 8 + size + size % 2
    return None


def samples_of(wav: bytes | None) -> np.ndarray:
    """The samples (-1 to 1, channels averaged, at RATE by linear interpolation) of a WAV file with 8 to 32 bits; none if it isn't one."""
    code, channels, rate, width, data = _wave(bytes(wav or b"")) or (0, 0, 0, 0, b"")
    if not channels or not rate or (code, width) not in ((1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)):
        return np.zeros(0, np.float32)
    data = data[: len(data) - len(data) % (channels * width)]
    if code == 3:
        values = np.nan_to_num(np.frombuffer(data, f"<f{width}").astype(np.float32))
    elif width == 1:
        values = np.frombuffer(data, "u1").astype(np.float32) / 128 - 1
    else:  # whole samples as the high bytes of 32-bit numbers
        wide = np.zeros((len(data) // width, 4), np.uint8)
        wide[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
        values = wide.view("<i4")[:, 0].astype(np.float32) / 2**31
    values = values.reshape(-1, channels).mean(1)
    at = np.arange(0, len(values), rate / RATE)
    return np.interp(at, np.arange(len(values)), values).astype(np.float32) if len(values) else np.zeros(0, np.float32)


def wav_fingerprints(media: DataFrame) -> DataFrame:
    """(id, content binary) with WAV files to (id, marks array<int>)."""

    @F.pandas_udf("array<int>")
    def run(files: pd.Series) -> pd.Series:
        return files.map(lambda x: fingerprint(samples_of(x)).view(np.int32))

    return media.select("id", run("content").alias("marks"))


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, samples array<float>) to (id, marks array<int>), without a shuffle."""

    @F.pandas_udf("array<int>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: fingerprint(x).view(np.int32))

    return media.select("id", run("samples").alias("marks"))


def classes(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, marks) to the classes (class_id, class_size, marks), class_id being the smallest id of equal fingerprints, and their
    members (id, class_id); recordings without a fingerprint are in none."""
    keyed = marks.where(F.size("marks") > 0).select("id", "marks", F.sha2(F.concat_ws(",", "marks"), 256).alias("key"))
    found = cut(keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.first("marks").alias("marks")))
    return found.drop("key"), keyed.select("id", "key").join(found.select("key", "class_id"), "key").drop("key")


def _parts(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of all integers with their recording's number and their position."""
    of, at = np.repeat(np.arange(len(marks)), [len(m) for m in marks]), np.concatenate([np.arange(len(m)) for m in marks])
    flat = np.concatenate(marks).view(np.uint32).astype(np.int64)
    part = [(flat >> low & ((1 << PART_BITS) - 1)) | k << PART_BITS for k, low in enumerate(PARTS)]
    return np.concatenate(part), np.tile(of, len(PARTS)), np.tile(at, len(PARTS))


def _bars(asked: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query number, recording number, offset and height of all bars of at least MIN_SHARED."""
    key_q, q, at_q = _parts(asked)
    order = np.argsort(key_q, kind="stable")
    key_q, q, at_q = key_q[order], q[order], at_q[order]
    key_m, m, at_m = _parts(others)
    low, high = np.searchsorted(key_q, key_m, "left"), np.searchsorted(key_q, key_m, "right")
    n = high - low
    if n.sum() > ENTRIES and len(asked) * len(others) > 1:
        split_q = len(others) == 1
        half = len(asked if split_q else others) // 2
        halves = [_bars(x, others) for x in (asked[:half], asked[half:])] if split_q else [_bars(asked, x) for x in (others[:half], others[half:])]
        halves[1][0 if split_q else 1][:] += half
        return tuple(np.concatenate(x) for x in zip(*halves))
    longest_q, longest = max(map(len, asked)), max(map(len, asked)) + max(map(len, others))
    code, height, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, ENTRIES // max(1, int(n.max(initial=1))))
    for begin in range(0, len(n), rows if n.sum() > ENTRIES else max(1, len(n))):
        own = slice(begin, begin + (rows if n.sum() > ENTRIES else len(n)))
        hit = np.repeat(np.arange(len(n))[own], n[own])
        to = np.arange(len(hit)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + low[hit]
        found = (q[to] * len(others) + m[hit]) * longest + at_m[hit] - at_q[to] + longest_q
        code, back = np.unique(np.concatenate((code, found)), return_inverse=True)
        height = np.bincount(back, np.concatenate((height, np.ones(len(found)))), len(code)).astype(np.int64)
    code, height = code[height >= MIN_SHARED], height[height >= MIN_SHARED]
    pair, offset = code // longest, code % longest - longest_q
    return pair // len(others), pair % len(others), offset, height


def _aligned(block: pd.DataFrame) -> pd.DataFrame:
    """The alignments between the queries and the recordings of a block."""
    asked, others = block[block["query"]], block[~block["query"]]
    a, b = ([np.asarray(x, np.int32) for x in side["marks"]] for side in (asked, others))
    best: dict[tuple[int, int], tuple] = {}
    if a and b:
        for q, m, offset, shared in zip(*(x.tolist() for x in _bars(a, b))):
            start, stop = max(0, -offset), min(len(a[q]), len(b[m]) - offset)
            if stop - start >= MIN_OVERLAP:
                wrong = int(np.bitwise_count((a[q][start:stop] ^ b[m][start + offset : stop + offset]).view(np.uint32)).sum())
                found = (round(wrong / (32 * (stop - start)), 6), offset, shared)
                if found[0] <= MAX_ERROR and found < best.get((q, m), (2.0,)):
                    best[q, m] = found
    ids_q, ids_m = asked["class_id"].tolist(), others["class_id"].tolist()
    rows = [(ids_q[q], ids_m[m], offset, shared, error) for (q, m), (error, offset, shared) in best.items()]
    return pd.DataFrame(rows, columns=["query_id", "match_id", "offset", "shared", "bit_error"])


def align(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Classes (class_id, marks) that are asked for against all: query_id, match_id (both class_ids), offset (position in the match
    of the query's start), shared (height of the bar), bit_error."""
    blocks = lambda df, size: int((df.agg(F.sum(F.size("marks"))).first()[0] or 0) // size) + 1
    n_q, n_m = blocks(asked, QUERY_MARKS), blocks(found, RECORD_MARKS)
    own = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("class_id", "marks", F.lit(True).alias("query"), own(n_q).alias("i"), every(n_m).alias("j"))
    right = found.select("class_id", "marks", F.lit(False).alias("query"), every(n_q).alias("i"), own(n_m).alias("j"))
    return left.unionByName(right).groupBy("i", "j").applyInPandas(_aligned, "query_id long, match_id long, offset int, shared long, bit_error double")


def _summary(marks: DataFrame, found: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    best = F.min(F.struct("bit_error", "query_id", "offset", "shared")).alias("best")
    linked = pairs.groupBy(F.col("match_id").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"), best)
    settled = found.drop("marks").join(linked, "class_id", "left")
    rows = marks.select("id").join(members.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").drop("of").join(settled, "class_id", "left")
    return rows.select(
        "id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.query_id").alias("best_query"), "best.offset", "best.shared", "best.bit_error",
    )


def search(marks: DataFrame, is_query) -> tuple[DataFrame, DataFrame]:
    """Recordings (id, marks) for which ``is_query`` holds against all: the alignments of ``align`` but those of a class with itself, and
    for each recording id, class_id, class_size, n_links (classes with a query that its class aligns with), and the best of them:
    best_query, offset, shared, bit_error. Copies aren't expanded into pairs, and no alignment is left out."""
    marks = cut(marks)
    found, members = classes(marks)
    wanted = members.where(is_query(F.col("id"))).select("class_id").distinct()
    pairs = cut(align(found, found.join(wanted, "class_id", "left_semi")).where("query_id <> match_id"))
    return pairs, _summary(marks, found, members, pairs)


def lookup(marks: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``search``, for queries (id, marks) that are recordings of their own, such as excerpts; best_query is the smallest id of the
    queries with that fingerprint."""
    marks = cut(marks)
    found, members = classes(marks)
    pairs = cut(align(found, classes(cut(asked))[0]))
    return pairs, _summary(marks, found, members, pairs)


def melody(vector: np.ndarray | None, note: int = HOP) -> np.ndarray:
    """A recording made from a vector, as these tables hold no sound: a note for each component, its pitch from the component's value."""
    values = np.nan_to_num(np.asarray(vector if vector is not None else [], np.float32))
    pitch = np.clip(np.round(values * 24), -18, 18)
    hertz = np.repeat(440.0 * 2 ** (pitch / 12), note)
    return np.sin(2 * np.pi * np.cumsum(hertz) / RATE).astype(np.float32)


def hiss(samples: np.ndarray, level: float) -> np.ndarray:
    """The samples under noise of the given deviation, a fixed function of the samples."""
    return samples + level * np.random.default_rng(zlib.crc32(samples.tobytes())).standard_normal(len(samples)).astype(np.float32)


def recordings(vectors: DataFrame, noise: float = 0.0) -> DataFrame:
    """(id, vector) to (id, marks): the sound is made and fingerprinted in one step, as it is large and short-lived."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fingerprint(hiss(melody(v), noise) if noise else melody(v)).view(np.int32))

    return vectors.select("id", run("vector").alias("marks"))
