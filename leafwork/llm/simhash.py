"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``THRESHOLD`` or fewer differing bits. The anchors are the words of a covering code: the
linear code of length 64 whose words are Tr(a x) + Tr(b x^3) over the field of 64 elements, 4,096 words at distance 24 or
more. Let r(x) be the distance of x to its nearest anchor, its home. Of a linked pair take x with the smaller r: the other
lies within r(x) + THRESHOLD of x's home, so it is enough that each fingerprint is copied to every anchor within its own
r + THRESHOLD, and that homes are compared with these guests, anchor by anchor. No link is lost, whatever the code's
covering radius in the worst case. Large buckets are cut into a grid of bounded blocks, and a block yields the edges of a
spanning forest, never all its pairs.

Defined cases: null and blank texts have the fingerprint zero and link like any other; fewer words than a shingle make one
shingle; repeated rows share a fingerprint; a null doc_id gets the component of its fingerprint; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut, map_batches
from leafwork.llm.components import connected_components, keep_one

SHINGLE, THRESHOLD, SEED = 4, 4, 42
#: The largest block of homes and of guests that one task compares at a time.
HOMES, GUESTS = 2048, 16_384


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of a whole text, in the text's order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as an unsigned 64-bit number."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long. Texts are read once and not shuffled."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield {"doc_id": batch["doc_id"], "fp": fps.view(np.int64)}

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, "doc_id long, fp long")


def anchors() -> np.ndarray:
    """The 4,096 code words, ascending in (a, b)."""
    exp = [1]
    for _ in range(62):  # powers of a root of x^6 + x + 1
        exp.append((exp[-1] << 1) ^ (0b1000011 if exp[-1] & 32 else 0))
    log = {x: i for i, x in enumerate(exp)}
    times = lambda x, y: exp[(log[x] + log[y]) % 63] if x and y else 0

    def trace(x: int) -> int:
        total = 0
        for _ in range(6):
            total, x = total ^ x, times(x, x)
        return total & 1

    word = lambda f: sum(trace(f(x)) << x for x in range(64))
    line = [word(lambda x, a=a: times(a, x)) for a in range(64)]
    cube = [word(lambda x, b=b: times(b, times(x, times(x, x)))) for b in range(64)]
    return np.array([u ^ v for u in line for v in cube], np.uint64)


def _placed(batches: Iterator[pd.DataFrame], threshold: int, counted: bool) -> Iterator[pd.DataFrame]:
    code = anchors()
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.iloc[at : at + 512]
            fps = part["fp"].to_numpy(np.int64).view(np.uint64)
            away = np.bitwise_count(fps[:, None] ^ code[None, :])
            home, near = away.argmin(1), away.min(1)
            row, to = np.nonzero(away <= (near + threshold)[:, None])
            if counted:
                yield pd.DataFrame({"anchor": np.arange(len(code)), "h": np.bincount(home, minlength=len(code)), "g": np.bincount(to, minlength=len(code))}).query("g > 0")
            else:
                yield pd.DataFrame({"anchor": np.r_[home, to], "home": np.r_[np.ones(len(home), bool), np.zeros(len(to), bool)], "fp": np.r_[part["fp"].to_numpy(), part["fp"].to_numpy()[row]], "rep": np.r_[part["rep"].to_numpy(), part["rep"].to_numpy()[row]]})


def _forest(fp_h: np.ndarray, fp_g: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each home and guest of a block the index of the first home of its part, or -1 for guests without a link."""
    pairs = []
    for at in range(0, len(fp_h), 64):
        i, j = np.nonzero(np.bitwise_count(fp_h[at : at + 64, None] ^ fp_g[None, :]) <= threshold)
        pairs.append((i + at, j))
    i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    homes, guests = np.arange(len(fp_h)), np.full(len(fp_g), -1)
    if not len(i):
        return homes, guests
    order = np.argsort(j, kind="stable")
    cut_i, cut_j = np.flatnonzero(np.r_[True, np.diff(i) > 0]), np.flatnonzero(np.r_[True, np.diff(j[order]) > 0])
    while True:
        guests[j[order][cut_j]] = np.minimum.reduceat(homes[i[order]], cut_j)
        low = homes.copy()
        low[i[cut_i]] = np.minimum(low[i[cut_i]], np.minimum.reduceat(guests[j], cut_i))
        if (low == homes).all():
            return homes, guests
        homes = low


def near_links(reps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, rep) with distinct fp to edges (a, b) between reps that join all fingerprints that link."""
    counts = reps.mapInPandas(lambda it: _placed(it, threshold, True), "anchor long, h long, g long")
    grid = cut(
        counts.groupBy("anchor").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))
        .select("anchor", F.ceil(F.greatest("h", F.lit(1)) / HOMES).cast("int").alias("nh"), F.ceil(F.col("g") / GUESTS).cast("int").alias("ng"))
    )  # at most one row for each of the 4,096 anchors
    placed = reps.mapInPandas(lambda it: _placed(it, threshold, False), "anchor long, home boolean, fp long, rep long")
    spread = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    blocks = (
        placed.join(F.broadcast(grid), "anchor")
        .withColumn("i", F.explode(F.when(F.col("home"), F.array(spread("nh"))).otherwise(every("nh"))))
        .withColumn("j", F.explode(F.when(F.col("home"), every("ng")).otherwise(F.array(spread("ng")))))
        .drop("nh", "ng")
    )

    def link(block: pd.DataFrame) -> pd.DataFrame:
        home, guest = block[block["home"]], block[~block["home"]]
        rep_h, rep_g = home["rep"].to_numpy(), guest["rep"].to_numpy()
        first_h, first_g = _forest(home["fp"].to_numpy(np.int64).view(np.uint64), guest["fp"].to_numpy(np.int64).view(np.uint64), threshold)
        a = np.r_[rep_h, rep_g[first_g >= 0]]
        b = np.r_[rep_h[first_h], rep_h[first_g[first_g >= 0]]]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return blocks.groupBy("anchor", "i", "j").applyInPandas(link, "a long, b long")


def near_classes(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp) to (node, component) between fingerprints that link; a fingerprint stands for all its rows, with a doc_id or without."""
    return connected_components(near_links(cut(fps.select("fp", F.col("fp").alias("rep")).distinct()), threshold))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    fps = cut(fingerprints(docs, shingle))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = near_classes(fps, threshold)
    classes = cut(least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class")))
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = cut(classes.select(F.col("fp").alias("k"), "class").join(ids, "class").drop("class"))
    return fps.join(classes, F.col("fp") == F.col("k")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group: the smallest doc_id's, nulls last."""
    fp = F.pandas_udf(lambda texts: pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)), "long")
    keyed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), fp(docs["text"]).alias("node"))
    return keep_one(keyed, near_classes(keyed.select(F.col("node").alias("fp")), threshold))
