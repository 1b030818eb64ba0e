"""Near copies by an exact similarity join: two texts link if the Jaccard similarity of their shingle sets is 0.8 or more.

The first links are those of operator 9's method: SimHash fingerprints that the covering code's anchors bring together, each pair then
checked on the whole sets. They join most copies that differ little; fingerprints alone can't reach all links of this similarity, so
an exact join finds the rest. Its prefix filtering loses no link. Under any one order of all shingles, two sets of similarity t share a shingle among the
first n - ceil(t n) + 1 of each, n being the set's own size. The order here takes shingles that are rare in a sample first,
so that common lines seldom become keys; the sample changes the cost, never the result.

Of pairs that are in different parts by then, links of a key's members to five of them are checked next: four that come first in different orders, and the one whose own
keys are shared most, as the original of many copies is. They join most of a large group. Leads then leave their keys, as no
pair of theirs is unchecked, and so do keys with at most one other member. What is left are pairs of a key's other members
that are in different parts by then. Those are compared inside bounded blocks of sizes that may link, by maps of parities: bit h mod M says whether
an odd number of hashes fall there, and two maps differ in no more bits than the sets differ in shingles, so only pairs that
can't link are put aside. A block first yields a spanning forest of what passes; when its edges have been checked on the whole
sets, the blocks are run again over the parts that remain and yield all that passes. Every link between parts is found, and
the rows that move stay in proportion to the members of the keys.

Defined cases: words are split at ASCII white space and ASCII letters lower-cased; fewer words than a shingle make one
shingle; null and blank texts have one empty shingle and so are copies of each other; groups are connected components; the
kept row has the group's smallest doc_id, nulls last, and there is exactly one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import SLICE, map_batches, release, store
from leafwork.llm.components import connected_components, keep_one
from leafwork.llm.simhash import fingerprints, near_links, shingle_hashes

SHINGLE = 5
#: The least similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: Documents of the sample, counters of its shingles, and the count from which a shingle is no longer rare.
SAMPLE, COUNTERS, COMMON = 8000, 1 << 22, 4
#: Bits of the maps that spare most keys and texts without a candidate from being passed on.
BITS = 1 << 25
#: The largest side of a block: rows, and bytes of their maps.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Sizes of a band differ by less than this factor, which is above DEN / NUM by more than logarithms may be off.
BAND = 1.3


def _set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    hashes = np.unique(shingle_hashes(text, SHINGLE))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counters of shingles that are common in a sample, and their weights."""
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(1, docs.count())), 1).repartition(8)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for t in batch["text"]:
                counts[np.unique(_set(t) % COUNTERS)] += 1
        at = np.flatnonzero(counts > 1)
        yield {"at": at, "n": counts[at].astype(np.int64)}

    found = map_batches(sample, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    return found["at"].to_numpy(), np.log2(found["n"].to_numpy()).astype(np.uint8)


def _bits(rows: DataFrame, name: str) -> np.ndarray:
    """A map of bits, at most BITS / 8 bytes, that is set for every value of a long column, and for few others while it is sparse."""
    at, size = f"(pmod({name}, {BITS}) + 1)", 4096
    parts = rows.groupBy(F.expr(f"bitmap_bucket_number({at})").alias("k")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({at}))").alias("bits")).toArrow()
    bits = np.zeros(BITS // 8, np.uint8)
    for k, part in zip(parts["k"].to_pylist(), parts["bits"].to_pylist()):
        bits[(k - 1) * size : k * size] = np.frombuffer(part, np.uint8)
    return bits


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % BITS
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _keys(docs: DataFrame, at: np.ndarray, weights: np.ndarray, bits: np.ndarray | None = None) -> DataFrame:
    """key, node: the shingles of each set's prefix; with ``bits`` those that it marks, which share of the prefix they are, and the set's size."""
    shipped = docs.sparkSession.sparkContext.broadcast((at, weights, bits))  # COUNTERS numbers and BITS bits at most

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, weights, bits = shipped.value
        weight = np.zeros(COUNTERS, np.uint8)
        weight[at] = weights
        for batch in batches:
            keys, shares, n = [np.zeros(0, np.int64)], [], []
            for t in batch["text"]:
                own = _set(t)
                first = len(own) - (NUM * len(own) + DEN - 1) // DEN + 1
                key = own[np.lexsort((own, weight[own % COUNTERS]))[:first]].view(np.int64)
                keys.append(key if bits is None else key[_marked(bits, key)])
                shares.append(len(keys[-1]) / first)
                n.append(len(own))
            sizes = [len(k) for k in keys[1:]]
            repeat = lambda values, kind: np.repeat(np.array(values, kind), sizes)
            yield {"key": np.concatenate(keys), "node": repeat(batch["node"], np.int64), "share": repeat(shares, float), "n": repeat(n, np.int64)}

    return map_batches(docs.select("node", "text"), run, "key long, node long" + ", share double, n long" * (bits is not None))


def _sketches(docs: DataFrame) -> DataFrame:
    """node, n, odd: the size of each set and its map of parities, of four to eight bits a shingle."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [_set(t) for t in batch["text"]]
            widths = [max(256, 4 << (len(s) - 1).bit_length()) for s in sets]
            odd = [np.packbits(np.bincount((s % m).astype(np.int64), minlength=m) & 1).tobytes() for s, m in zip(sets, widths)]
            yield {"node": batch["node"], "n": [len(s) for s in sets], "odd": odd}

    return map_batches(docs.select("node", "text"), run, "node long, n long, odd binary").dropDuplicates(["node"])


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, set for all of ``nodes``, and for few others; texts are not shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bits(nodes, "node"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bits = shipped.value
        for batch in batches:
            kept = np.flatnonzero(_marked(bits, np.array(batch["node"], np.int64))).tolist()
            sets = [_set(batch["text"][i]) for i in kept]
            yield {"node": [batch["node"][i] for i in kept], "n": [len(s) for s in sets], "set": [s.tobytes() for s in sets]}

    return map_batches(docs.select("node", "text"), run, "node long, n long, set binary").dropDuplicates(["node"])


def _may_link(a: bytes, b: bytes, total: int) -> bool:
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (a, b)), key=len)
    differ = int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a))) ^ a).sum())
    return differ * (DEN + NUM) <= total * (DEN - NUM)


def _do_link(a: bytes, b: bytes, total: int) -> bool:
    same = total - len(np.union1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
    return same * DEN >= (total - same) * NUM


def _checked(pairs: DataFrame, sides: DataFrame, value: str, test) -> DataFrame:
    """Those of the pairs (a, b) that pass ``test`` on the values of both sides, sizes first."""
    side = lambda x: sides.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col(value).alias(f"v{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.greatest("na", "nb") * NUM <= F.least("na", "nb") * DEN)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["va"], batch["vb"], batch["total"].to_pylist())
            keep = [test(a.as_buffer(), b.as_buffer(), total) for a, b, total in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "va", "vb", (F.col("na") + F.col("nb")).alias("total")).mapInArrow(work, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    maybe = store(_checked(pairs, sketches, "odd", _may_link))
    if maybe.isEmpty():
        return maybe
    sets = store(_sets(docs, maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    links = store(_checked(maybe, sets, "set", _do_link))
    release(maybe, sets)
    return links


def _passing(block: list[tuple], cross: bool, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs (a, b) of different parts of a block that may link: all of them, or a spanning forest.

    A block holds (node, part, n, upper, own, odd). Pairs of two rows that aren't ``upper`` belong to another block, and so do
    those of one ``own`` where two sides meet."""
    block = sorted(block, key=lambda r: (r[2], r[0]))
    nodes, parts, sizes, uppers, owns, odds = (list(c) for c in zip(*block))
    maps, widths = [int.from_bytes(x, "big") for x in odds], [8 * len(x) for x in odds]
    for x in range(len(block)):
        most, narrow = sizes[x] * DEN // NUM, (1 << widths[x]) - 1
        for y in range(x + 1, len(block)):
            if sizes[y] > most:
                break
            if parts[x] == parts[y] or not (uppers[x] or uppers[y]) or (cross and owns[x] == owns[y]):
                continue
            other = maps[y] if widths[y] == widths[x] else (maps[y] >> widths[x]) ^ (maps[y] & narrow)
            if (other ^ maps[x]).bit_count() * (DEN + NUM) <= (sizes[x] + sizes[y]) * (DEN - NUM):
                yield min(nodes[x], nodes[y]), max(nodes[x], nodes[y])
                if forest:
                    parts = [parts[x] if p == parts[y] else p for p in parts]


def _unsettled(members: DataFrame, found: DataFrame, sketches: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of members of one key that are in different parts of the components ``found`` and may link.

    Two sets that link are in the same band of sizes or in neighbours; a row goes to its own band's group and to the next one's."""
    parts = found.withColumnRenamed("node", "k")
    placed = store(
        members.join(parts, F.col("node") == F.col("k"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"), F.floor(F.log(BAND, "n")).alias("band"))
        .distinct().select("key", "node", "n", "part", "band", F.explode(F.array("band", F.col("band") + 1)).alias("at"))
        .select("key", "at", "node", "part", "n", (F.col("band") == F.col("at")).alias("upper"))
    )
    same = [F.bit_xor(F.xxhash64("node", "upper")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node", "upper").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("c")]
    mixed = placed.groupBy("key", "at").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("upper").alias("any"), *same).where("any and low <> high")
    mixed = mixed.groupBy("x", "s", "c").agg(F.min(F.struct("key", "at")).alias("first")).select("first.*")  # groups with the same members are one
    left = store(placed.join(mixed, ["key", "at"], "left_semi"))
    most = F.sum(F.greatest("n", F.lit(32)))  # bytes of the maps at most; the maps themselves come when all else is known and are shuffled once
    bulk = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(most / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int").alias("own")
    blocks = (
        left.join(left.groupBy("key", "at").agg(bulk.alias("sides")), ["key", "at"]).select("*", own, F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("to"))
        .join(sketches.select("node", "odd"), "node")
        .select("key", "at", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "node", "part", "n", "upper", "own", "odd")
        .repartition("key", "at", "i", "j").sortWithinPartitions("key", "at", "i", "j")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))
        rows = (row for part in slices for row in zip(*(c.to_pylist() for c in part.columns)))
        pairs = (p for (_, _, i, j), block in groupby(rows, lambda r: r[:4]) for p in _passing([r[4:] for r in block], i != j, forest))
        while some := list(islice(pairs, 10 * SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], names=["a", "b"])

    pairs = store(blocks.mapInArrow(work, "a long, b long").distinct())
    release(placed, left)
    return pairs


def covered_pairs(docs: DataFrame) -> DataFrame:
    """(node, text) to pairs (a, b) that the anchors bring together: a forest over the fingerprints that link, and each fingerprint's nodes
    with the smallest of them."""
    prints = store(fingerprints(docs.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "fp").distinct())
    reps = store(prints.groupBy("fp").agg(F.min("node").alias("rep")))
    same = prints.join(reps, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = near_links(reps).unionByName(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = store(pairs)
    release(prints, reps)
    return pairs


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sides are in different parts of the components ``found``."""
    part = lambda x: found.select(F.col("node").alias(f"k{x}"), F.col("component").alias(f"p{x}"))
    both = pairs.join(part("a"), F.col("a") == F.col("ka"), "left").join(part("b"), F.col("b") == F.col("kb"), "left")
    return both.where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` after further links: their stars stand for the links before."""
    if links.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def near_components(docs: DataFrame) -> DataFrame:
    """(node, text) to (node, component) for all nodes that have a link."""
    sketches = store(_sketches(docs))
    covered = covered_pairs(docs)
    first = _links(covered, docs, sketches)
    found = connected_components(first)
    order = _common(docs)
    mixed = [0, -1, 0x5DEECE66D1A2B3C4, 0x2545F4914F6CDD1D]  # four orders of the nodes: their first ones lead a key
    leads = [F.min(F.struct(F.col("node").bitwiseXOR(F.lit(m)).alias("x"), "n")).alias(f"lead{i}") for i, m in enumerate(mixed)]
    shared = store(_keys(docs, *order).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    every = store(_keys(docs, *order, _bits(shared, "key")))
    led = every.groupBy(F.col("key").alias("k")).agg(*leads, F.max(F.struct("share", "node", "n")).alias("most"), F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high")
    heads = [F.struct(F.col(f"lead{i}.x").bitwiseXOR(F.lit(m)).alias("lead"), F.col(f"lead{i}.n").alias("size")) for i, m in enumerate(mixed)]
    led = store(led.select("k", "c", F.array_distinct(F.array(*heads, F.struct(F.col("most.node").alias("lead"), F.col("most.n").alias("size")))).alias("heads")))
    pairs = every.join(led.drop("c"), F.col("key") == F.col("k")).select("node", "n", F.explode("heads").alias("head")).select("node", "n", "head.*")
    pairs = (
        pairs.where("node <> lead").where(F.greatest("n", "size") * NUM <= F.least("n", "size") * DEN)  # no others can link
        .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    )
    seen = store(_apart(pairs, found))
    more = led.where(F.col("c") - F.size("heads") > 1).drop("c")  # of other keys, all pairs have a lead
    members = store(every.join(more, F.col("key") == F.col("k")).where(~F.array_contains("heads.lead", F.col("node"))).select("key", "node", "n"))
    release(shared, every, led)
    links = _links(seen, docs, sketches)
    found, tried = _joined(found, links), [covered, first, seen, links]
    seen = seen.unionByName(covered)
    for forest in (True, False):
        pairs = _unsettled(members, found, sketches, forest)
        fresh = store(pairs.join(seen, ["a", "b"], "left_anti"))
        links = _links(fresh, docs, sketches)
        found = _joined(found, links)
        seen, tried = seen.unionByName(pairs), [*tried, pairs, fresh, links]
    release(members, sketches, *tried)
    return found


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each group of near copies."""
    keyed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("text"), _node(docs["text"]).alias("node"))
    return keep_one(keyed.drop("text"), near_components(keyed.select("node", "text")))
