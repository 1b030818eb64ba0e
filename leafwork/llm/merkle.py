"""A Merkle manifest of a table: one leaf per row, a tree per group, a tree over the groups, and an inclusion proof per row.

Leaves are numbered inside their group and cut into superblocks of ``fanout ** LEVELS``. One call of ``applyInPandas`` folds a
superblock through that many levels; the superblocks' roots are the leaves of the next turn, until each group has one node. The same
reduction runs over the groups' roots. On the way back each superblock meets its root's proof and gives every member the siblings
it met inside, followed by that proof. No task ever holds more than one superblock, however large a group is, and only the
proofs of superblocks are stored.

A digest is the lower-case hex SHA-256 of its inputs in a row, digests as hex text. While a level has several nodes, each run of
``fanout`` neighbours becomes the digest of the run; the last run may be shorter, even a single node.

Defined cases: a null value is ``-`` in a leaf, an empty one ``0:``; null groups come first and are a group of their own; inside a
group null ids come first, rows of the same id go by their leaves, and rows that are equal in all of these are leaves of their own;
a row whose id is null isn't tampered with by ``tampered``; other columns don't enter a leaf; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafwork.llm.common import cut
from leafwork.llm.ordering import group_key, number

#: Nodes that become one, and levels that one superblock folds.
FANOUT, LEVELS = 2, 10
STEP = "struct<left:string,right:string>"


def leaf_digest(*values: Column) -> Column:
    """Digest of the values: each ``-`` if null, otherwise its number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold_block(nodes: list[str], size: int, fanout: int, levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """A block's root and, per node, the (left, right) siblings of each level. ``size`` is the number of nodes of the whole group:
    a block of one node is folded on while its group has others."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    for _ in range(levels):
        if size == 1:
            break
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for r, run in enumerate(runs):
            for i in range(len(run)):
                step = ("".join(run[:i]), "".join(run[i + 1 :]))
                for m in members[r * fanout + i]:
                    steps[m].append(step)
        members = [sum(members[i : i + fanout], []) for i in range(0, len(members), fanout)]
        nodes = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        size = -(-size // fanout)
    return nodes[0], steps


def climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """(grp, index, size, node, ...) to the tables of the superblocks' roots, turn by turn: the first is ``nodes``, the last has one node
    for each group. All have ``block``, the superblock a node is in."""
    width = fanout**levels

    def superblock(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        root, _ = fold_block(block["node"].tolist(), int(block["size"].iloc[0]), fanout, levels)
        return pd.DataFrame({"grp": block["grp"].iloc[:1], "index": block["block"].iloc[:1], "size": -(-block["size"].iloc[:1] // width), "node": root})

    placed = lambda df: df.withColumn("block", F.floor(F.col("index") / width))
    turns = [placed(nodes)]
    while (turns[-1].agg(F.max("size")).first()[0] or 1) > 1:
        slim = turns[-1].select("grp", "index", "size", "node", "block")
        turns.append(placed(cut(slim.groupBy("grp", "block").applyInPandas(superblock, "grp string, index long, size long, node string"))))
    return turns


def descend(turns: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``climb``'s first table with the columns of ``tops`` (grp, index, proof, ...), where proof is lengthened by each node's own steps.
    A superblock meets its root's row, so each proof is written whole where its lower part is made, and isn't shuffled."""
    carried = [f for f in tops.schema if f.name not in ("grp", "index")]

    def superblock(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("index")
        _, steps = fold_block(block["node"].to_pylist(), block["size"][0].as_py(), fanout, levels)
        upper = above.to_pylist()[0]
        for f in carried:
            own = [[{"left": a, "right": b} for a, b in s] + upper["proof"] for s in steps] if f.name == "proof" else [upper[f.name]] * block.num_rows
            block = block.append_column(f.name, pa.array(own, above.schema.field(f.name).type))
        return block

    for turn in reversed(turns[:-1]):
        schema = StructType([*turn.schema, *carried])
        right = tops.select("grp", F.col("index").alias("block"), *(f.name for f in carried))
        tops = turn.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(superblock, schema)
        if turn is not turns[0]:
            tops = cut(tops.select("grp", "index", *(f.name for f in carried)))
    if len(turns) == 1:  # groups of one node each
        known = tops.drop("index").withColumnRenamed("grp", "of")
        return turns[0].join(known, F.col("grp") == F.col("of")).drop("of")
    return tops


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(grp, id, leaf, ...) to the same rows with subroot, root and proof (steps from the leaf up to the root). ``grp`` is never null."""
    rows = cut(number(leaves, "grp", ["id", "leaf"])).withColumn("node", F.col("leaf"))
    turns = climb(rows, fanout, levels)
    subroots = cut(number(turns[-1].select(F.lit("").alias("all"), F.col("grp").alias("member"), "node"), "all", ["member"]))
    uppers = climb(subroots.select(F.col("all").alias("grp"), "index", "size", "node", "member"), fanout, levels)
    top = uppers[-1].first()
    start = uppers[-1].select("grp", "index", F.array().cast(f"array<{STEP}>").alias("proof"), F.lit(top and top.node).cast("string").alias("root"))
    proven = descend(uppers, start, fanout, levels).select(F.col("member").alias("grp"), F.lit(0).cast("long").alias("index"), "proof", F.col("node").alias("subroot"), "root")
    return descend(turns, cut(proven), fanout, levels).drop("node", "block")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof from the leaf's level up, left to right, as one string of hex digits."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def verify(proofs: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Rows of ``manifest`` with folded_root and verified, from the leaves of column ``leaf``."""
    return proofs.withColumn("folded_root", fold(F.col(leaf), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, grp, id, leaf, changed): the leaf of each document, and that of the document with 1 added to n_chars where the
    crc32 of its decimal doc_id is divisible by ``every``."""
    d = docs.select(*(docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    leaf = leaf_digest(*(F.col(c) for c in d.columns))
    # The same digest again unless something changes, so that texts are hashed twice only where they have to be.
    changed = F.when(hit & F.col("n_chars").isNotNull(), leaf_digest(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in d.columns)))
    return d.select("doc_id", group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("id"), leaf.alias("leaf"), changed.alias("changed"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, and what verification finds after tampering."""
    rows = manifest(tampered(docs)).withColumn("now", F.coalesce("changed", "leaf"))
    return verify(rows, "now").select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")
