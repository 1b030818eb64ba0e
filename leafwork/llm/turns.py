"""Repair of the role structure of conversations by a fold over sorted turns that carries four (cost, audit) structs.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. The four states of that grammar
are: nothing yet, system said, user said, assistant said. Per state the fold keeps the cheapest edits, ties going to the audit that
is least in ASCII; ``least`` over structs compares both. Two audits of one state, place and cost are never prefixes of one another
(the longer one would have paid for more inserted turns), so what is least now stays least whatever follows.

Turns are numbered inside their conversation and cut into blocks of ``BLOCK``. A block is collected, sorted and folded by
``aggregate`` from each state it may begin in (one for a conversation's first block); blocks combine ``FAN`` at a time, level by level,
and the best way down gives each block the states between which it is edited. So a conversation of any length is never one array,
apart from its audit, which is one value of the result. The hash of a repaired conversation depends on all its text in order:
rows are shuffled by conversation, sorted with spilling, and streamed through one digest.

Defined cases: a null role or text is one blank, and so are a null ``conv_id`` and ``turn`` in the damage's key; rows with a null ``turn`` come
first and don't count for gaps; rows of one turn go by role, then by the SHA-256 of role and text; equal rows are copies of which all but
the first are duplicates; a null ``conv_id`` is a conversation; a role counts by its first letter, and one other than s, u, a can't be
kept; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import let
from leafwork.llm.common import cut
from leafwork.llm.ordering import group_key, number

#: Turns of a block, blocks that combine at a time.
BLOCK, FAN = 256, 64
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = r"\x20\x09-\x0D"
WAY = "struct<cost:bigint,audit:string>"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    ``.!?``, 3 repeats it, 4 makes its role user. Nulls of role and text become one blank."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    kept = rows.select(rows["conv_id"], rows["turn"], blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Damaged or raw rows to slim ones, numbered, with their first fault: conv, turn, initial, key, index, size, block, fault, illegal."""
    text = F.col("text")
    last = F.regexp_extract(text, rf"([^{WHITE}])[{WHITE}]*\z", 1)
    slim = rows.select(
        group_key(F.col("conv_id")).alias("conv"),
        "turn",
        "role",
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key"),
        F.when(last == "", "b").when(~last.isin(*".!?"), "t").otherwise("").alias("own"),
    )
    numbered = number(slim, "conv", ["turn", "role", "key"]).withColumn("initial", F.substring("role", 1, 1)).drop("role")
    numbered = cut(numbered.withColumn("block", F.floor(F.col("index") / BLOCK)))
    # The first of each (role, text) is found by a map-side combined aggregate and met by its place, so that no text is a hot key.
    first = numbered.groupBy("conv", "key").agg(F.min("index").alias("at")).select(F.col("conv").alias("of"), "at", F.lit(True).alias("first"))
    met = numbered.join(first, (F.col("conv") == F.col("of")) & (F.col("index") == F.col("at")), "left")
    fault = F.when(F.col("own") == "b", "b").when(F.col("first").isNull(), "d").otherwise(F.col("own"))
    met = met.select("conv", "turn", "initial", "key", "index", "size", "block", fault.alias("fault"))
    # A block's last row is also shown to the next block, where the window looks back at it.
    seen = F.when(F.col("index") % BLOCK == BLOCK - 1, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array(F.col("block")))
    shown = met.withColumn("seen", F.explode(seen))
    before = F.lag("initial").over(Window.partitionBy("conv", "seen").orderBy("index"))
    pair = shown.withColumn("before", before).where("seen = block").drop("seen")
    return pair.withColumn("illegal", F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).drop("before")


def _add(way: Column, cost: Column | int, letter: Column | str) -> Column:
    """``way`` one edit further; null if there is none."""
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.when(way.isNotNull(), F.struct((way["cost"] + cost).cast("bigint").alias("cost"), F.concat(way["audit"], letter).alias("audit")))


def _inserts(s: list[Column]) -> Column:
    """The four ways as an array, after turns that may be inserted here."""
    user = F.least(s[2], _add(F.least(s[0], s[1], s[3]), INSERT, "I"))
    return let(user, lambda u: F.array(s[0], s[1], u, F.least(s[3], _add(u, INSERT, "I"))))


def _step(ways: Column, row: Column) -> Column:
    """The ways after one more turn: deleted from every state, kept or given another role where the grammar lets it."""
    s = [F.get(ways, F.lit(i)) for i in range(4)]
    extra, free = F.when(row["fault"] == "t", TRUNCATED).otherwise(0), ~row["fault"].isin("b", "d")

    def say(way: Column, initial: str) -> Column:
        same = row["initial"] == initial
        return F.when(free, _add(way, extra + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R")))

    system = F.when(free & (row["initial"] == "s"), _add(s[0], extra, "K"))
    after = F.array(
        _add(s[0], DELETE, "D"),
        F.least(_add(s[1], DELETE, "D"), system),
        F.least(_add(s[2], DELETE, "D"), say(F.least(s[0], s[1], s[3]), "u")),
        F.least(_add(s[3], DELETE, "D"), say(s[2], "a")),
    )
    return let(after, lambda a: _inserts([F.get(a, F.lit(i)) for i in range(4)]))


def fold_turns(turns: Column, entry: Column) -> Column:
    """The ways through an array of turns (initial, fault), sorted, that begin in state ``entry``: an array by the state at the end."""
    none = F.lit(None).cast(WAY)
    start = [F.when(entry == i, F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))).otherwise(none) for i in range(4)]
    return F.aggregate(turns, _inserts(start), _step)


def _join_ways(acc: Column, piece: Column) -> Column:
    """Ways by (entry, exit) with the states passed, one piece further."""

    def through(row: Column, end: Column) -> Column:
        def via(mid: Column) -> Column:
            a, b = F.get(row, mid), F.get(F.get(piece, mid), end)
            return F.when(
                a.isNotNull() & b.isNotNull(),
                F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], end.cast("string")).alias("path")),
            )

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), via))

    return F.transform(acc, lambda row: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda end: through(row, end)))


def _combine(pieces: DataFrame) -> DataFrame:
    """(conv, piece, ways) to the same, ``FAN`` neighbours as one; the ways then carry ``path``, the state after each of them."""
    empty = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))
    none = F.lit(None).cast("struct<cost:bigint,audit:string,path:string>")
    unit = F.transform(F.col("entries"), lambda e: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.when(x == e, empty).otherwise(none)))
    grouped = pieces.withColumn("at", F.floor(F.col("piece") / FAN)).groupBy("conv", "at").agg(F.sort_array(F.collect_list(F.struct("piece", "ways"))).alias("parts"))
    # A conversation's first piece is only ever begun in state 0.
    known = grouped.withColumn("entries", F.when(F.col("at") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(3))))
    return known.select("conv", F.col("at").alias("piece"), F.aggregate(F.transform("parts", lambda p: p["ways"]), unit, _join_ways).alias("ways"))


def repair(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``flagged`` rows to (conv, cost, audit) and, per row that stays or has turns inserted before or after it,
    (conv, index, key, lead, role, tail): the inserted turns, and the new role or null. ``key`` is null where the row is deleted."""
    turns = F.sort_array(F.collect_list(F.struct("index", "initial", "fault", "key")))
    blocks = flags.groupBy("conv", "block").agg(turns.alias("turns"), F.max("size").alias("size"))
    begun = F.when(F.col("block") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(3)))
    blocks = cut(blocks.withColumn("ways", F.transform(begun, lambda e: fold_turns(F.col("turns"), e))))
    most = blocks.agg(F.max("block")).first()[0] or 0
    levels = [blocks.select("conv", F.col("block").alias("piece"), "ways")]
    while most > 0:
        levels.append(cut(_combine(levels[-1])))
        most //= FAN
    top = levels[-1].select("conv", "piece", "ways", F.get(F.col("ways"), F.lit(0)).alias("out"))
    ends = [F.when(F.get("out", F.lit(x)).isNotNull(), F.struct(*(F.get("out", F.lit(x))[f].alias(f) for f in ("cost", "audit")), F.lit(x).alias("state"))) for x in (0, 3)]
    best = top.withColumn("best", F.least(*ends))
    result = best.select("conv", "best.cost", "best.audit")
    chosen = best.select("conv", "piece", F.lit(0).alias("entry"), F.col("best.state").alias("exit"))
    for level in reversed(range(1, len(levels))):
        path = F.get(F.get("ways", F.col("entry")), F.col("exit"))["path"]
        known = levels[level].join(chosen, ["conv", "piece"]).select("conv", "piece", "entry", path.alias("path"))
        below = known.select("conv", "piece", "entry", "path", F.posexplode(F.split("path", "")).alias("place", "state")).where("state <> ''")
        chosen = below.select(
            "conv",
            (F.col("piece") * FAN + F.col("place")).alias("piece"),
            F.when(F.col("place") == 0, F.col("entry")).otherwise(F.substring("path", F.col("place"), F.lit(1)).cast("int")).alias("entry"),
            F.col("state").cast("int").alias("exit"),
        )
    edited = blocks.join(chosen.withColumnRenamed("piece", "block"), ["conv", "block"]).select(
        "conv", "entry", "turns", F.get(F.get("ways", F.col("entry")), F.col("exit"))["audit"].alias("audit")
    )
    return result, _edits(edited)


def _edits(edited: DataFrame) -> DataFrame:
    """The edits of each block's rows. A run of the audit is the turns inserted before a row and the row's own letter; turns inserted
    after the last row belong to it as its tail."""
    runs = F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0))
    tail = F.length(F.regexp_extract("audit", "I*$", 0))
    start = F.struct(F.col("entry").alias("state"), F.array().cast("array<struct<lead:string,role:string,kept:boolean>>").alias("out"))

    def said(state: Column) -> Column:
        return F.when(state == 2, 3).otherwise(2)

    def names(state: Column, n: Column) -> Column:
        """``n`` inserted turns from ``state`` on, each closed by a line feed."""
        own = F.when(state == 2, "assistant:\nuser:\n").otherwise("user:\nassistant:\n")
        one = F.when(state == 2, "assistant:\n").otherwise("user:\n")
        return F.concat(F.repeat(own, F.floor(n / 2).cast("int")), F.when(n % 2 == 1, one).otherwise(""))

    def moved(state: Column, n: Column) -> Column:
        return F.when(n == 0, state).otherwise(F.when(n % 2 == 1, said(state)).otherwise(said(said(state))))

    def step(acc: Column, x: Column) -> Column:
        letter, n = F.substring(x["run"], -1, 1), F.length(x["run"]) - 1

        def body(state: Column) -> Column:
            last = F.when(letter == "D", state).when((letter == "K") & (x["turn"]["initial"] == "s"), 1).otherwise(said(state))
            role = F.when(letter == "R", F.when(state == 2, "assistant").otherwise("user"))
            one = F.struct(names(acc["state"], n).alias("lead"), role.alias("role"), (letter != "D").alias("kept"))
            return F.struct(last.alias("state"), F.concat(acc["out"], F.array(one)).alias("out"))

        return let(moved(acc["state"], n), body)

    pairs = F.zip_with("turns", runs, lambda t, r: F.struct(t.alias("turn"), r.alias("run")))
    done = edited.withColumn("done", F.aggregate(pairs, start, step)).withColumn("tail", names(F.col("done.state"), tail))
    last = F.size("turns") - 1
    rows = done.select("conv", "tail", last.alias("last"), F.posexplode(F.arrays_zip("turns", F.col("done.out").alias("out"))).alias("place", "x"))
    tail_of = F.when(F.col("place") == F.col("last"), F.col("tail")).otherwise("")
    rows = rows.select("conv", "x.turns.index", F.when(F.col("x.out.kept"), F.col("x.turns.key")).alias("key"), "x.out.lead", "x.out.role", tail_of.alias("tail"))
    return rows.where("key IS NOT NULL OR lead <> '' OR tail <> ''")


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, said) in order to (conv, sha): one digest is open at a time; the last line feed of a conversation isn't hashed."""
    conv, digest, held = None, None, b""
    for batch in batches:
        done: list[tuple[str, str]] = []
        for c, said in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, held = c, hashlib.sha256(), b""
            data = said.as_buffer().to_pybytes()
            digest.update(held)
            digest.update(data[:-1])
            held = data[-1:]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([s for _, s in done], pa.string())], ["conv", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["conv", "sha"])


def said_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, index, said): the repaired turns as ``role:text`` lines, each closed by a line feed, in the order of ``index``."""
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # Rows of one conversation, role and text are interchangeable, and at most one of them stays.
    texts = rows.select(group_key(F.col("conv_id")).alias("of"), key.alias("found"), F.struct("role", "text").alias("own")).groupBy("of", "found").agg(F.first("own").alias("own"))
    met = edits.join(texts, (F.col("conv") == F.col("of")) & (F.col("key") == F.col("found")), "left")
    line = F.when(F.col("key").isNotNull(), F.concat(F.coalesce("role", "own.role"), F.lit(":"), "own.text", F.lit("\n"))).otherwise("")
    return met.select("conv", "index", F.concat("lead", line, "tail").alias("said"))


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation of the table: faults after ``damage``, cost and audit of the cheapest repair, and the repaired text's SHA-256."""
    rows = damage(conversations)
    flags = cut(flagged(rows))
    result, edits = repair(flags)
    count = lambda c: F.count_if(c).cast("long")
    faults = flags.groupBy("conv").agg(
        *(count(F.col("fault") == k).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        count(F.col("illegal")).alias("illegal"),
    )
    gaps = flags.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ordered = said_turns(rows, edits).repartition("conv").sortWithinPartitions("conv", "index").select("conv", F.col("said").cast("binary").alias("said"))
    hashes = ordered.mapInArrow(_stream_hashes, "conv string, sha string")
    own = conversations.select(conversations["conv_id"], group_key(conversations["conv_id"]).alias("conv")).distinct()
    all_of = reduce(lambda a, b: a.join(b, "conv", "left"), (faults, gaps, result, hashes), own)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_of.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
