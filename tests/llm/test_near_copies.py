"""Near copies of the pipeline's stage against all pairs in plain Python."""

import re

import numpy as np


def _shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _similarity(a, b):
    return len(a & b) / len(a | b)


def _left(rows):
    """The rows that stay: of each component the smallest doc_id, nulls last."""
    sets, part = [_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and _similarity(sets[i], sets[j]) >= 0.8:
                part = [part[i] if p == part[j] else p for p in part]
    return [min((rows[i] for i in range(len(rows)) if part[i] == p), key=lambda r: (r[0] is None, r[0])) for p in sorted(set(part))]


def _planted():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(2000)]
    line = " ".join(rng.choice(words, 40))
    rows, sims = [], []
    for i in range(60):
        own = rng.choice(words, int(rng.integers(30, 400))).tolist()
        rows.append((i, " ".join(own) + (" " + line if i % 3 == 0 else "")))
        for k in range(3):  # words changed one by one until a similarity between 0.75 and 0.95 is met
            goal, copy = float(rng.uniform(0.78, 0.97)), rows[i * 4][1].split()
            while _similarity(_shingles(" ".join(copy)), _shingles(rows[i * 4][1])) > goal:
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words))
            rows.append((1000 * (k + 1) + i, " ".join(copy)))
            sims.append(_similarity(_shingles(rows[-1][1]), _shingles(rows[i * 4][1])))
    assert sum(0.8 <= s < 0.95 for s in sims) > 100 and any(s < 0.8 for s in sims)
    return rows


def test_stage_finds_all_planted_near_copies(spark):
    import corpus_pipeline as P

    rows = _planted() + [(9000, None), (9001, " \n"), (9002, "One two"), (9003, "one  TWO"), (9004, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS `a.b`").repartition(5)
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in _left(rows))
    assert P.near_dedup(spark, docs.where("false"), "").count() == 0


def test_leads_are_not_compared_again(spark, monkeypatch):
    """Keys of which leads settle all pairs don't reach the blocks; links between a large key's other members are found there."""
    from leafwork.llm import near_copies as N

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulmnrst"), 7)) for _ in range(5000)]
    line = " ".join(rng.choice(words, 12))
    few = [(i, " ".join(rng.choice(words, 60)) + " " + line) for i in range(3)]
    many = [(i, " ".join(rng.choice(words, 60)) + " " + line) for i in range(10, 50)]
    many += [(i + 100, t.rsplit(" ", 13)[0] + f" w{i} " + line) for i, t in many]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(N, "covered_pairs", lambda d: N.store(none))
    monkeypatch.setattr(N, "COMMON", 1 << 40)  # the line's shingles are as good keys as any
    reached, unsettled = [], N._unsettled
    monkeypatch.setattr(N, "_unsettled", lambda members, *rest: reached.append(members.groupBy("key").count().agg({"count": "max"}).first()[0]) or unsettled(members, *rest))
    for rows, most in ((few, 0), (many, 78)):
        reached.clear()
        got = N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in _left(rows))
        assert len(reached) == 2 and (not reached[0] if most == 0 else 5 < reached[0] <= most)
