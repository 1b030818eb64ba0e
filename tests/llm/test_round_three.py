"""URL filter, Merkle manifest and conversation repair against plain Python, with nulls, ties, repeated rows and groups of several blocks."""

import hashlib
import random
import re
import zlib

import pytest

from leafwork.llm import merkle, turns, url_filter


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def page(target):
    return f'<html><head><link href="{target}" rel="canonical"></head>'


PAGES = [
    (1, "https://a.org/x", page("http://b.org/y")), (2, "http://b.org/y#f", page("HTTPS://WWW.Example.com/q")), (3, "https://z.net/es/1", '<meta http-equiv="Refresh" content="0; url=http://b.org/y?utm_source=1">'),
    (4, None, None), (5, "no scheme", ""), (6, "http://example.com/en/3", None), (7, "http://www.example.com/en/3", page("../../u/./v?x=1&amp;y=2")), (8, "http://www.example.com/u/v?x=1&y=2", "<!-- " + page("http://z.net/es/1") + " -->"),
    (9, "http://q.org", '<META HTTP-EQUIV=refresh CONTENT="5;URL=/fr/1">'), (10, "http://q.org/fr/1", "<link rel='canonical' href='//k.net/fr/1'>"), (11, "http://x.NET/fr/9", None), (12, "http://fr.com?x://y.net/es/", None),
    (1, "https://a.org/x", page("http://b.org/y")), (13, "http://lone.org/k", page("mailto:x@y")), (14, "http://lone.org/k2", page("#top")), (15, "http://moved.org/", None), (None, "http://" + "a." * 3000 + "net/es/", None),
]


def test_url_filter(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'own' AS host", "'own' AS verdict", "'own' AS node").repartition(3)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict, r.alias_blocked) for r in url_filter.report(df).collect()}
    assert url_filter.report(df).count() == len(PAGES) and url_filter.report(df.limit(0)).count() == 0
    # 1, 2 and 3 are one page, which net/es/ blocks; 9 and 10 are one, blocked by an alias that no row of the table has.
    assert got == {
        (1, "a.org", "/x", None, "block", True), (2, "b.org", "/y", None, "block", True), (3, "z.net", "/es/1", "net/es/", "block", True), (4, "", "", None, "allow", False), (5, "", "", None, "allow", False),
        (6, "example.com", "/en/3", "example.com/en/", "block", True), (7, "www.example.com", "/en/3", "www.example.com/en/", "allow", False), (8, "www.example.com", "/u/v", "com/", "allow", False),
        (9, "q.org", "", None, "block", True), (10, "q.org", "/fr/1", None, "block", True), (11, "x.net", "/fr/9", "net/fr/", "block", True), (12, "fr.com", "", None, "allow", False),
        (13, "lone.org", "/k", None, "allow", False), (14, "lone.org", "/k2", None, "allow", False), (15, "moved.org", "/", None, "allow", False), (None, "a." * 3000 + "net", "/es/", "net/es/", "block", True),
    }


def test_redirects_and_allow_precedence(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://moved.org", "http://x.net/fr/9"), ("http://www.example.com/en/3", "http://example.com/en/3"), (None, "http://a.b/")], "source string, target string")
    got = {r.page_id: (r.verdict, r.alias_blocked) for r in url_filter.verdicts(df, url_filter.rule_table(spark), moved).collect()}
    assert got[15] == ("block", True)
    # A rule that allows a URL outranks the block that an alias brings; 8 is allowed by com/ though 7 is its alias.
    assert got[7] == ("allow", True) and got[8] == ("allow", True) and got[13] == ("allow", False)


def test_long_alias_chain_and_hub(spark):
    """A chain of 200 redirects and a hub that 300 pages name as canonical; rules of several lengths, the same rule twice."""
    rows = [(i, f"http://c.org/{i}", page(f"http://c.org/{i + 1}")) for i in range(200)] + [(1000 + i, f"http://h{i}.org/", page("http://hub.info/")) for i in range(300)]
    rules = url_filter.rule_table(spark, [("c.org", "/200", "block"), ("info", "/", "block"), ("hub.info", "/", "allow"), ("h7.org", "/", "block"), ("c.org", "/5", "allow"), ("c.org", "/5", "block")])
    got = {r.page_id: r for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert all(got[i].verdict == ("allow" if str(i).startswith("5") else "block") for i in range(200))
    assert all(got[1000 + i].verdict == "block" for i in range(300)) and got[1007].rule == "h7.org/"


def plain_manifest(rows, fanout):
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            above, held = [], []
            for i in range(0, len(nodes), fanout):
                run = nodes[i : i + fanout]
                for j in range(len(run)):
                    for m in members[i + j]:
                        paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
                above.append(H(*run))
                held.append(sum(members[i : i + fanout], []))
            nodes, members = above, held
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    parts = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((own, *tree([leaf(r) for r in own])))
    root, uppers = tree([subroot for _, subroot, _ in parts])
    for (own, subroot, paths), upper in zip(parts, uppers):
        for r, path in zip(own, paths):
            now = list(r)
            if None not in (r[0], r[3]) and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now[3] += 1
            at = leaf(now)
            for a, b in path + upper:
                at = H(a, at, b)
            yield r[0], leaf(r), subroot, root, H(*(a + b for a, b in path + upper)), at, at == root


@pytest.mark.parametrize("fanout, levels", [(2, 10), (2, 2), (3, 2)])
def test_merkle(spark, monkeypatch, fanout, levels):
    langs = [None, "", "en", "é", "z", "lone"]
    rows = [(i if i % 9 else None, "s" if i % 4 else None, langs[i % 5 if i % 3 else 2], i if i % 6 else None, "é" * (i % 5) if i % 7 else None) for i in range(130)]
    rows += [(7, "s", "en", 1, "same")] * 40 + [(500, None, "lone", 3, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'own' AS leaf", "'own' AS grp", "'own' AS proof").repartition(5)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (fanout, levels))
    got = sorted((tuple(r) for r in merkle.report(df).collect()), key=str)
    assert got == sorted(plain_manifest(rows, fanout), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_merkle_small(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.report(df).count() == 0
    one = merkle.report(spark.createDataFrame([(3, "s", "en", 4, "text")], df.schema)).first()
    assert one.leaf == one.subroot == one.root == H("1:3", "1:s", "2:en", "1:4", "4:text") and one.proof_sha256 == H()


def plain_repair(rows):
    convs, blank = {}, lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        own = convs.setdefault(c, [])
        kind = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        r, x = blank(r), blank(x)
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    for c, own in convs.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(f"{len(z[1].encode())}:{z[1]}{z[2]}".encode()).digest()))
        numbers, seen, faults = [t for t, _, _ in own if t is not None], set(), []
        for _, r, x in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", x)
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        best = cheapest(own, faults)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        yield c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def cheapest(own, faults):
    """All ways by what was said last, one edit at a time."""

    def inserted(ways):
        todo = list(ways)
        while todo:
            s = todo.pop()
            cost, audit, out = ways[s]
            new = (cost + 5, audit + "I", (*out, "assistant:" if s == "u" else "user:"))
            to = "a" if s == "u" else "u"
            if to not in ways or new[:2] < ways[to][:2]:
                ways[to] = new
                todo.append(to)
        return ways

    ways = inserted({"": (0, "", ())})
    for (_, r, x), fault in zip(own, faults):
        found = []
        for s, (cost, audit, out) in ways.items():
            found.append((s, (cost + 2, audit + "D", out)))
            if fault not in ("b", "d"):
                extra, to = 5 * (fault == "t"), "a" if s == "u" else "u"
                if s == "" and r[:1] == "s":
                    found.append(("s", (cost + extra, audit + "K", (*out, f"{r}:{x}"))))
                if r[:1] == to:
                    found.append((to, (cost + extra, audit + "K", (*out, f"{r}:{x}"))))
                found.append((to, (cost + extra + 1, audit + "R", (*out, ("assistant:" if s == "u" else "user:") + x))))
        ways = {}
        for s, way in found:
            if s not in ways or way[:2] < ways[s][:2]:
                ways[s] = way
        ways = inserted(ways)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def conversations():
    rnd, rows = random.Random(3), []
    for c in [None, *range(150)]:
        for t in range(rnd.choice([0, 1, 2, 5, 9])):
            turn = rnd.choice([None, t, t, t + rnd.randint(0, 3), t])
            role = rnd.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant", "ü"])
            rows.append((c, turn, role, rnd.choice(["Hi.", "no end", "", " \t", "Hi.", "a b?\n", "x" * 500 + ".", None, "é!", f"Yes. {rnd.random()}."])))
    rows += [(1000, t if t % 7 else None, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Hi.", f"k{rnd.random()}", f"{rnd.random()}!"])) for t in range(600)]
    return rows + [(1001, 5, "user", "Again.")] * 50


@pytest.mark.parametrize("block, fan", [(256, 64), (4, 3)])
def test_turns(spark, monkeypatch, block, fan):
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns, "FAN", fan)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' AS conv", "'own' AS index", "'own' AS key").repartition(5)
    assert sorted((tuple(r) for r in turns.report(df).collect()), key=str) == sorted(plain_repair(rows), key=str)


def test_turns_dropped(spark):
    """Conversations of which nothing is left, and an empty table."""
    schema = "conv_id long, turn long, role string, text string"
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert tuple(turns.report(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", H())
    assert turns.report(spark.createDataFrame([], schema)).count() == 0


def test_many_matches_in_one_text(spark):
    """20,000 addresses and as many numbers in a text: linear work, every span found and masked."""
    import time

    from leafwork.llm import pii

    n, model = 20_000, pii.fit(spark)
    text = "".join(f"user{i}@mail{i}.example.com, call +49 30 {i:06d}12 é " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    spans = pii.find(df, model).first().spans
    assert len(spans) == 2 * n and all(text[s.start : s.end] == s.hit for s in spans)
    assert pii.redact(df).first().text == "[EMAIL], call [PHONE] é " * n
    assert time.time() - began < 60


def test_registered_lookup_of_excerpts(spark, tmp_path):
    """The registered query finds the recording that each excerpt comes from, at its offset, and what all pairs at all offsets hold."""
    import numpy as np

    from leafwork.llm import fingerprints as P
    from leafwork.llm.queries import op7_chroma

    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(64).astype(np.float32) / 8 for _ in range(900)]
    vectors[11], vectors[100][24:] = vectors[200], vectors[700][24:]  # a copy, and two recordings that share most of their sound
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r for r in op7_chroma(spark, str(tmp_path)).collect()}
    assert len(got) == 902 and got[900].n_links == got[901].n_links == 0
    for i in range(0, 900, 100):
        assert got[i].best_query == i and got[i].offset == 16 and got[i].bit_error < P.MAX_ERROR
    assert got[11].class_id == got[200].class_id == 11 and got[11].best_query == 200 and got[700].n_links == 2 and got[100].n_links == 2
    found = {k: 0 for k in got}
    marks = [P.fingerprint(P.melody(v)) for v in vectors]
    for i in range(0, 900, 100):
        q = P.fingerprint(P.hiss(P.melody(vectors[i][16:]), 0.5))
        for j, m in enumerate(marks):
            spans = ((max(0, -o), min(len(q), len(m) - o), o) for o in range(-len(q), len(m)))
            found[j] += any(b - a >= P.MIN_OVERLAP and np.bitwise_count(q[a:b] ^ m[a + o : b + o]).sum() <= P.MAX_ERROR * 32 * (b - a) for a, b, o in spans)
    assert all(got[k].n_links <= n for k, n in found.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(found.values()) and sum(found.values()) >= 12
