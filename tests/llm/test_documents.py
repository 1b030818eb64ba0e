"""Operators over documents against plain Python, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

LONG = "word " * 40_000 + "end."
ROWS = [
    (1, "The same  text\nhere"), (2, "The same text here"), (3, None), (4, ""), (5, " \t"), (6, LONG), (7, LONG + "x"), (8, "a@b.co_x@y.zé 1.2.3.4.5.6.7.8 +49 (30) 1234-5678"),
    (9, "4111 1111 1111 1111 and 300.1.1.1, 4111-1111-1111-1112"), (10, "$$$ a | b \\| c " * 50), (10, "$$$ a | b \\| c " * 50), (None, "no id here at all"), (12, "日本語 テスト。 é́ x² Straße ﬁ"),
    (13, "one two three"), (14, "ONE TWO THREE"), (15, "x" * 3000),
]


#: Columns of the caller with names that operators use themselves.
CLASHES = [f"'own {c}' AS {c}" for c in ("digest", "keep_id", "source", "row", "id", "node", "place", "heavy", "winner", "copies", "spans", "marks", "New", "email", "Base", "candidates", "component", "__digest", "edits", "lengths")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *CLASHES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _untouched(df):
    """Whether the caller's own columns came back as they were."""
    return all(r[c] == f"own {c}" for r in df.collect() for c in df.columns[2:])


def test_exact_groups(docs, empty):
    from leafwork.llm.exact_dedup import drop_exact_copies, exact_groups

    got = exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t in ROWS if i == r.doc_id)
        same = [i for i, t in ROWS if _norm(t) == _norm(text)]
        assert (r.group_size, r.keep_id) == (len(same), min((i for i in same if i is not None), default=None))
        assert r.text_sha256 == hashlib.sha256(_norm(text).encode()).hexdigest()
    assert sum(r.kept for r in got) == len({_norm(t) for _, t in ROWS})
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns and _untouched(left)
    assert sorted(_norm(r.text) for r in left.collect()) == sorted({_norm(t) for _, t in ROWS})
    assert exact_groups(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(fps, links):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if links(fps[i], fps[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_groups(docs, empty):
    from leafwork.llm import near_copies
    from leafwork.llm.simhash import drop_near_copies, near_groups

    got = near_groups(docs).collect()
    rows = sorted(((r.doc_id, r.fingerprint) for r in got), key=str)
    assert rows == sorted(((i, f"{_fingerprint(t):016x}") for i, t in ROWS), key=str)
    fps = [int(r.fingerprint, 16) for r in got]
    part = _components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for r, p in zip(got, part):
        assert r.component_id == min((g.doc_id for g, q in zip(got, part) if q == p and g.doc_id is not None), default=None)
    assert near_groups(empty).count() == 0
    for left in (drop_near_copies(docs), near_copies.drop_near_copies(docs)):
        assert left.columns == docs.columns and _untouched(left)


def test_covering_finds_planted_links(spark):
    """Chains of fingerprints 1 to 5 bits apart, one large ball and random ones, compared with all pairs."""
    from leafwork.llm import simhash as S
    from leafwork.llm.components import connected_components

    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 2**63, 150)]
    fps = list(base)
    for x in base[:80]:
        for _ in range(int(rng.integers(1, 5))):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [base[0] ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    S.HOMES, S.GUESTS, kept = 64, 128, (S.HOMES, S.GUESTS)  # small blocks, so that buckets are cut
    try:
        found = {r.node: r.component for r in connected_components(S.near_links(reps)).collect()}
    finally:
        S.HOMES, S.GUESTS = kept
    assert [found.get(i, i) for i in range(len(fps))] == _components(fps, lambda a, b: (a ^ b).bit_count() <= 4)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii(spark, docs, empty):
    from leafwork.llm.pii import fit, redact, report

    odd = ["a" * 20_000, "1" * 5000, "1.2.3.4" * 300, "a@b" * 2000 + ".c", "+1" * 3000, "a.b@c.d." * 400, "call 555-123-4567 or ssn 123-45-6789", "order no. 555-123-4567", "1 " * 4000]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    texts = {**dict(ROWS), **{100 + i: t for i, t in enumerate(odd)}}
    got = report(docs.select("doc_id", "text").unionByName(more)).collect()
    for r in got:
        want = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k, _ in KINDS]
    spans = {r.doc_id: r.spans for r in got}
    assert "phone_local:5:17" in spans[106] and "national_id:25:36" in spans[106] and spans[107] == ""
    new = {r.doc_id: r.text for r in redact(more).collect()}
    assert new[106] == "call [PHONE_LOCAL] or ssn [NATIONAL_ID]" and new[107] == odd[7] and new[100] == odd[0]
    assert redact(docs).columns == docs.columns and _untouched(redact(docs))
    long = "x" * 80 + " at acme dot org"
    spelled = report(spark.createDataFrame([(1, "contact " + long)], "doc_id long, text string")).first().spans
    assert spelled == f"email_spelled:8:{8 + len(long)}"
    assert fit(spark) == fit(spark) and report(empty).count() == 0


def test_ids_equal_the_library():
    """Authored texts, special strings and both whole tables of texts, against the library loaded as its README shows."""
    import duckdb
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from leafwork.llm.tokens import byte_words, ended_words

    texts = [t or "" for _, t in ROWS] + ["a   b \n c", "  x \n\n y  ", "İ ŉ ς ΑΣ don't WE'LL ½", "\x1c a\x1d", "  x　y", "<|endoftext|> a", "a<|startoftext|>b <|endoftext|>", "w" * 900]
    for name, column in (("documents", "text"), ("pages", "html")):
        texts += [t or "" for (t,) in duckdb.sql(f"SELECT {column} FROM '/root/testdata/sf0.01/{name}.parquet'").fetchall()]
    for file, encode in (("byte_bpe_50k.json", byte_words()), ("word_bpe_49k.json", ended_words())):
        library = Tokenizer.from_file(P.path(file))
        library.encode_special_tokens = True
        for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert encode(t).tolist() == want.ids, (file, t[:50])


def test_packing(docs, empty):
    from leafwork.llm.packing import pack
    from leafwork.llm.tokens import byte_words

    got = pack(docs).toPandas()
    assert got.doc_tokens.max() > 40_000 and pack(empty).count() == 0
    ids = {i: np.append(byte_words()(t or ""), 1).astype("<u4") for i, t in ROWS}
    for r in got.itertuples():
        own = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(len(ids[i]) for i, _ in ROWS)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == s.length.cumsum().to_numpy() - s.length.to_numpy()).all() and s.length.sum() <= 2048


def test_best_cuts_against_all_choices():
    from leafwork.llm.packing import best_cuts

    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.concatenate(([0], np.cumsum(rng.integers(1, 5, 9))))
        penalty = rng.integers(0, 4, 10)
        cost = {0: 0}
        for i in range(1, 10):
            cost[i] = min(cost[j] + 6 + int(penalty[i]) for j in range(i) if cuts[i] - cuts[j] <= 6)
        ends = [0, *best_cuts(cuts, penalty, 6, True)]
        at = [int(np.flatnonzero(cuts == e)[0]) for e in ends]
        assert at[-1] == 9 and all(b - a <= 6 for a, b in zip(ends, ends[1:]))
        assert sum(6 + int(penalty[i]) for i in at[1:]) == cost[9]


def test_wavelet_matrix():
    from leafwork.llm.wavelet import WaveletMatrix, build

    ids = np.random.default_rng(1).zipf(1.4, 3000).clip(0, 49_407).astype(np.uint16)
    m = WaveletMatrix(build(ids, [(1, 1000), (None, 2000)], 3, 17))
    assert (m.all() == ids).all() and m.docs == [(1, 1000), (None, 2000)] and m.head["first"] == 17
    for i in (0, 1, 63, 64, 1999, 2999):
        assert m.access(i) == ids[i]
    for v in (1, 2, 9, 400, 60_000, 2**20):
        at = np.flatnonzero(ids == v)
        assert m.count(v) == len(at) and m.count(v, 50, 700) == ((at >= 50) & (at < 700)).sum()
        assert [m.find(v, k) for k in range(min(5, len(at)))] == at[:5].tolist()
    assert WaveletMatrix(build(np.zeros(0, np.uint16), [])).all().tolist() == []
    with pytest.raises(ValueError):
        WaveletMatrix(b"other bytes here")


def test_token_files(docs, empty):
    from leafwork.llm.tokens import ended_words
    from leafwork.llm.wavelet import round_trip

    got = round_trip(docs).toPandas().sort_values("start")
    ids = {i: np.append(ended_words()(t or ""), 2).astype("<u4") for i, t in ROWS}
    assert got.doc_id.isna().to_numpy()[0] and got.doc_id.iloc[1:].is_monotonic_increasing and len(got) == len(ROWS)
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all() and round_trip(empty).count() == 0
    for r in got.itertuples():
        own = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(own.tobytes()))


def test_pieces(docs, empty):
    import public_tokenizers as P
    import sentencepiece

    from leafwork.llm.pieces import BLANK, boundary_states, combine, decode, encode, pieces

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    model = pieces()
    assert encode(empty).count() == 0
    for chunk in (32_768, 1500):
        encoded = encode(docs, chunk=chunk)
        ids, back = {}, {}
        for r in sorted(encoded.collect(), key=lambda r: (str(r.doc_id), r.chunk)):
            ids.setdefault((r.doc_id, r.chunk), r.ids)
        for r in decode(encoded).collect():
            back[r.doc_id, r.chunk] = r.text
        for i, t in ROWS:
            own = sorted(k for d, k in ids if d == i)
            assert np.frombuffer(b"".join(ids[i, k] for k in own), "<u2").tolist() == library.encode(t or "")
            assert "".join(back[i, k] for k in own) == (t or "")
    tree = {(r.doc_id, r.chunk): r.ids for r in encode(docs, chunk=700, fan=3).collect()}  # several levels of products
    for i, t in ROWS:
        own = sorted(k for d, k in tree if d == i)
        assert np.frombuffer(b"".join(tree[i, k] for k in own), "<u2").tolist() == library.encode(t or "")
    shown = BLANK + "aaa bbbccc   ddd".replace(" ", BLANK)
    m = [model.transfer(shown[max(0, k - 16) : k + 3 + 16], min(k, 16), min(k, 16) + min(3, len(shown) - k)) for k in range(0, len(shown), 3)]
    assert combine(combine(m[0], m[1]), m[2]) == combine(m[0], combine(m[1], m[2]))
    ((entry, (leave,)),) = reduce(combine, m).items()
    assert len(boundary_states(m, entry, leave)) == len(m) + 1
    assert model.decode(np.array([model.bytes[0xFF], model.bytes[0xC3]])) == "\ufffd\ufffd"


def test_counts_follow_edits(spark, docs, empty):
    from leafwork.llm.edits import CountedText, attach_edits, count_trees, edit_trees, store_trees
    from leafwork.llm.tokens import byte_words

    words, rng = byte_words(), np.random.default_rng(2)
    alphabet = list("ab c  \n'sÉ1.　\t")
    for _ in range(300):
        text = "".join(rng.choice(alphabet, int(rng.choice([0, 1, 5, 80, 900]))))
        counted = CountedText(text, words)
        for _ in range(4):
            a = int(rng.integers(0, len(text) + 1))
            b = min(len(text), a + int(rng.choice([0, 1, 4, 60])))
            new = "".join(rng.choice(alphabet, int(rng.choice([0, 1, 7]))))
            counted.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert counted.text() == text and counted.total == len(words.encoding.encode_ordinary(text))
            if rng.random() < 0.3:  # stored and taken up again
                counted = CountedText(text, words, counted.stored())
    edits = spark.createDataFrame([(6, 2, 0, 0, "x "), (6, 1, 10, 5000, None), (3, 1, 0, 9, "new"), (99, 1, 0, 0, "lost")], "doc_id long, seq int, start int, stop int, replacement string")
    trees = store_trees(docs)
    got = {r.doc_id: r for r in edit_trees(attach_edits(trees, edits)).collect()}
    after = "x " + LONG[:10] + LONG[5000:]
    assert got[6].tokens_after == len(words.encoding.encode_ordinary(after)) and got[6].chars_after == len(after) and got[6].chars_encoded_again < 600
    assert got[6].text == after and got[3].tokens_after == len(words.encoding.encode_ordinary("new")) and got[13].tokens_before == got[13].tokens_after
    again = spark.createDataFrame([(6, 1, 0, 2, None)], "doc_id long, seq int, start int, stop int, replacement string")
    twice = edit_trees(attach_edits(edit_trees(attach_edits(trees, edits)), again), keep_trees=False).where("doc_id = 6").first()
    assert (twice.tokens_before, twice.tokens_after) == (got[6].tokens_after, len(words.encoding.encode_ordinary(after[2:]))) and twice.chars_encoded_again < 100
    assert attach_edits(docs, edits).columns == [*(c for c in docs.columns if c != "edits"), "edits"]
    assert edit_trees(attach_edits(count_trees(empty), edits)).count() == 0


def test_registered_edits(spark, docs, tmp_path):
    """The registered query against whole encodings of the edited texts."""
    from leafwork.llm.queries import op10_token_counts
    from leafwork.llm.tokens import byte_words

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    count = lambda t: len(byte_words().encoding.encode_ordinary(t))
    want = []
    for i, t in ROWS:
        new, n = t or "", len(t or "")
        new = new[: n // 3] + " two new words" + new[n // 3 :]
        new = new[: n // 2] + "other words " + new[n // 2 + 12 :]
        want.append((i, count(t or ""), count(new[: max(0, len(new) - 5)])))
    got = [(r.doc_id, r.tokens_before, r.tokens_after) for r in op10_token_counts(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def _buckets(text, X):
    """The buckets of a text, n-gram by n-gram."""
    out, text = set(), f" {text.lower()} "
    for n in X.SIZES:
        for i in range(len(text) - n + 1):
            h = ord(text[i])
            for c in text[i + 1 : i + n]:
                h = h * 0x01000193 % 2**32 ^ ord(c)
            out.add((h ^ h >> 15) * (0x9E3779B1 + 2 * n) % 2**32 >> 32 - X.BITS)
    return out


def test_toxicity(spark, empty):
    from leafwork.llm import toxicity as X

    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    rows = []
    for i in range(900):
        words = rng.choice(vocabulary, 40).tolist()
        toxic = int(i % 6 == 0)
        if toxic:
            words[int(rng.integers(0, 40))] = str(rng.choice(["zgrumbly", "kwidget"]))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (5000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held == [i for i, _, _ in rows if got[i].held_out] and not got[None].held_out
    assert sum(got[i].predicted == rows[i][2] for i in held) / len(held) > 0.97
    assert got[None].score == got[5000].score
    kept = X.drop_toxic(docs.selectExpr("*", "1 AS score"), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r.predicted == 0 for r in got.values())
    weights, b = model
    for i in held[:20]:  # a plain model over the same weights
        found = _buckets(dict((i, t) for i, t, _ in rows)[i], X)
        z = b + sum(weights[k] for k in found)
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-5
    assert 0 < (weights != 0).sum() <= X.FEATURES
    # The fit against its definition: ratios from plain counts, and a penalised loss whose slope is zero in every weight.
    train = [(_buckets(t, X), y) for i, t, y in rows if i not in held]
    counts = [np.full(X.BUCKETS, 1.0), np.full(X.BUCKETS, 1.0)]
    for found, y in train:
        counts[y][list(found)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    off = [(1 / (1 + math.exp(-(b + sum(float(weights[k]) for k in found)))) - y, found) for found, y in train]
    assert abs(sum(e for e, _ in off)) < 0.05
    for k in np.flatnonzero(weights)[:: max(1, int((weights != 0).sum()) // 40)]:
        assert abs(sum(e for e, found in off if k in found) * ratio[k] + X.PENALTY * weights[k] / ratio[k]) < 0.05
    parts, X.STRETCH = X.STRETCH, 50
    try:
        assert set(X.Buckets()(rows[0][1]).tolist()) == _buckets(rows[0][1], X)
    finally:
        X.STRETCH = parts
    again = X.sample(docs.unionByName(docs).unionByName(docs), labels)
    assert again.count() == X.sample(docs, labels).count() == 900 - len(held)
    none = X.fit(docs, labels.where("false"))
    assert {round(r.score, 6) for r in X.score(docs, none).collect()} == {0.5} and X.score(empty, model).count() == 0
