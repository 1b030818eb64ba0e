"""Fingerprints, WARC derivatives and the pipeline."""

import gzip
import hashlib
import struct

import numpy as np


def test_fingerprints_align(spark):
    from leafwork.llm import fingerprints as C

    rng = np.random.default_rng(0)
    tunes = [C.melody(rng.normal(0, 0.3, 64)) for _ in range(4)]
    noisy = tunes[0] + 0.1 * rng.standard_normal(len(tunes[0])).astype(np.float32)
    later = tunes[1][7 * C.HOP :]
    media = [(0, tunes[0]), (100, later), (1, tunes[0]), (2, noisy), (3, tunes[1]), (4, tunes[2]), (200, tunes[3]), (6, tunes[3] + 0.05 * rng.standard_normal(len(tunes[3])).astype(np.float32)), (300, []), (5, None)]
    rows = spark.createDataFrame([(i, None if s is None else [float(x) for x in s]) for i, s in media], "id long, samples array<float>")
    pairs, members = C.search(C.fingerprints(rows), lambda i: i % 100 == 0)
    got, of = {(r.query_id, r.match_id): r for r in pairs.collect()}, {r.id: r for r in members.collect()}
    assert set(got) == {(0, 2), (100, 3), (200, 6)} and set(of) == {i for i, _ in media}
    assert got[0, 2].offset == 0 and got[0, 2].bit_error < 0.05 and got[100, 3].offset == 7 and got[100, 3].bit_error == 0
    assert (of[1].class_id, of[1].class_size, of[2].n_links, of[2].best_query, of[0].n_links, of[300].class_id, of[5].n_links) == (0, 2, 1, 0, 0, None, 0)
    empty, none = C.search(C.fingerprints(rows.where("false")), lambda i: i % 100 == 0)
    assert empty.count() == none.count() == 0


def test_alignments_against_all_pairs(spark):
    """Recall against sliding every query over every recording at every offset, with blocks that are split."""
    from leafwork.llm import fingerprints as C

    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.3, 64) for _ in range(60)]
    vectors += [np.roll(v, int(rng.integers(-6, 7))) + rng.normal(0, rng.uniform(0, 0.05), 64) for v in vectors for _ in range(4)]
    marks = [C.fingerprint(C.melody(v)) for v in vectors] + [np.zeros(3000, np.uint32), np.zeros(2990, np.uint32)]
    rows = spark.createDataFrame([(i, m.view(np.int32).tolist()) for i, m in enumerate(marks)], "id long, marks array<int>")
    few = [m.view(np.int32) for m in [*marks[:12], marks[-1][:200], marks[-1][:150]]]
    whole = sorted(zip(*(x.tolist() for x in C._bars(few[::2], few))))
    kept = C.QUERY_MARKS, C.RECORD_MARKS, C.ENTRIES
    C.QUERY_MARKS, C.RECORD_MARKS, C.ENTRIES = 1000, 5000, 500
    try:
        assert sorted(zip(*(x.tolist() for x in C._bars(few[::2], few)))) == whole
        found = {(r.query_id, r.match_id): r.bit_error for r in C.search(rows, lambda i: i % 10 == 0)[0].collect()}
    finally:
        C.QUERY_MARKS, C.RECORD_MARKS, C.ENTRIES = kept
    want = {}
    for q in range(0, len(marks), 10):
        for m in range(len(marks)):
            a, b = marks[q], marks[m]
            if q == m or len(a) != 47 or len(b) != 47:
                continue
            errors = []
            for o in range(-(len(a) - C.MIN_OVERLAP), len(b) - C.MIN_OVERLAP + 1):
                x, y = a[max(0, -o) : len(b) - o], b[max(0, o) :]
                n = min(len(x), len(y))
                errors.append(int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n))
            if min(errors) <= C.MAX_ERROR:
                want[q, m] = min(errors)
    assert len(want) > 30 and sum(k in found for k in want) >= 0.95 * len(want)
    assert all(k in want for k in found if k[0] < 300 and k[1] < 300) and found[300, 301] == 0


def test_wave_files(spark):
    from leafwork.llm import fingerprints as C

    tune = C.melody(np.random.default_rng(1).normal(0, 0.3, 64)) * 0.6
    want = C.fingerprint(tune)

    def file(data, code, bits, channels=1, extra=b""):
        form = struct.pack("<HHIIHH", code, channels, C.RATE, C.RATE * channels * bits // 8, channels * bits // 8, bits) + extra
        return b"RIFF" + struct.pack("<I", 20 + len(form) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data

    wide = (tune * 2**31).astype("<i4")
    files = {
        1: file((tune * 32_767).astype("<i2").tobytes(), 1, 16), 2: file((tune * 127 + 128).astype("u1").tobytes(), 1, 8), 3: file(wide.tobytes(), 1, 32),
        4: file(wide.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes(), 1, 24), 5: file(tune.astype("<f4").tobytes(), 3, 32),
        6: file(np.repeat((tune * 32_767).astype("<i2"), 2).tobytes(), 1, 16, 2), 7: file((tune * 32_767).astype("<i2").tobytes(), 1, 16)[:-5001],
        8: b"no", 9: None, 10: file(b"", 1, 16), 11: file(b"abc", 85, 16), 12: b"RIFF\0\0\0\0WAVEfmt ",
    }
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in files.items()], "id long, content binary")
    got = {r.id: np.array(r.marks, np.int64).astype(np.uint32) for r in C.wav_fingerprints(rows).collect()}
    for i in range(1, 7):
        assert len(got[i]) == len(want) and np.bitwise_count(got[i] ^ want).sum() / 32 / len(want) < (0.2 if i == 2 else 0.05), i
    assert 0 < len(got[7]) < len(want) and all(len(got[i]) == 0 for i in range(8, 13))


def test_warc(spark, tmp_path):
    from leafwork.llm.warc import derive, read_warc, responses, write_warc

    html = "<html><title> A  b </title><body><script>x</script><p>One&amp;two<!-- no --><li>three <a href='x'>y</a></body>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (1, "http://a/", html)], "page_id long, url string, html string").selectExpr("*", "'z' AS block")
    records = derive(responses(pages))
    rows = records.where("page_id = 1 AND warc_type = 'conversion'").collect()
    assert [r.block for r in rows] == ["One&two\nthree y"] * 2 and rows[0].record_id == rows[1].record_id
    assert rows[0].source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and "text/html" in rows[0].source_headers
    meta = records.where("page_id = 1 AND warc_type = 'metadata'").first()
    assert meta.refers_to == rows[0].refers_to and "title: A b\r\nlinks: 1\r\n" in meta.block
    assert records.where("page_id = 2").count() == 2 and derive(responses(pages.where("false"))).count() == 0
    folder = f"file://{tmp_path}/w"
    write_warc(records, folder).collect()
    back = {(r.warc_type, r.record_id, r.refers_to, r.payload.decode()) for r in read_warc(spark, folder).collect()}
    assert back == {(r.warc_type, r.record_id, r.refers_to, r.block) for r in records.collect()}
    (tmp_path / "in").mkdir()
    http = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n<p>gone"
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9 \xfcber".encode("latin-1")
    record = lambda n, body, more=b"": b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (n, more, len(body), body)
    good = record(1, http, b"WARC-Payload-Digest: sha1:ABC\r\n")
    (tmp_path / "in/a.warc").write_bytes(good + b"WARC/1.0\r\nno length\r\n\r\n" + b"\r\n" + record(2, latin) + record(3, http)[:-20])
    packed = [gzip.compress(record(n, http)) for n in range(4, 8)]
    (tmp_path / "in/b.warc.gz").write_bytes(packed[0] + packed[1][:-30] + packed[2] + packed[3][:-25])
    source = read_warc(spark, f"file://{tmp_path}/in")
    faults = [(r.path[-1], r.error) for r in source.where("error is not null").collect()]
    assert sorted(x for x in faults if x[0] == "c") == [("c", "cut off inside the block"), ("c", "no Content-Length")]
    assert {x for x in faults if x[0] == "z"} >= {("z", "broken gzip member"), ("z", "cut off inside a gzip member")}
    got = {(r.warc_type, r.refers_to[10:-1]): r for r in derive(source).collect()}
    assert {n for _, n in got} == {"1", "2", "4", "6"}
    assert got["conversion", "1"].block == "gone" and got["metadata", "1"].block.startswith("status: 404\r\nsource-headers: HTTP/1.1 404 Not Found; X: y")
    assert got["metadata", "1"].declared_digest == "sha1:ABC" and "declared-digest: sha1:ABC\r\n" in got["metadata", "1"].block
    assert got["conversion", "2"].block == "café über" and got["conversion", "2"].source_digest == "sha256:" + hashlib.sha256(latin.partition(b"\r\n\r\n")[2]).hexdigest()


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() over small tables, stage by stage, against the operators' definitions in plain Python."""
    import corpus_pipeline as P
    from tests.llm.test_documents import _base, _fingerprint, _norm

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(400)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words, 60))
        if i % 8 == 0:
            text = text.replace(" ", " vileword ", 2)
        rows.append((i, text + (" mail me@here.org now" if i % 10 == 3 else "")))
    rows += [(300, rows[1][1].replace(" ", "  ")), (301, rows[2][1]), (302, None), (303, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    docs, states = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        states[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = dict(rows)
    toxic = {i for i in texts if i < 240 and i % 8 == 0}
    assert set(states["toxicity"]) == set(texts) - toxic
    kept = {}
    for i in sorted(states["toxicity"]):
        kept.setdefault(_norm(texts[i]), i)
    assert set(states["exact_dedup"]) == set(kept.values())
    left = []
    for i in sorted(states["exact_dedup"]):
        if all((_fingerprint(texts[i]) ^ _fingerprint(texts[j])).bit_count() > 4 for j in left):
            left.append(i)
    assert sorted(states["near_dedup"]) == left
    for i, t in states["pii"].items():
        assert t == (None if texts[i] is None else texts[i].replace("me@here.org", "[EMAIL]")) and (not t or not _base(t))
    got = P.run(spark, sf).toPandas()
    assert set(got.doc_id) == set(left) and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
