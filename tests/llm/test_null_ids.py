"""Rows without a doc_id in near-duplicate groups."""


def test_rows_without_doc_id_survive_and_link(spark, monkeypatch):
    from leafwork.llm import simhash as S

    marks = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 2**63 + 2**40 - 1}
    monkeypatch.setattr(S, "fingerprint", lambda text, shingle=4, marks=marks: marks[text])
    fps = spark.createDataFrame([(i, S.fingerprint(t) - (2**64 if t == "d" else 0)) for i, t in ((1, "a"), (None, "b"), (2, "c"), (None, "d"), (None, "d"))], "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda docs, shingle=4: fps)
    ids = {r.fingerprint: r.component_id for r in S.near_groups(fps).collect()}
    assert sorted(ids.items()) == [("0" * 16, 1), ("0" * 14 + "0f", 1), ("0" * 14 + "ff", 1), ("800000ffffffffff", None)]


def test_one_row_of_each_group_stays(spark):
    from leafwork.llm.simhash import drop_near_copies

    rows = [(None, "a text of its own that nobody else has"), (None, "twice without any id at all here"), (None, "Twice without any id at all here"),
            (7, "one with an id and one without it"), (None, "one with an id and one without it"), (7, "another text under the very same number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text.lower()) for r in drop_near_copies(docs).collect())
    assert got == sorted({t.lower(): (i or 0, t.lower()) for i, t in reversed(rows)}.values())
