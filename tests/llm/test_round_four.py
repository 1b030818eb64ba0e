"""The pipeline's near-duplicate stage goes by the covering code first."""


def test_stage_goes_through_the_anchors(spark, monkeypatch):
    from leafwork.llm import near_copies as N

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:399] + ["other"]), " ".join(reversed(words)), "alone", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, covered = [], N.covered_pairs
    monkeypatch.setattr(N, "covered_pairs", lambda d: pairs.append(covered(d)) or pairs[-1])
    found = []
    links = N._links
    monkeypatch.setattr(N, "_links", lambda p, *rest: found.append((p.count(), links(p, *rest))) or found[-1][1])
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == [0, 2, 3, 4]
    assert len(pairs) == 1 and found[0][0] == 1 and found[1][0] == 0  # the pair came from the anchors, and later steps had nothing left to do
