"""The near-duplicate stage asks the driver for no more queries than its links need: the driver keeps the plan of each."""

import random


def _least(edges):
    part = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and part[a] != part[b]:
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    return part


def _counted(monkeypatch, module, name):
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: calls.append(1) or plain(*a))
    return calls


def test_stars_are_seen_at_once(spark, monkeypatch):
    from leafwork.llm import components as C

    stored = _counted(monkeypatch, C, "store")
    for edges in ([], [(5, 1), (1, 7), (9, 1), (4, 3), (3, 3), (5, 1), (7, 1)]):
        stored.clear()
        found = C.connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(map(tuple, found.collect())) == sorted((n, p) for n, p in _least(edges).items() if n != p)
        assert len(stored) == 2


def test_components_of_other_shapes(spark):
    """Graphs that are nearly stars are not taken for them."""
    from leafwork.llm.components import connected_components

    rng = random.Random(5)
    shapes = [
        [(i, i + 1) for i in range(20)], [(3, 1), (3, 2)], [(2, 1), (3, 2)], [(1, 3), (2, 3), (2, 4), (1, 4)], [(9, 5), (8, 5), (7, 2), (9, 7)], [(-3, 4), (4, -7)],
        [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    ]
    edges = [(1000 * k + a, 1000 * k + b) for k, shape in enumerate(shapes) for a, b in shape]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((n, p) for n, p in _least(edges).items() if n != p)
    for shape in shapes[1:4]:
        found = connected_components(spark.createDataFrame(shape, "a long, b long"))
        assert sorted(map(tuple, found.collect())) == sorted((n, p) for n, p in _least(shape).items() if n != p)


def test_no_links_no_queries(spark, monkeypatch):
    """Where the anchors find the only link, the later steps neither make sets nor join parts again."""
    from leafwork.llm import near_copies as N

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:399] + ["other"]), " ".join(reversed(words)), "alone", None]
    joined, sets = _counted(monkeypatch, N, "connected_components"), _counted(monkeypatch, N, "_sets")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == [0, 2, 3, 4]
    assert len(joined) == 1 and len(sets) == 1
