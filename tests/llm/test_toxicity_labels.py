"""The toxicity classifier learns from every labelled row that isn't held out, however many there are."""

import zlib

import numpy as np


def _tables(spark, n):
    docs = spark.range(n).selectExpr("id doc_id", "concat('w', id % 97, if(id % 5 = 0, ' zgrumbly', ' plain'), id % 13) text")
    return docs, spark.range(n).selectExpr("id doc_id", "cast(id % 5 = 0 AS int) toxic")


def test_every_label_is_learnt_from(spark):
    from leafwork.llm import toxicity as X

    n = 12_000
    docs, labels = _tables(spark, n)
    twice = docs.unionByName(docs.where("doc_id < 50")).unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    learnt = X.sample(twice, labels.unionByName(labels.where("doc_id < 70")))
    free = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(free) > 8000
    assert learnt.count() == len(free) and learnt.where("toxic = 1").count() == sum(i % 5 == 0 for i in free)


def test_sums_by_tasks_and_by_the_driver(spark, monkeypatch):
    from leafwork.llm import toxicity as X

    docs, labels = _tables(spark, 600)
    weights, b = X.fit(docs, labels)
    monkeypatch.setattr(X, "KEPT", -1)
    by_tasks, c = X.fit(docs, labels)
    assert abs(b - c) < 1e-6 and np.allclose(weights, by_tasks, atol=1e-6) and (weights != 0).any()
