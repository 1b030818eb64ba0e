"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (3 to 7 code points, lower-cased) it holds, each counted once. Over the
labelled rows r = log((1 + documents with the n-gram, toxic) / their sum) - the same for the rest. A logistic regression with
a quadratic penalty is fitted on the features times r. Choosing features is part of the fit: the ``FEATURES`` buckets that tell
the two kinds apart most surely get a weight, all others none. Fitted on all buckets the same rows rank held-out rows
worse (the README has figures): n-grams of one or two documents then outweigh the telling ones. A model is one number for each
of ``BUCKETS`` hash buckets, whatever the corpus, and scoring reads each text once without a shuffle.

The fit uses every labelled row that isn't held out; its sums are taken part by part, so memory doesn't grow with the rows.

Defined cases: a null text counts as empty and gets the score of a text without n-grams; a doc_id labelled more than once
counts as toxic if any label says so; of rows that share a labelled doc_id the one with the smallest hash of its text is
learnt from; null labels are ignored; without labels of both kinds every score is the smoothed share of toxic labels;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut, map_batches

SIZES, BITS = (3, 4, 5, 6, 7), 20
BUCKETS = 1 << BITS
FEATURES, PENALTY, STEPS = 4096, 3.0, 8
#: Parts of the labelled rows: at least, at most, and rows for each; bytes of features that the driver sums by itself.
FIT_TASKS, MOST_PARTS, PART_DOCS, KEPT = 8, 32, 8000, 1 << 23
STRETCH = 1 << 18
THRESHOLD = 0.3


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    rolling, out = codes, [np.zeros(0, np.uint32)]
    for n in range(2, max(SIZES) + 1):
        rolling = rolling[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in SIZES:
            out.append((rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n) >> np.uint32(32 - BITS))
    return np.concatenate(out)


class Buckets:
    """The distinct buckets of whole texts, a stretch of ``STRETCH`` code points at a time."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        text = f" {(text or '').lower()} "
        if len(text) <= STRETCH:
            found = grams(text).astype(np.intp)
            at = np.arange(len(found), dtype=np.int32)
            self.last[found] = at  # one place for each distinct bucket, whatever stood there before
            return found[self.last.take(found) == at]
        seen = np.zeros(BUCKETS, bool)
        for at in range(0, len(text), STRETCH):
            seen[grams(text[at : at + STRETCH + max(SIZES) - 1])] = True
        return np.flatnonzero(seen)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of every labelled row that isn't held out, stored in parts that depend on the doc_ids only."""
    told = (
        labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumnRenamed("doc_id", "id")
    )
    parts = min(MOST_PARTS, max(FIT_TASKS, told.count() // PART_DOCS))
    # Rows that share a doc_id are combined where they are read, before the join, so that a hot one is never gathered.
    own = docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"])).select("doc_id", "text")
    first = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
    rows = first.join(told, first["doc_id"] == told["id"]).select("id", "toxic", F.col("first.text").alias("text"))
    return cut(rows.repartition(parts, "id").sortWithinPartitions("id").select("toxic", "text"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The buckets' weights and the intercept. A first pass over the labelled rows counts documents by bucket, a second one stores
    the chosen features of each document; the fit reads those part by part. The driver holds 2 x BUCKETS numbers and, of
    the features, KEPT bytes at most."""
    texts = sample(docs, labels)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        found, sizes, buckets = np.zeros((2, BUCKETS), np.uint32), [0, 0], Buckets()
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                found[int(toxic > 0)][buckets(text)] += 1
                sizes[int(toxic > 0)] += 1
        at = np.flatnonzero(found[0] + found[1]).astype("<u4")
        yield {"at": [at.tobytes()], "rest": [found[0][at].tobytes()], "toxic": [found[1][at].tobytes()], "n_rest": [sizes[0]], "n_toxic": [sizes[1]]}

    with_rest, with_toxic, n_rest, n_toxic = np.zeros(BUCKETS), np.zeros(BUCKETS), 0, 0
    # stored first, as the iterator would count one part after the other
    for row in cut(map_batches(texts, count, "at binary, rest binary, toxic binary, n_rest long, n_toxic long")).toLocalIterator():
        at = np.frombuffer(row["at"], "<u4")
        with_rest[at] += np.frombuffer(row["rest"], np.uint32)
        with_toxic[at] += np.frombuffer(row["toxic"], np.uint32)
        n_rest, n_toxic = n_rest + row["n_rest"], n_toxic + row["n_toxic"]
    kept = chosen_buckets(with_toxic, with_rest, n_toxic, n_rest)
    ratio = np.log((1 + with_toxic) / (1 + with_toxic).sum()) - np.log((1 + with_rest) / (1 + with_rest).sum())

    def features(batches: Iterator[dict]) -> Iterator[dict]:
        buckets = Buckets()
        for batch in batches:
            own = [np.flatnonzero(np.isin(kept, buckets(t), assume_unique=True)).astype("<u2") for t in batch["text"]]
            y, sizes = np.array([x > 0 for x in batch["toxic"]], np.uint8), np.array([len(x) for x in own], "<u4")
            yield {"y": [y.tobytes()], "sizes": [sizes.tobytes()], "own": [np.concatenate(own).tobytes()]}

    stored = cut(map_batches(texts, features, "y binary, sizes binary, own binary"))
    few, b = fit_rows(n_toxic, n_rest, Sums(stored), ratio[kept])
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = few
    return weights, b


class Sums:
    """Sums of a function of (y, doc, col) over all blocks of stored features: y is 0 or 1 for each text of a block; doc and
    col, the text and the feature, are given for each feature of a text. Small tables are summed by the driver, others by tasks."""

    def __init__(self, stored: DataFrame):
        self.stored = stored
        size = stored.agg(F.sum(F.octet_length("own") + 5 * F.octet_length("y"))).first()[0] or 0
        self.local = [r.asDict() for r in stored.collect()] if size <= KEPT else None

    @staticmethod
    def block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row["y"], np.uint8).astype(float)
        return y, np.repeat(np.arange(len(y)), np.frombuffer(row["sizes"], "<u4")), np.frombuffer(row["own"], "<u2").astype(np.intp)

    def __call__(self, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        if self.local is not None:
            return sum(work(*Sums.block(row)) for row in self.local)
        block = Sums.block

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            out = None
            for batch in batches:
                for y, sizes, own in zip(batch["y"], batch["sizes"], batch["own"]):
                    found = work(*block({"y": y, "sizes": sizes, "own": own}))
                    out = found if out is None else out + found
            if out is not None:
                yield {"found": [out.astype("<f8").tobytes()]}

        return sum(np.frombuffer(r["found"], "<f8") for r in map_batches(self.stored, run, "found binary").collect())


def chosen_buckets(with_toxic: np.ndarray, with_rest: np.ndarray, toxic: int, rest: int) -> np.ndarray:
    """The FEATURES buckets that get a weight, which tell most: the difference of their shares in the two kinds over its deviation."""
    n = max(1, toxic + rest)
    share = (with_toxic + with_rest) / n
    told = np.abs(with_toxic / max(1, toxic) - with_rest / max(1, rest)) / np.sqrt(np.maximum(share * (1 - share), 1 / n))
    return np.sort(np.argsort(-told, kind="stable")[:FEATURES])


def fit_rows(toxic: int, rest: int, sums: Sums, value: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression. toxic, rest: texts of each kind; sums: over their features; value: the log-count ratio of each feature."""
    prior = (toxic + 1) / (toxic + rest + 2)
    if not toxic or not rest:
        return np.zeros(len(value)), float(np.log(prior / (1 - prior)))

    def total(w, y, doc, col):
        return np.bincount(doc, weights=(w * value)[col], minlength=len(y))

    def back(e, doc, col):
        return np.append(np.bincount(col, weights=e[doc], minlength=len(value)) * value, e.sum())

    def chance(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    # conjugate gradients within Newton steps on the sum of log losses and PENALTY / 2 times the squared weights
    w, b = np.zeros(len(value)), float(np.log(prior / (1 - prior)))
    for _ in range(STEPS):
        def slope(y, doc, col, w=w, b=b):
            return back(chance(total(w, y, doc, col) + b) - y, doc, col)

        grad = -sums(slope) - np.append(PENALTY * w, 0)
        step, left = np.zeros(len(value) + 1), grad.copy()
        way, norm = left.copy(), left @ left
        for _ in range(25):
            if norm < 1e-10:
                break

            def bend(y, doc, col, w=w, b=b, way=way):
                pr = chance(total(w, y, doc, col) + b)
                return back(np.maximum(pr * (1 - pr), 1e-6) * (total(way[:-1], y, doc, col) + way[-1]), doc, col)

            bent = sums(bend) + np.append(PENALTY * way[:-1], 1e-6 * way[-1])
            size = norm / (way @ bent)
            step, left = step + size * way, left - size * bent
            norm, old = left @ left, norm
            way = left + norm / old * way

        tried = (0, 1, 0.5, 0.25, 0.1, 0.02)

        def losses(y, doc, col, w=w, b=b, step=step):
            z, more = total(w, y, doc, col) + b, total(step[:-1], y, doc, col) + step[-1]
            return np.array([np.logaddexp(0, (1 - 2 * y) * (z + t * more)).sum() for t in tried])

        loss = sums(losses) + [PENALTY / 2 * ((w + t * step[:-1]) ** 2).sum() for t in tried]
        t = next((t for t, x in zip(tried[1:], loss[1:]) if x < loss[0]), 0)
        if not t:  # further steps would be the same
            break
        w, b = w + t * step[:-1], b + t * step[-1]
    return w * value, float(b)


def probabilities(texts: list[str | None], weights: np.ndarray, b: float) -> np.ndarray:
    """The score of each text from all distinct n-grams of the whole text."""
    buckets, scores = Buckets(), np.full(len(texts), b)
    for i, text in enumerate(texts):
        scores[i] += weights.take(buckets(text)).sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": probabilities(batch["text"], *shipped.value)}

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return map_batches(rows, run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below THRESHOLD. Scoring adds a column to whole rows; nothing is joined."""
    model = fit(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(texts.tolist(), *shipped.value) >= THRESHOLD)

    return docs.where(~toxic(docs["text"]))
