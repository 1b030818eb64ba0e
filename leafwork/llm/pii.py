"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap. The base kinds (email, ip, card, phone) have exact rules and
their valid matches always stay. Every other candidate (looser shapes, and base matches that fail their rule) becomes a
vector of format and context features; boosted trees of depth two score it, Platt scaling turns the score into a
probability, and a threshold per generator, set on held-out rows for a precision of ``PRECISION``, selects the spans.

The trees are fitted on ``TRAIN_ROWS`` labelled candidates that Spark generates from templates, a bounded and documented
sample: rows are aggregated by feature vector (at most 2^12 x generators groups) before boosting, so the fit costs one
small job whatever the corpus.

Defined cases: a null text counts as empty; positions are code points, end exclusive; matches of one kind are leftmost and
don't overlap; repeated rows are handled on their own; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.text import let

#: The base kinds in their order, with patterns that can't backtrack into long runs (\G: right after the last match).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
#: Further generators. Their spans may overlap the base spans and each other.
MORE = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}",
    "phone_local": r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What makes a text worth a pass of the regular expression of each generator.
NEEDS = {"email": "@", "ip": r"\d\.\d", "card": r"\d[ -]?\d", "phone": r"\+\d", "email_spelled": r"at[)\] ]", "phone_local": r"\d[ .-]\d{3}", "national_id": r"\d-\d\d-\d", "iban": r"[A-Z]{2}\d\d"}
KINDS = [*BASE, *MORE]
CONTEXT, BLOCK = 24, 256
TRAIN_ROWS, ROUNDS, RATE, PRECISION = 8000, 24, 0.3, 0.99


def running(xs: Column, zero: Column, kind: str, merge: Callable[[Column, Column], Column]) -> Column:
    """What ``merge`` has made of the elements before each one, as an array of ``kind``: struct(x, before).

    Elements are taken in blocks, so that many of them don't cost the square of their number; ``xs`` is computed once.
    """

    def over(all_of: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(all_of), F.lit(BLOCK)), lambda at: F.slice(all_of, at + 1, BLOCK))

        def within(block: Column, acc: Column) -> Column:
            start = F.struct(acc.alias("acc"), F.array().cast(f"array<{kind}>").alias("seen"))
            step = lambda a, x: F.struct(merge(a["acc"], x).alias("acc"), F.concat(a["seen"], F.array(a["acc"])).alias("seen"))
            return F.aggregate(block, start, step)

        def step(a: Column, b: Column) -> Column:
            return let(within(b, a["acc"]), lambda w: F.struct(w["acc"].alias("acc"), F.concat(a["seen"], F.array(w["seen"])).alias("seen")))

        start = F.struct(zero.alias("acc"), F.array().cast(f"array<array<{kind}>>").alias("seen"))
        return F.arrays_zip(all_of.alias("x"), F.flatten(F.aggregate(blocks, start, step)["seen"]).alias("before"))

    return let(xs, over)


def _spans(text: Column, kind: str) -> Column:
    """All matches as struct(start, rank, end, kind, hit, left, right), where left and right are the text around.

    The gaps between matches give positions and context without another pass over the text. Every array is computed once and
    handed on by name, so that the work is linear in the text and its matches.
    """
    pattern = {**BASE, **MORE}[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = let(
        F.split(text, pattern, -1),
        lambda gaps: F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("left"), F.slice(gaps, F.lit(2), F.size(gaps) - 1).alias("right")),
    )
    placed = running(parts, F.lit(0), "int", lambda at, p: at + F.char_length(p["left"]) + F.char_length(p["hit"]))

    def span(z: Column) -> Column:
        p, start = z["x"], z["before"] + F.char_length(z["x"]["left"])
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (start + F.char_length(p["hit"])).alias("end"),
            F.lit(kind).alias("kind"),
            p["hit"].alias("hit"),
            F.lower(F.right(p["left"], F.lit(CONTEXT))).alias("left"),
            F.lower(F.left(p["right"], F.lit(CONTEXT))).alias("right"),
        )

    return F.when(text.rlike(NEEDS[kind]), F.transform(placed, span)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string,left:string,right:string>>"))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(span: Column) -> Column:
    """Whether a match of a base kind passes its rule."""
    n = F.char_length(_digits(span["hit"]))
    return (
        F.when(span["kind"] == "email", True)
        .when(span["kind"] == "ip", span["hit"].rlike(OCTETS))
        .when(span["kind"] == "card", n.between(14, 19) & luhn(_digits(span["hit"])))
        .when(span["kind"] == "phone", n.between(10, 15))
        .otherwise(False)
    )


def features(kind: Column, hit: Column, left: Column, right: Column) -> list[Column]:
    """Twelve yes/no features of a candidate: its format, then its context."""
    digits = _digits(hit)
    return [
        F.char_length(digits).between(9, 11),
        F.char_length(digits).between(13, 19),
        luhn(digits),
        hit.rlike(r"[ .()-]"),
        hit.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$"),
        hit.rlike(r"(?i)(?:dot\)|dot\]|dot) ?(?:com|org|net|edu|gov|io|de|fr|es|uk)$"),
        left.rlike(r"(?:phone|tel|call|fax|mobile|cell|ring)[^a-z]{0,4}\S{0,3}\s*$"),
        left.rlike(r"(?:ssn|social security|national id|tax id)[^a-z]{0,6}\S{0,3}\s*$"),
        left.rlike(r"(?:e-?mail|mail|contact|write to|reach)[^a-z]{0,4}\S{0,3}\s*$"),
        left.rlike(r"(?:iban|account|bank|acct|card|visa)[^a-z]{0,6}\S{0,3}\s*$"),
        left.rlike(r"(?:order|invoice|version|isbn|part|serial|ref|no\.?|id)[^a-z]{0,4}$"),
        left.rlike(r"[$€£#/=]\s*$") | right.rlike(r"^\s*(?:%|usd|eur|kg|km|mm|\.\d)"),
    ]


N_FEATURES = 12


def _training(spark: SparkSession) -> DataFrame:
    """TRAIN_ROWS labelled candidates from templates, a fixed function of the row number."""
    i = F.col("id")
    pick = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))
    number = lambda salt, n: F.lpad(pick(salt, 10**n).cast("string"), n, "0")
    one = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (pick(salt, len(words)) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (pick("kind", len(KINDS)) + 1).cast("int"))
    real = pick("real", 2) == 1
    other = ~real & (pick("other", 2) == 0)  # what looks like another kind, near that kind's words
    hit = (
        F.when(kind == "email_spelled", F.concat(one("u", ["anna", "jo.li", "max7", "support"]), F.lit(" at "), one("d", ["mail", "corp", "acme"]), F.lit(" dot "), F.when(real, one("t", ["com", "org", "de", "net"])).otherwise(one("t", ["the", "was", "com", "and"]))))
        .when(kind == "phone_local", F.concat(number("a", 3), one("s", ["-", " ", "."]), number("b", 3), one("s", ["-", " ", "."]), number("c", 4)))
        .when(kind == "national_id", F.concat(F.when(real, F.lpad((pick("a", 664) + 1).cast("string"), 3, "0")).otherwise(number("a", 3)), F.lit("-"), number("b", 2), F.lit("-"), number("c", 4)))
        .when(kind == "iban", F.concat(one("u", ["DE", "FR", "ES", "GB"]), number("a", 2), number("b", 4), number("c", 4), number("d", 4), number("e", 4), number("f", 2)))
        .when(kind == "phone", F.concat(F.lit("+"), number("a", 2), F.lit(" "), number("b", 3), F.lit(" "), number("c", 3)))
        .when((kind == "card") & other, F.concat(number("a", 3), F.lit("-"), number("b", 3), F.lit("-"), number("c", 4)))
        .when(kind == "card", F.concat(number("a", 4), F.lit(" "), number("b", 4), F.lit(" "), number("c", 4), F.lit(" "), number("d", 4)))
        .when(kind == "ip", F.concat(number("a", 3), F.lit("."), number("b", 3), F.lit("."), number("c", 3), F.lit("."), number("d", 3)))
        .otherwise(F.concat(one("u", ["a", "b"]), F.lit("@x.y")))
    )
    cue = {"email": ["e-mail: ", "contact "], "ip": ["host "], "card": ["card: ", "visa "], "phone": ["call ", "tel: ", "phone "], "email_spelled": ["e-mail: ", "write to ", "contact "], "phone_local": ["call ", "phone: ", "tel ", "fax "], "national_id": ["ssn ", "ssn: ", "social security ", "tax id: "], "iban": ["iban ", "iban: ", "account ", "bank "]}
    good = F.coalesce(*[F.when(kind == k, one("cue", v)) for k, v in cue.items()])
    wrong = one("wrong", ["call ", "phone: ", "ssn ", "host "])
    left = F.when(real & (pick("cued", 10) < 9), good).when((kind == "card") & other, wrong).otherwise(one("noise", ["order no. ", "version ", "the ", "isbn ", "of ", "ref ", "and the ", "$", "serial #", "in "]))
    right = F.when(real, F.lit(" and the")).otherwise(one("r", [" kg", " the", "%", " of", " EUR"]))
    return spark.range(TRAIN_ROWS, numPartitions=1).select(
        kind.alias("kind"), hit.alias("hit"), F.lower(left).alias("left"), F.lower(right).alias("right"), real.cast("int").alias("label"), (pick("fold", 4) == 0).alias("held")
    )


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _boost(rows: list[tuple[tuple[int, ...], float, float]]) -> list[tuple[int, int, int, tuple[float, ...]]]:
    """Newton boosting. rows: features, weight of all, weight of positives. A tree: features f, left g, right h and the leaves at (f=0,g=0), (0,1), (f=1,h=0), (1,1)."""
    trees, score = [], [0.0] * len(rows)
    n = len(rows[0][0])

    def split(at: list[int], grad: list[float], hess: list[float]) -> tuple[float, int, float, float]:
        best = (-1.0, 0, 0.0, 0.0)
        for f in range(n):
            g, h = [0.0, 0.0], [1.0, 1.0]
            for i in at:
                g[rows[i][0][f]] += grad[i]
                h[rows[i][0][f]] += hess[i]
            gain = g[0] ** 2 / h[0] + g[1] ** 2 / h[1]
            if gain > best[0] + 1e-12:
                best = (gain, f, RATE * g[0] / h[0], RATE * g[1] / h[1])
        return best

    for _ in range(ROUNDS):
        p = [_sigmoid(s) for s in score]
        grad = [pos - w * q for (_, w, pos), q in zip(rows, p)]
        hess = [w * q * (1 - q) for (_, w, _), q in zip(rows, p)]
        best = None
        for f in range(n):
            sides = [[i for i in range(len(rows)) if rows[i][0][f] == v] for v in (0, 1)]
            low, high = (split(s, grad, hess) for s in sides)
            if best is None or low[0] + high[0] > best[0] + 1e-12:
                best = (low[0] + high[0], f, low, high)
        _, f, low, high = best
        trees.append((f, low[1], high[1], (low[2], low[3], high[2], high[3])))
        for i, (x, _, _) in enumerate(rows):
            score[i] += trees[-1][3][2 + x[high[1]] if x[f] else x[low[1]]]
    return trees


def _margin(x: tuple[int, ...], trees: list) -> float:
    return sum(v[2 + x[h] if x[f] else x[g]] for f, g, h, v in trees)


def fit(spark: SparkSession) -> dict:
    """The fitted trees, the calibration (a, b) and the threshold of the calibrated probability for each generator."""
    made = _training(spark)
    marks = [x.cast("int").alias(f"f{i}") for i, x in enumerate(features(F.col("kind"), F.col("hit"), F.col("left"), F.col("right")))]
    marks += [(F.col("kind") == k).cast("int").alias(f"k{i}") for i, k in enumerate(KINDS)]
    made = made.select(*marks, "label", "held")
    groups = made.groupBy(*made.columns[:-2], "held").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    rows = sorted((bool(r["held"]), tuple(r[: len(marks)]), float(r["n"]), float(r["p"])) for r in groups)
    trees = _boost([r[1:] for r in rows if not r[0]])
    held = [(_margin(x, trees), n, p, x[N_FEATURES:].index(1)) for h, x, n, p in rows if h]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton steps
        ga = gb = 0.0
        haa = hbb = 1e-6
        hab = 0.0
        for m, n, p, _ in held:
            q = _sigmoid(a * m + b)
            e, w = p - n * q, n * q * (1 - q)
            ga, gb, haa, hab, hbb = ga + e * m, gb + e, haa + w * m * m, hab + w * m, hbb + w
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    limits = {}
    for k, kind in enumerate(KINDS):
        n = p = 0.0
        for m, w, pos, of in sorted(held, reverse=True):
            if of == k:
                n, p = n + w, p + pos
                if p >= PRECISION * n:
                    limits[kind] = max(0.5, _sigmoid(a * m + b))
    return {"trees": trees, "scale": (a, b), "limits": limits}


def _probability(span: Column, model: dict) -> Column:
    flags = [*features(span["kind"], span["hit"], span["left"], span["right"]), *[span["kind"] == k for k in KINDS]]
    margin = F.lit(0.0)
    for f, g, h, v in model["trees"]:
        margin = margin + F.when(flags[f], F.when(flags[h], v[3]).otherwise(v[2])).otherwise(F.when(flags[g], v[1]).otherwise(v[0]))
    a, b = model["scale"]
    return 1 / (1 + F.exp(-(F.lit(a) * margin + b)))


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """row (a struct of all columns of ``docs``) and spans: array of struct(start, rank, end, kind, hit, base), ordered by start, then kind."""
    model = model or fit(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = rows.select("row", *[_spans(F.col("text"), k).alias(k) for k in KINDS])
    limit = lambda s: F.coalesce(*[F.when(s["kind"] == k, v) for k, v in model["limits"].items()], F.lit(2.0))
    marked = F.transform(
        F.concat(*KINDS), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["hit"], _valid(s).alias("base"), s["left"], s["right"])
    )
    found = found.select("row", marked.alias("candidates"))
    chosen = F.filter("candidates", lambda s: s["base"] | (_probability(s, model) >= limit(s)))
    plain = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"), s["base"].alias("base")))
    return found.select("row", F.array_sort(plain).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per document."""
    found = find(docs.select(docs["doc_id"], docs["text"])).select("row.doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one mark.

    Other columns stay, but ``n_chars``, where there is one, follows the new text. Texts without a span are left as they are.
    """
    found = find(docs)
    zone = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    # A span opens a mark unless it begins inside an earlier one; the text before it begins where all earlier ones have ended.
    marks = F.filter(running(zone, F.lit(0), "int", lambda end, s: F.greatest(end, s["end"])), lambda z: z["x"]["start"] >= z["before"])
    found = found.select("row", marks.alias("marks"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("last"))
    marks, text = F.col("marks"), F.col("row.text")
    blocks = F.transform(F.sequence(F.lit(0), F.size(marks), F.lit(BLOCK)), lambda at: F.slice(marks, at + 1, BLOCK))

    def written(block: Column) -> Column:
        """A block of marks with the text before each, cut from the stretch of text that they share."""
        begin, end = F.get(block, F.lit(0))["before"], F.element_at(block, -1)["x"]["start"]
        one = lambda own, m: F.concat(F.substring(own, m["before"] - begin + 1, m["x"]["start"] - m["before"]), F.lit("["), F.upper(m["x"]["kind"]), F.lit("]"))
        return let(F.substring(text, begin + 1, end - begin), lambda own: F.transform(block, lambda m: one(own, m)))

    pieces = F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b) > 0), written))
    new = F.when(F.size(marks) > 0, F.concat(F.array_join(pieces, ""), F.expr("substring(row.text, last + 1)"))).otherwise(text)
    out = found.select("row", "marks", new.alias("new"))
    size = F.when(F.size(marks) > 0, F.char_length("new").cast("long"))
    own = lambda c: F.col("row")[c]
    return out.select(*[F.col("new").alias(c) if c == "text" else F.coalesce(size, own(c)).alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns])
