"""Text items of laid-out pages: positions, order, font sizes, text repairs and metadata, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import let

#: White space as ECMAScript trims it: the byte order mark counts, U+0085 doesn't.
BLANK = "\\t-\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
RADICALS = "".join(map(chr, range(0x2F00, 0x2FD6)))


def js_round(x: Column) -> Column:
    """The nearest whole number, halves up; zero keeps the sign of what it came from."""
    low = F.floor(x).cast("double")
    up = low + F.when(x - low >= 0.5, 1.0).otherwise(0.0)
    negative = x.cast("string").startswith("-")
    return F.when((up == 0) & negative, F.lit(-0.0)).otherwise(up)


def js_hypot(a: Column, b: Column) -> Column:
    """Length of (a, b), scaled by the larger one."""
    a, b = F.abs(a), F.abs(b)
    top = F.greatest(a, b)
    return F.when(top == 0, 0.0).otherwise(F.sqrt((a / top) * (a / top) + (b / top) * (b / top)) * top)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def finite(*xs: Column) -> Column:
    good = F.lit(True)
    for x in xs:
        good = good & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return good


def page_frame(pages: DataFrame) -> DataFrame:
    """(page_number, rotation, x1, y1, x2, y2) with width, height and error."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    good = (F.col("page_number") > 0) & (F.col("rotation") % 90 == 0) & finite(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], wide, high) & (wide > 0) & (high > 0)
    return pages.withColumns({"width": wide, "height": high, "error": F.when(~F.coalesce(good, F.lit(False)), "PARSE_ERROR")})


def project_items(items: DataFrame) -> DataFrame:
    """(doc_id, sequence, text, a, b, c, d, e, f, width, height) to placed items; blank ones go and leave a gap in the sequence.

    rank orders a document's items from the top down, then from the left, then by sequence.
    """
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    rows = items.withColumn("text", trim(F.col("text"))).where("text <> ''")
    rows = rows.withColumns({"sx": js_hypot(a, b), "sy": js_hypot(c, d), "upright": F.abs(b) > F.abs(a) * 4.0, "w": js_round(F.col("width"))})
    rows = rows.withColumn("font_size", js_round(F.greatest("sx", "sy")))
    least = F.greatest(F.lit(1.0), F.col("font_size"))
    x = js_round(e) - F.when(F.col("upright") & (b > 0), least).otherwise(0.0)
    bad = ~finite(F.col("sx"), F.col("sy"), e, f, F.col("width"), F.col("height"))
    rows = rows.select(
        "doc_id", "sequence", "text", x.alias("x"), js_round(f).alias("y"), F.when(F.col("upright"), least).otherwise(F.col("w")).alias("width"), js_round(F.col("height")).alias("height"),
        "font_size", ((F.col("font_size") == 0) | (F.col("width") == 0)).alias("is_hidden"), F.when(F.col("upright"), F.greatest(F.lit(1.0), F.col("w"))).alias("rotated_length"),
        F.when(bad, "PARSE_ERROR").alias("error"),
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("y").desc(), "x", "sequence")))


def rewrite_text(text: Column, font_size: Column) -> Column:
    """Radicals as ideographs; blanks out of numbers, and out of capitals set apart at fourteen points and more."""
    plain = "".join(unicodedata.normalize("NFKC", r) for r in RADICALS)
    text = F.translate(trim(text), RADICALS, plain)
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    number = lambda x: x.rlike(f"^[0-9{BLANK}().·,☎-]*$") & x.rlike("[0-9]") & x.contains(" ")
    label = lambda x: (font_size >= 14) & x.rlike("^[A-Z0-9?!&'’](?: [A-Z0-9?!&'’]){2,}$")
    text = let(text, lambda x: F.when(number(x), tight(x)).otherwise(x))
    return let(text, lambda x: F.when(label(x), tight(x)).otherwise(x))


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDhhmmss anywhere in a text, missing pairs as the first of the year; null without a year."""
    pattern = r"D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")), F.lit(default))
    made = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    return F.when(c.rlike(r"D:\d{4}"), made)


def keywords(c: Column) -> Column:
    """Words between commas and semicolons; null for a blank field, an empty list when only separators are there."""
    parts = F.filter(F.transform(F.split(c, "[,;]"), trim), lambda x: x != "")
    return F.when(trim(c) != "", parts)


def metadata(raw: DataFrame) -> DataFrame:
    """title, author, creator, subject, keywords, creation_date, modified_date as the document metadata has them."""
    field = lambda c: F.nullif(trim(F.col(c)), F.lit("")).alias(c)
    keep = [c for c in raw.columns if c not in ("title", "author", "creator", "subject", "keywords", "creation_date", "modified_date")]
    return raw.select(
        *keep, field("title"), field("author"), field("creator"), field("subject").alias("description"), keywords(F.col("keywords")).alias("keywords"),
        pdf_date(F.col("creation_date")).alias("created_at"), pdf_date(F.col("modified_date")).alias("modified_at"),
    )


def ascii_hex(c: Column) -> Column:
    """Bytes of an ASCIIHex stream (text): white space out, up to the end mark, an odd last digit followed by 0; null if it isn't hexadecimal."""
    digits = F.regexp_replace(F.substring_index(c, ">", 1), r"[\x00\t\n\x0C\r ]", "")
    return F.when(c.contains(">") & digits.rlike("^[0-9A-Fa-f]*$"), F.unhex(F.concat(digits, F.when(F.char_length(digits) % 2 == 1, "0").otherwise(""))))


def note_mark(n: Column, style: str, prefix: str = "", suffix: str = ")", user: str = "*") -> Column:
    """The mark of the n-th note: DIGIT, CIRCLED_DIGIT, LATIN and ROMAN capitals and smalls, HANGUL syllables, USER_CHAR."""
    letter = lambda first: F.concat(F.char(F.lit(ord(first)) + (n - 1) % 26))
    roman = lambda: F.aggregate(
        F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))]),
        F.struct(n.cast("int").alias("n"), F.lit("").alias("s")),
        lambda acc, x: F.struct((acc["n"] % x["v"]).alias("n"), F.concat(acc["s"], F.repeat(x["s"], F.floor(acc["n"] / x["v"]).cast("int"))).alias("s")),
        lambda acc: acc["s"],
    )
    hangul = F.element_at(F.array(*[F.lit(x) for x in "가나다라마바사아자차카타파하"]), ((n - 1) % 14 + 1).cast("int"))
    circled = F.when(n.between(1, 20), F.element_at(F.array(*[F.lit(chr(0x2460 + i)) for i in range(20)]), F.least(F.greatest(n, F.lit(1)), F.lit(20)).cast("int"))).otherwise(n.cast("string"))
    marks = {
        "DIGIT": lambda: n.cast("string"), "CIRCLED_DIGIT": lambda: circled, "LATIN_CAPITAL": lambda: letter("A"), "LATIN_SMALL": lambda: letter("a"), "HANGUL_SYLLABLE": lambda: hangul,
        "ROMAN_CAPITAL": roman, "ROMAN_SMALL": lambda: F.lower(roman()), "USER_CHAR": lambda: F.lit(user),
    }
    return F.concat(F.lit(prefix), marks[style](), F.lit(suffix))
