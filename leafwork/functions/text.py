"""Text rules of the document engine as column expressions, each with its DuckDB twin (``*_sql``) for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and marks that the document format defines.
SPACES = "\t\n\x0b\x0c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Names of shapes.
SHAPES = (
    "사각형|직사각형|정사각형|원|타원|삼각형|이등변 삼각형|직각 삼각형|선|직선|곡선|화살표|굵은 화살표|이중 화살표|오각형|육각형|팔각형|별|4점별|5점별|6점별|7점별|8점별|"
    "십자|십자형|구름|구름형|마름모|도넛|평행사변형|사다리꼴|부채꼴|호|반원|물결|번개|하트|빗금|블록 화살표|수식|표|그림|개체|그리기 개체|그리기개체|묶음 개체|묶음개체|글상자|"
    "수식 개체|수식개체|OLE 개체|OLE개체"
)
# Date units and the order of lettered items.
DATE_UNITS = "년월일시분초"
HANGUL_ORDER = "가나다라마바사아자차카타파하"
# Symbol characters of the private use area with a plain counterpart. Others can be given as a parameter.
PUA = {
    0xF022: "✂", 0xF036: "⌛", 0xF045: "☜", 0xF046: "☞", 0xF047: "☝", 0xF048: "☟", 0xF04A: "☺", 0xF04E: "☠", 0xF052: "☼", 0xF054: "❄", 0xF058: "✠", 0xF059: "✡",
    0xF06C: "●", 0xF06D: "●", 0xF06E: "■", 0xF06F: "□", 0xF070: "□", 0xF071: "□", 0xF072: "□", 0xF073: "⬧", 0xF074: "⧫", 0xF075: "◆", 0xF076: "❖", 0xF077: "⬥",
    0xF09E: "·", 0xF09F: "•", 0xF0A0: "·", 0xF0A1: "⚪", 0xF0A2: "○", 0xF0A3: "○", 0xF0A4: "◉", 0xF0A5: "◎", 0xF0A7: "▪", 0xF0A8: "◻", 0xF0A9: "🟂", 0xF0AA: "✦", 0xF0AB: "★",
    0xF0AC: "✶", 0xF0AD: "✴", 0xF0AE: "✹", 0xF0E8: "➔", 0xF0EF: "⇦", 0xF0F0: "⇨", 0xF0F1: "⇧", 0xF0F2: "⇩", 0xF0FB: "✗", 0xF0FC: "✔", 0xF0FD: "☒", 0xF0FE: "☑",
    0xF003B: "↓", 0xF0090: "✺", 0xF00DA: "▸", 0xF0288: "⓪", 0xF0289: "①", 0xF028A: "②", 0xF028C: "④", 0xF028D: "⑤", 0xF028E: "⑥", 0xF028F: "⑦", 0xF0290: "⑧", 0xF0291: "⑨",
    0xF02EC: "◇", 0xF02EF: "·", 0xF02FB: "▸", 0xF02FC: "►", 0xF031C: "■", 0xF03A0: "↵", 0xF03A7: "⊟", 0xF03A8: "⊞", 0xF03C5: "□", 0xF03DA: "□", 0xF03EF: "한", 0xF03F0: "글",
    0xF03F1: "과", 0xF03F2: "컴", 0xF03F3: "퓨", 0xF03F4: "터", 0xF03FF: "□", 0xF0806: "┌", 0xF0807: "┬", 0xF0808: "┐", 0xF080C: "└", 0xF080E: "┘", 0xF080F: "━", 0xF0810: "│",
    0xF081C: "┈", 0xF0827: "■", 0xF0832: "═", 0xF0848: "━", 0xF0854: "《", 0xF0855: "》",
}
SEAL, SEALS = "(인)", (0xF012B, 0xF00E1)
CIRCLED = range(0xF02B1, 0xF02C5)  # the numbers one to twenty in circles
INLINE_TAGS = ("u", "sup", "sub")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value of ``c``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def utrim_sql(x: str) -> str:
    return f"trim({x}, {chars_sql(SPACES)})"


def chars_sql(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


def normalize_pua(c: Column, extra: dict[int, str] | None = None) -> Column:
    """Symbols of the private use area as plain ones; supplementary ones without a counterpart go."""
    table = PUA | {x: chr(0x2460 + i) for i, x in enumerate(CIRCLED)} | (extra or {})
    single = {k: v for k, v in table.items() if len(v) == 1}

    def mapped(x: Column) -> Column:
        out = F.translate(x, "".join(map(chr, single)), "".join(single.values()))
        for seal in SEALS:
            out = F.replace(out, F.lit(chr(seal)), F.lit(SEAL))
        return F.regexp_replace(out, r"[\x{F0000}-\x{FFFFD}]", "")

    return let(c, lambda x: F.when(x.rlike(r"[\x{F020}-\x{F0FF}\x{F0000}-\x{FFFFD}]"), mapped(x)).otherwise(x))


def is_shape_alt(line: Column) -> Column:
    """Whether a line is the generated description of a drawn shape."""
    shapes = SHAPES
    return line.rlike(rf"(?U)^\s*(?:모서리가 둥근 |둥근 )?\s*(?:{shapes})\s*입니다\s*\.?\s*$")


def join_spaced_hangul(c: Column) -> Column:
    """Short texts of single syllables set apart by blanks ("업 체 명") as one word, unless they are date units."""
    words = F.split(c, " ")
    single = lambda w: w.rlike("^[\uac00-\ud7af\u3131-\u318e]$")
    n = F.size(words)
    spread = (
        (F.octet_length(F.encode(c, "UTF-16BE")) <= 60) & c.contains(" ") & (n >= 3)
        & (F.size(F.filter(words, single)) * 10 >= n * 7) & F.exists(words, lambda w: single(w) & ~w.rlike(f"[{DATE_UNITS}]"))
    )
    return F.when(c.contains(" ") & c.rlike("[\uac00-\ud7af\u3131-\u318e]") & spread, F.replace(c, F.lit(" "), F.lit(""))).otherwise(c)


#: One line of printable ASCII with single blanks inside: text that ``sanitize`` leaves as it is; and what Markdown takes as it is, too.
TIDY = r"^(?:[!-~]++(?: [!-~]++)*+)?+\z"
INERT = TIDY.replace("[!-~]", r"[!-~&&[^#$*<\\_`|~]]")


def sanitize(c: Column, extra_pua: dict[int, str] | None = None) -> Column:
    """Visible text: symbols mapped, shape descriptions dropped, blanks collapsed, ends trimmed, spaced syllables joined."""
    return F.when(c.rlike(TIDY), c).otherwise(_sanitized(c, extra_pua))


def _sanitized(c: Column, extra_pua: dict[int, str] | None) -> Column:
    c = F.regexp_replace(normalize_pua(c, extra_pua), "\r\n", "\n")
    kept = lambda x: F.array_join(F.filter(F.split(x, "\n"), lambda y: ~is_shape_alt(y)), "\n")
    c = let(c, lambda x: F.when(x.contains("입니다"), kept(x)).otherwise(x))
    return let(utrim(F.regexp_replace(c, " {2,}", " ")), join_spaced_hangul)


def sanitize_sql(x: str) -> str:
    """The part of ``sanitize`` that the tables' texts need: no private symbols, shapes or spaced syllables are in them."""
    return utrim_sql(f"regexp_replace(regexp_replace({x}, '\\r\\n', chr(10), 'g'), ' {{2,}}', ' ', 'g')")


#: What stays as it is: an escaped bar or dollar, and mathematics. Unrolled, so that long spans need no recursion.
VERBATIM = r"(?s)\\[|$]|\$\$[^\\$]*+(?:(?:\\.|\$(?!\$))[^\\$]*+)*+\$\$|\$(?!\$)[^\\$\n]*+(?:\\.[^\\$\n]*+)*+\$"


def _escape_part(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, r"(?m)^([ \t$]*)(#{1,6}[ \t])", r"$1\\$2")
    c = F.regexp_replace(c, r"([~*_`|])", r"\\$1")
    return F.regexp_replace(c, r"<(?!/?(?:u|sup|sub)>)(?=[A-Za-z/!?])", r"\\<")


def escape_gfm(c: Column) -> Column:
    """Markdown that shows the text itself. Formulas and escaped bars stay; line starts and tags that would act are escaped."""

    def woven(x: Column) -> Column:
        kept, parts = F.regexp_extract_all(x, F.lit(VERBATIM), F.lit(0)), F.split(x, VERBATIM, -1)
        part = lambda p, i: F.when(i == 0, _escape_part(p)).otherwise(F.substring(_escape_part(F.concat(F.lit("\x01"), p)), 2, 1 << 30))
        follow = let(kept, lambda k: F.transform(parts, lambda p, i: F.concat(part(p, i), F.coalesce(F.get(k, i), F.lit("")))))
        return F.array_join(follow, "")

    escaped = let(sanitize(c), lambda x: F.when(x.contains("$") | x.contains("\\|"), woven(x)).otherwise(_escape_part(x)))
    return F.when(c.rlike(INERT), c).otherwise(escaped)


def escape_gfm_sql(x: str) -> str:
    def part(p: str) -> str:
        p = f"replace({p}, '\\', '\\\\')"
        p = f"regexp_replace({p}, '(?m)^([ \\t$]*)(#{{1,6}}[ \\t])', '\\1\\\\\\2', 'g')"
        p = f"regexp_replace({p}, '([~*_`|])', '\\\\\\1', 'g')"
        p = f"regexp_replace({p}, '<([A-Za-z/!?])', '\\\\<\\1', 'g')"
        for tag in INLINE_TAGS:
            p = f"replace(replace({p}, '\\<{tag}>', '<{tag}>'), '\\</{tag}>', '</{tag}>')"
        return p

    s = sanitize_sql(x)
    verbatim = r"'(?s)\\[|$]|\$\$(?:\\.|[^\\])*?\$\$|\$(?:\\.|[^\\$\n])+\$'"
    kept, parts = f"regexp_extract_all({s}, {verbatim})", f"string_split_regex({s}, {verbatim})"
    return (
        f"(CASE WHEN contains({s}, '$') OR contains({s}, '\\|') THEN array_to_string(list_transform({parts}, lambda p, i: "
        f"concat(CASE WHEN i = 1 THEN {part('p')} ELSE substr({part('chr(1) || p')}, 2) END, coalesce({kept}[i], ''))), '') ELSE {part(s)} END)"
    )


def safe_href(c: Column) -> Column:
    """A link target with an allowed scheme, its brackets, quotes and white space percent-encoded; null otherwise."""

    def encoded(x: Column) -> Column:
        for ch in "()<>\"'`\t\n\x0c\r ":
            x = F.replace(x, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
        return x

    return let(utrim(c), lambda x: F.when(x.rlike(r"(?i)^(?:https:|http:|mailto:|tel:|#)"), encoded(x)))


def safe_href_sql(x: str) -> str:
    out = x = utrim_sql(x)
    for ch in "()<>\"'`\t\n\x0c\r ":
        out = f"replace({out}, chr({ord(ch)}), '%{ord(ch):02X}')"
    return f"CASE WHEN regexp_matches({x}, '(?i)^(?:https:|http:|mailto:|tel:|#)') THEN {out} END"


def escape_html(c: Column, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *[('"', "&quot;")] * attribute]
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html_cell(c: Column) -> Column:
    """HTML text of a cell; the inline tags for underline and script stay tags."""
    c = escape_html(c)
    for tag in INLINE_TAGS:
        c = F.replace(F.replace(c, F.lit(f"&lt;{tag}&gt;"), F.lit(f"<{tag}>")), F.lit(f"&lt;/{tag}&gt;"), F.lit(f"</{tag}>"))
    return c


def escape_html_cell_sql(x: str) -> str:
    x = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for tag in INLINE_TAGS:
        x = f"replace(replace({x}, '&lt;{tag}&gt;', '<{tag}>'), '&lt;/{tag}&gt;', '</{tag}>')"
    return x


NUMBERED, HANGUL_NUMBERED = r"(?U)^[0-9]+\.\s", "(?U)^[\uac00-\ud7af]\\.\\s"
LIST_MARK = (
    rf"(?:[□■◇◆○◎●◦ㅇ•▪▸▶※-]|[①-⑳㉮-㉻㈎-㈛]|[{HANGUL_ORDER}][.)]|\([0-9{HANGUL_ORDER}]{{1,3}}\)|[0-9]{{1,3}}[.)])"
)


def is_list_marker(c: Column) -> Column:
    """Whether a paragraph begins like a list item."""
    return utrim(c).rlike(rf"(?U)^{LIST_MARK}\s")


def is_list_marker_sql(x: str) -> str:
    return f"regexp_matches({utrim_sql(x)}, '^{LIST_MARK}[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]')"


# Units of numbers.
UNITS = "%|백만원|천원|㎡|㎢|시간|원|명|건|개|kg|km|일"


def is_number(c: Column) -> Column:
    return _is_number(utrim(c))


def _is_number(c: Column) -> Column:
    """Of trimmed text."""
    return c.rlike(rf"(?U)^\s*[-+]?\s*(?=[0-9,]*[0-9])[0-9,]+(?:\.[0-9]+)?\s*(?:{UNITS})?$")


def is_number_sql(x: str) -> str:
    return f"regexp_matches({utrim_sql(x)}, '^\\s*[-+]?\\s*,*[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:{UNITS})?$')"


def is_date(c: Column) -> Column:
    """A year or day, a separator and a numeric month, in four to eighteen characters."""
    return F.char_length(c).between(4, 18) & c.rlike(r"(?U)^[0-9]{2,4}[.\-/년][0-9\s]*[0-9][0-9\s]*(?:[.\-/월일].*)?$".replace(".*", "[\\x{0}-\\x{10ffff}]*"))


def is_date_sql(x: str) -> str:
    return f"(length({x}) BETWEEN 4 AND 18 AND regexp_matches({x}, '(?s)^[0-9]{{2,4}}[.\\-/년][0-9\\s]*[0-9][0-9\\s]*(?:[.\\-/월일].*)?$'))"


#: Numbers and days that need no look at other forms.
DIGITS, DAY = r"^[-+]?[0-9]++(?:\.[0-9]++)?+\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
CELL_TYPES = ("empty", "number", "date", "short", "long")


def cell_type(text: Column, has_blocks: Column | None = None, labels: tuple = CELL_TYPES) -> Column:
    """empty, number, date, short (up to twelve characters) or long; or the label in its place. Tidy text needs no trimming."""
    blocks = F.coalesce(has_blocks, F.lit(False)) if has_blocks is not None else F.lit(False)
    empty, number, date, short, long = map(F.lit, labels)
    kind = lambda t: (
        F.when(t == "", F.when(blocks, short).otherwise(empty)).when(_is_number(t), number).when(is_date(t), date).when(F.char_length(t) <= 12, short).otherwise(long)
    )
    return F.when(text.rlike(DIGITS), number).when(text.rlike(DAY), date).when(text.rlike(TIDY), kind(text)).otherwise(let(utrim(F.coalesce(text, F.lit(""))), kind))


def cell_type_sql(x: str) -> str:
    t = utrim_sql(f"coalesce({x}, '')")
    return f"CASE WHEN {t} = '' THEN 'empty' WHEN {is_number_sql(t)} THEN 'number' WHEN {is_date_sql(t)} THEN 'date' WHEN length({t}) <= 12 THEN 'short' ELSE 'long' END"


# Words of diagrams.
DIAGRAMS = r"조직도|연락망|체계도|기구표|배치도|흐름도|추진\s*체계"


def has_diagram_word(c: Column) -> Column:
    """Words that announce a diagram (the two-word forms of the first six are covered by their last word)."""
    return F.coalesce(c.rlike(rf"(?U){DIAGRAMS}"), F.lit(False))


# Words that label a field of a form.
LABELS = (
    "성명 이름 주소 전화 전화번호 휴대폰 핸드폰 연락처 생년월일 주민등록번호 소속 직위 직급 부서 이메일 팩스 학교 학년 반 번호 신청인 대표자 담당자 작성자 확인자 승인자 "
    "일시 날짜 기간 장소 목적 사유 비고 금액 수량 단가 합계 계 소계 등록기준지 본적 위임인 청구사유 소명자료"
).split()
ENGLISH_LABELS = (
    "name date address tel phone mobile fax email e-mail dept department division title position grade rank birth nationality sex gender signature sign seal remarks note period "
    "place purpose reason amount total sum qty quantity unit no id passport"
).split()
STOPWORDS = "of the and or in".split()
# Units of counts, ends of sentences.
NUMBER_UNITS = "퍼센트 개월 주년 차례 원 명 건 개 회 부 매 장 점 호 번 년 월 일 시 분 초".split()
SENTENCE_ENDS = "입니다|합니다|습니다|하세요|십시오|시오|바랍니다|바람|할 것|할것|하며|하고|한다|된다|됨|음|임"


def is_numeric_value(c: Column) -> Column:
    """A number with an optional ordinal prefix, magnitudes and unit."""
    number = r"(?![.,])(?=[0-9.,]*[0-9])[0-9,]*(?:\.[0-9,]*)?(?<![.,])"
    return c.rlike(rf"^제?{number}[십백천만억조]*(?:{'|'.join(NUMBER_UNITS)})?$")


def has_sentence_ending(c: Column) -> Column:
    return c.rlike(f"(?:{SENTENCE_ENDS})$")


def is_label_cell(text: Column) -> Column:
    """Whether a cell looks like the label of a form field, in Korean or English."""

    def short(t: Column) -> Column:
        words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
        fits = lambda tight: (
            tight.rlike("^[가-힣0-9()（）·:：-]*$") & F.char_length(tight).between(2, 12) & (F.char_length(F.regexp_replace(tight, "[^가-힣]", "")) >= 2)
            & ((F.char_length(tight) <= 8) | (words <= 2)) & ~is_numeric_value(tight) & ~tight.rlike("^(?:\\(주\\)|（주）|주식회사)")
        )
        return let(F.regexp_replace(t, r"(?U)\s", ""), fits) & ~has_sentence_ending(t)

    def english(t: Column) -> Column:
        words = F.transform(
            F.filter(F.split(F.lower(t), r"(?U)[\s/&]"), lambda w: (w != "") & ~w.isin(STOPWORDS)), lambda w: F.regexp_replace(w, r"\.$", "")
        )
        known = let(words, lambda ws: F.size(ws).between(1, 3) & F.forall(ws, lambda w: w.isin(ENGLISH_LABELS)))
        return (F.char_length(t) <= 20) & t.rlike(r"(?U)^[A-Za-z\s./&-]+$") & known

    colon = "(?U)^[가-힣A-Za-z\\s]+[:：]+$"
    label = lambda t: (t != "") & (F.char_length(t) <= 30) & (t.rlike("|".join(LABELS)) | short(t) | t.rlike(colon) | english(t))
    return let(utrim(F.regexp_replace(utrim(F.coalesce(text, F.lit(""))), "[¹²³⁴⁵⁶⁷⁸⁹⁰*※]+$", "")), label)


def is_label_cell_sql(x: str) -> str:
    """For texts without Hangul: the colon rule and the English words."""
    t = utrim_sql(f"regexp_replace({utrim_sql(f'coalesce({x}, chr(32))')}, '[¹²³⁴⁵⁶⁷⁸⁹⁰*※]+$', '')")
    stop, known = (", ".join(f"'{w}'" for w in ws) for ws in (STOPWORDS, ENGLISH_LABELS))
    words = f"list_transform(list_filter(string_split_regex(lower({t}), '[\\s/&]'), lambda w: w <> '' AND w NOT IN ({stop})), lambda w: regexp_replace(w, '\\.$', ''))"
    return (
        f"({t} <> '' AND length({t}) <= 30 AND (regexp_matches({t}, '^[A-Za-z\\s]+[:：]+$') OR (length({t}) <= 20 AND regexp_matches({t}, '^[A-Za-z\\s./&-]+$')"
        f" AND len({words}) BETWEEN 1 AND 3 AND len(list_filter({words}, lambda w: w NOT IN ({known}))) = 0)))"
    )


def decode_entities(c: Column) -> Column:
    """Named entities of HTML text and numeric ones of ASCII letters' range; what isn't known stays."""
    for name, ch in (("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return c


def decode_entities_sql(x: str) -> str:
    for name, code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("apos", 39), ("#39", 39), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({code}))"
    return x
