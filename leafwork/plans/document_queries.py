"""Queries of the document operators over the driver's tables. Keys begin with the operator they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.operators import chunks, markdown, post, tables
from leafwork.operators.blocks import fragment_sql, with_fragments
from leafwork.plans import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _markdown_sql(source: str, name: str) -> str:
    frag = fragment_sql()
    return f"""WITH {source}, f AS (SELECT doc_id, idx, {frag} AS frag FROM {name})
        SELECT doc_id, {T.utrim_sql("string_agg(frag, '' ORDER BY idx)")} AS markdown FROM f GROUP BY doc_id"""


@query(_markdown_sql(A.HTML_BLOCKS_SQL, "html_blocks"))
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks_to_markdown(A.html_blocks(spark, sf_dir))


@query(_markdown_sql(A.LINE_BLOCKS_SQL, "line_blocks"))
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks_to_markdown(A.line_blocks(spark, sf_dir))


@query(f"WITH {A.LINE_BLOCKS_SQL} SELECT doc_id, idx, {T.escape_gfm_sql('text')} AS escaped, {T.sanitize_sql('text')} AS visible FROM line_blocks")
def escape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.line_blocks(spark, sf_dir)
    return rows.select("doc_id", "idx", T.escape_gfm(F.col("text")).alias("escaped"), T.sanitize(F.col("text")).alias("visible"))


@query(f"SELECT page_id, {T.escape_html_cell_sql('html')} AS cell, {T.decode_entities_sql('html')} AS decoded FROM pages")
def escape_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "pages").select("page_id", T.escape_html_cell(F.col("html")).alias("cell"), T.decode_entities(F.col("html")).alias("decoded"))


HREFS = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '#' || url WHEN 2 THEN 'javascript:' || url ELSE ' MAILTO:' || substr(html, 1, 60) END"


@query(f"SELECT page_id, {T.safe_href_sql(HREFS)} AS href FROM pages")
def href_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "pages").select("page_id", T.safe_href(F.expr(HREFS)).alias("href"))


_FILLED = """filled AS (SELECT *, coalesce(last_value(page_number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING),
            first_value(page_number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS page FROM turn_blocks)"""
_PAGES = f"""WITH {A.TURN_BLOCKS_SQL}, {_FILLED},
        f AS (SELECT doc_id, idx, page, {fragment_sql(("heading", "paragraph"))} AS frag FROM filled WHERE page IS NOT NULL),
        g AS (SELECT doc_id, page, {T.utrim_sql("string_agg(frag, '' ORDER BY idx)")} AS markdown FROM f GROUP BY ALL),
        s AS (SELECT doc_id, unnest(range(min(page), max(page) + 1)) AS page_number FROM g GROUP BY doc_id),
        pages_out AS (SELECT s.doc_id, page_number, coalesce(markdown, '') AS markdown FROM s LEFT JOIN g ON s.doc_id = g.doc_id AND s.page_number = g.page)"""


@query(_PAGES + " SELECT * FROM pages_out")
def pages_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks_to_pages(A.turn_blocks(spark, sf_dir)).drop("error")


@query(f"""WITH {A.TURN_BLOCKS_SQL}, e AS (SELECT doc_id, idx AS ord, CASE doc_id % 3 WHEN 0 THEN idx + 1 WHEN 1 THEN idx // 2 + 1 ELSE idx END AS page FROM turn_blocks),
        checked AS (SELECT *, page < 1 OR page <= lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS bad FROM e)
        SELECT doc_id, CASE WHEN bool_or(coalesce(bad, false)) THEN 'PARSE_ERROR' END AS code FROM checked GROUP BY doc_id""")
def evidence_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers given beside conversations: rising ones, ones that come twice, and ones that begin at zero."""
    turn, third = F.col("idx"), F.col("doc_id") % 3
    page = F.when(third == 0, turn + 1).when(third == 1, F.floor(turn / 2) + 1).otherwise(turn)
    given = A.turn_blocks(spark, sf_dir).select("doc_id", turn.alias("ord"), page.cast("long").alias("page_number"))
    return markdown.check_evidence(given).select("doc_id", "error.code")


@query(_PAGES + " SELECT * FROM pages_out WHERE page_number IN (1, 2, 4)")
def pages_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.select_pages(markdown.blocks_to_pages(A.turn_blocks(spark, sf_dir)).drop("error"), [1.4, 1.5, 3.5, 0.6])


@query(_PAGES + ", m AS (SELECT doc_id, max(page_number) AS last FROM pages_out GROUP BY 1) SELECT p.* FROM pages_out p JOIN m USING (doc_id) WHERE page_number = 1 OR page_number BETWEEN 3 AND least(5, last)")
def pages_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.select_page_list(markdown.blocks_to_pages(A.turn_blocks(spark, sf_dir)).drop("error"), "1abc, 3-5, 9-7")


@query(f"""WITH {A.TURN_BLOCKS_SQL}, {_FILLED}
        SELECT doc_id, page AS page_number, concat_ws('|', count(*)::VARCHAR, min(idx)::VARCHAR, max(idx)::VARCHAR) AS markdown FROM filled WHERE page IS NOT NULL GROUP BY ALL""")
def pages_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's renderer: the number of blocks, the first and the last."""
    render = lambda b: F.concat_ws("|", F.size(b), F.array_min(b)["idx"], F.array_max(b)["idx"])
    return markdown.blocks_to_pages(A.turn_blocks(spark, sf_dir), render).where("markdown <> ''").drop("error")


@query(f"""WITH {A.TURN_BLOCKS_SQL}, {_FILLED}
        SELECT doc_id, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page_number) AS known FROM filled WHERE page IS NOT NULL GROUP BY doc_id""")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markdown.page_of_blocks(A.turn_blocks(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.countDistinct("page_number").alias("known"))


def _chunks_sql(source: str, name: str, kinds: tuple[str, ...], block: bool = False) -> str:
    level = "CASE WHEN level IS NULL OR level = 0 THEN 2 ELSE least(greatest(level, 1), 6) END"
    before = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    heads = ", ".join(f"last_value(CASE WHEN rank = {n} THEN idx END IGNORE NULLS) {before} AS i{n}, last_value(CASE WHEN rank = {n} THEN own END IGNORE NULLS) {before} AS t{n}" for n in range(1, 7))
    lasts = ", ".join(f"coalesce(i{k}, -1)" for k in range(1, 7))
    kept = []
    for n in range(1, 7):
        lower = "greatest(-1" + "".join(f", coalesce(i{k}, -1)" for k in range(1, n)) + ")"
        kept.append(f"CASE WHEN i{n} > {lower} AND (rank IS NULL OR {n} < rank) THEN t{n} END")
    mark = T.is_list_marker_sql("text")
    return f"""WITH {source}, f AS (SELECT *, {fragment_sql(kinds)} AS frag, {T.utrim_sql("text")} AS own, CASE WHEN kind = 'heading' THEN {level} END AS rank,
            CASE WHEN kind = 'list' OR (kind = 'paragraph' AND {mark}) THEN 0 END AS depth FROM {name}),
        w AS (SELECT *, {heads}, last_value(CASE WHEN depth = 0 THEN idx END IGNORE NULLS) {before} AS li, last_value(CASE WHEN depth = 0 THEN own END IGNORE NULLS) {before} AS lt
            FROM f WHERE {T.utrim_sql("frag")} <> ''),
        c AS (SELECT *, list_filter([{", ".join(kept)}, CASE WHEN kind <> 'heading' AND depth IS NULL AND li > greatest({lasts}) THEN lt END], lambda x: x IS NOT NULL) AS breadcrumb FROM w),
        s AS (SELECT *, CASE WHEN {'false AND' if block else ''} kind <> 'heading' AND lag(kind) OVER o <> 'heading' AND breadcrumb = lag(breadcrumb) OVER o THEN 0 ELSE 1 END AS starts
            FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
        r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM s)
        SELECT doc_id, concat('c', lpad(run::INT::VARCHAR, greatest(4, length(run::INT::VARCHAR))::INT, '0')) AS id, CASE WHEN bool_or(kind = 'heading') THEN 'heading' ELSE 'text' END AS type,
            array_to_string(first(breadcrumb ORDER BY idx), ' > ') AS breadcrumb, {T.utrim_sql("string_agg(frag, '' ORDER BY idx)")} AS text, min(idx) AS first_block, max(idx) AS last_block
        FROM r GROUP BY doc_id, run"""


def _chunk_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "id", "type", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "text", "first_block", "last_block")


@query(_chunks_sql(A.HTML_BLOCKS_SQL, "html_blocks", ("heading", "list", "paragraph")))
def chunks_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunks.blocks_to_chunks(A.html_blocks(spark, sf_dir)))


@query(_chunks_sql(A.LINE_BLOCKS_SQL, "line_blocks", ("heading", "paragraph")))
def chunks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunks.blocks_to_chunks(A.line_blocks(spark, sf_dir)))


@query(_chunks_sql(A.TURN_BLOCKS_SQL, "turn_blocks", ("heading", "paragraph"), True))
def chunks_turns_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunks.blocks_to_chunks(A.turn_blocks(spark, sf_dir), "block"))


@query(f"WITH {A.LINE_BLOCKS_SQL} SELECT doc_id, idx, {T.is_list_marker_sql('text')} AS marked, {T.is_label_cell_sql('text')} AS label FROM line_blocks")
def marks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.line_blocks(spark, sf_dir).select("doc_id", "idx", T.is_list_marker(F.col("text")).alias("marked"), T.is_label_cell(F.col("text")).alias("label"))


_GFM = f"""WITH {A.ORDER_CELLS_SQL}, l AS (SELECT table_id, r, concat('| ', string_agg({T.escape_gfm_sql("text")}, ' | ' ORDER BY c), ' |', CASE WHEN r = 0 THEN concat(chr(10), '| --- | --- | --- | --- | --- |') ELSE '' END) AS line
            FROM order_cells GROUP BY table_id, r),
        md AS (SELECT table_id, string_agg(line, chr(10) ORDER BY r) AS markdown FROM l GROUP BY table_id)"""


@query(_GFM + " SELECT * FROM md")
def table_gfm_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_gfm(A.order_tables(spark, sf_dir))


def _spanned(tables: DataFrame) -> DataFrame:
    """Every table with its first two header cells merged, and the last cell of its first line over all lines below."""
    last = F.array_max(F.transform("cells", lambda x: x["r"]))
    wide = lambda x: F.when((x["r"] == 0) & (x["c"] == 0), 2).otherwise(1).alias("col_span")
    high = lambda x: F.when((x["r"] == 1) & (x["c"] == 4), F.col("last")).otherwise(1).alias("row_span")
    spanned = F.transform("cells", lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"), x["text"].alias("text"), wide(x), high(x)))
    return tables.withColumn("last", last).select("table_id", spanned.alias("cells"))


_TAG = "CASE WHEN r = 0 THEN 'th' ELSE 'td' END"


@query(f"""WITH {A.ORDER_CELLS_SQL}, m AS (SELECT *, max(r) OVER (PARTITION BY table_id) AS last FROM order_cells),
        l AS (SELECT table_id, r, concat('<tr>', string_agg(concat('<', {_TAG}, CASE WHEN r = 0 AND c = 0 THEN ' colspan="2"' WHEN r = 1 AND c = 4 AND last > 1 THEN concat(' rowspan="', last, '"') ELSE '' END, '>',
                {T.escape_html_cell_sql(T.sanitize_sql("text"))}, '</', {_TAG}, '>'), '' ORDER BY c), '</tr>', chr(10)) AS line
            FROM m WHERE NOT (r = 0 AND c = 1) AND NOT (r > 1 AND c = 4) GROUP BY table_id, r)
        SELECT table_id, concat('<table>', chr(10), string_agg(line, '' ORDER BY r), '</table>') AS markdown FROM l GROUP BY table_id""")
def table_html_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_html(_spanned(A.order_tables(spark, sf_dir)))


@query(f"WITH {A.ORDER_CELLS_SQL} SELECT table_id, max(r) + 1 AS rows, max(c) + 1 AS cols, count(*) = (max(r) + 1) * (max(c) + 1) AS sound FROM order_cells GROUP BY table_id")
def table_shape_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.shape(A.order_tables(spark, sf_dir)).select("table_id", "rows", "cols", F.col("error").isNull().alias("sound"))


@query(f"WITH {A.ORDER_CELLS_SQL} SELECT table_id, r, c, {T.cell_type_sql('text')} AS type FROM order_cells")
def cell_types_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.order_cells(spark, sf_dir).select("table_id", "r", "c", T.cell_type(F.col("text")).alias("type"))


_R2 = "sign({x} * 100.0) * floor(abs({x} * 100.0) + 0.5) / 100.0"


@query(f"""WITH {A.ORDER_CELLS_SQL}, t AS (SELECT *, {T.cell_type_sql("text")} AS type FROM order_cells),
        g AS (SELECT table_id, max(r) + 1 AS rows, count_if(type <> 'empty')::DOUBLE / count(*) AS a FROM t GROUP BY table_id),
        l AS (SELECT table_id, r, string_agg(concat(c, ':', CASE WHEN type = 'long' THEN 'short' ELSE type END), '|' ORDER BY c) AS sig FROM t WHERE r > 0 AND type <> 'empty' GROUP BY ALL),
        m AS (SELECT table_id, max(n) AS mode, sum(n) AS lines FROM (SELECT table_id, sig, count(*) AS n FROM l GROUP BY ALL) GROUP BY table_id),
        k AS (SELECT table_id, c, max(n)::DOUBLE / sum(n) AS share FROM (SELECT table_id, c, type, count(*) AS n FROM t WHERE r > 0 AND type <> 'empty' GROUP BY ALL) GROUP BY table_id, c HAVING sum(n) >= 2),
        cc AS (SELECT table_id, list_reduce(list_prepend(0.0::DOUBLE, list(share ORDER BY c)), lambda x, y: x + y) / count(*) AS cc FROM k GROUP BY table_id),
        j AS (SELECT table_id, a, CASE WHEN rows >= 3 THEN mode::DOUBLE / lines * CASE WHEN lines < 2 THEN 0.5 ELSE 1.0 END ELSE 0.0 END AS rep, coalesce(cc, 0.0) AS cc FROM g JOIN m USING (table_id) LEFT JOIN cc USING (table_id)),
        s AS (SELECT *, least((0.35::DOUBLE * rep + 0.25::DOUBLE + 0.2::DOUBLE * least(a / 0.7::DOUBLE, 1.0) + 0.2::DOUBLE * cc) * (1.0 - 0.6::DOUBLE * greatest(1.0 - a - 0.2::DOUBLE, 0.0) / 0.8::DOUBLE), 1.0) AS s FROM j)
        SELECT table_id, CASE WHEN s >= 0.55 THEN 'semantic-table' ELSE 'uncertain' END AS kind, {_R2.format(x="s")} AS semantic_score, {_R2.format(x="least(abs(s), 1.0)")} AS confidence, 0.0::DOUBLE AS non_tabular_score,
            array_to_string(list_filter([CASE WHEN rep >= 0.6 THEN 'repeated-row-schema' END, 'grid-regularity', CASE WHEN a >= 0.7 THEN 'high-active-density' END, CASE WHEN cc >= 0.75 THEN 'column-type-consistency' END,
                CASE WHEN s < 0.35 THEN 'low-evidence' WHEN s < 0.55 THEN 'ambiguous-scores' END], lambda x: x IS NOT NULL), ' ') AS reasons FROM s""")
def classify_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.classify(A.order_tables(spark, sf_dir))
    return rows.withColumn("reasons", F.array_join("reasons", " "))


_SPANNED = f"""WITH {A.ORDER_CELLS_SQL}, o AS (SELECT *, max(r) OVER (PARTITION BY table_id) AS last FROM order_cells),
        t AS (SELECT table_id, r, c, {T.cell_type_sql("text")} AS type, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END AS w, CASE WHEN r = 1 AND c = 4 THEN last ELSE 1 END AS h
            FROM o WHERE NOT (r = 0 AND c = 1) AND NOT (r > 1 AND c = 4)),
        g AS (SELECT table_id, max(r + h) AS rows, max(c + w) AS cols, count(*) AS anchors, sum(CASE WHEN type <> 'empty' THEN w * h ELSE 0 END)::DOUBLE AS active, count_if(r > 0) AS body,
            count_if(r > 0 AND (w > 1 OR h > 1)) AS merged, count_if((w = 1 AND h = 1) OR (r = 0 AND h = 1)) AS regular FROM t GROUP BY table_id),
        ur AS (SELECT table_id, count(DISTINCT x) AS n FROM (SELECT table_id, unnest(range(r, r + h)) AS x FROM t WHERE type <> 'empty') GROUP BY table_id),
        uc AS (SELECT table_id, count(DISTINCT x) AS n FROM (SELECT table_id, unnest(range(c, c + w)) AS x FROM t WHERE type <> 'empty') GROUP BY table_id),
        n AS (SELECT table_id, r, count(*) AS n, string_agg(concat(c, ':', CASE WHEN type = 'long' THEN 'short' ELSE type END), '|' ORDER BY c) FILTER (type <> 'empty') AS sig FROM t GROUP BY ALL),
        a AS (SELECT table_id, avg(n) AS mean, count(*) AS lines FROM n GROUP BY table_id),
        d AS (SELECT n.table_id, avg(abs(n.n - a.mean)) AS spread FROM n JOIN a USING (table_id) GROUP BY ALL),
        m AS (SELECT table_id, max(k) AS mode, sum(k) AS schemas FROM (SELECT table_id, sig, count(*) AS k FROM n WHERE r > 0 AND sig IS NOT NULL GROUP BY ALL) GROUP BY table_id),
        k AS (SELECT table_id, c, max(x)::DOUBLE / sum(x) AS share FROM (SELECT table_id, c, type, count(*) AS x FROM t WHERE r > 0 AND w = 1 AND type <> 'empty' GROUP BY ALL) GROUP BY table_id, c HAVING sum(x) >= 2),
        cc AS (SELECT table_id, list_reduce(list_prepend(0.0::DOUBLE, list(share ORDER BY c)), lambda x, y: x + y) / count(*) AS cc FROM k GROUP BY table_id),
        j AS (SELECT table_id, rows * cols AS slots, anchors, active / (rows * cols) AS a, (rows - ur.n + cols - uc.n)::DOUBLE / (rows + cols) AS sp, regular::DOUBLE / anchors AS gr, coalesce(cc, 0.0::DOUBLE) AS cc,
                least(merged::DOUBLE / body * 0.7::DOUBLE + least(CASE WHEN lines > 1 THEN spread / greatest(mean, 1.0) ELSE 0.0::DOUBLE END, 1.0) * 0.6::DOUBLE, 1.0) AS si,
                CASE WHEN rows >= 3 AND schemas > 0 THEN mode::DOUBLE / schemas * CASE WHEN schemas < 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS rep
            FROM g JOIN ur USING (table_id) JOIN uc USING (table_id) JOIN a USING (table_id) JOIN d USING (table_id) LEFT JOIN m USING (table_id) LEFT JOIN cc USING (table_id)),
        s AS (SELECT *, greatest((0.6::DOUBLE - a) / 0.6::DOUBLE, 0.0) AS sparse,
            least((0.35::DOUBLE * rep + 0.25::DOUBLE * gr + 0.2::DOUBLE * least(a / 0.7::DOUBLE, 1.0) + 0.2::DOUBLE * cc) * (1.0 - 0.6::DOUBLE * greatest(1.0 - a - 0.2::DOUBLE, 0.0) / 0.8::DOUBLE) * (1.0 - sp) * (1.0 - 0.5::DOUBLE * si), 1.0) AS sem FROM j),
        q AS (SELECT *, least(0.6::DOUBLE * si + 0.4::DOUBLE * sp + 0.5::DOUBLE * sparse, 1.0) AS lay, slots <= 4 OR anchors <= 2 AS little FROM s),
        z AS (SELECT *, CASE WHEN little THEN 'uncertain' WHEN sem >= 0.55 AND sem - lay >= 0.2::DOUBLE THEN 'semantic-table' WHEN lay >= 0.45 AND lay - sem >= 0.15::DOUBLE THEN 'non-tabular-layout' ELSE 'uncertain' END AS kind FROM q)
        SELECT table_id, kind, {_R2.format(x="CASE WHEN little THEN 0.2::DOUBLE ELSE sem END")} AS semantic_score, {_R2.format(x="CASE WHEN little THEN 0.2::DOUBLE ELSE lay END")} AS non_tabular_score,
            {_R2.format(x="CASE WHEN little THEN 0.0::DOUBLE ELSE least(abs(sem - lay), 1.0) END")} AS confidence,
            CASE WHEN little THEN 'low-evidence' ELSE array_to_string(list_filter([CASE WHEN rep >= 0.6 THEN 'repeated-row-schema' END, CASE WHEN gr >= 0.9 THEN 'grid-regularity' END,
                CASE WHEN a >= 0.7 THEN 'high-active-density' END, CASE WHEN cc >= 0.75 THEN 'column-type-consistency' END, CASE WHEN si >= 0.35 THEN 'span-irregularity' END, CASE WHEN sp >= 0.25 THEN 'spacer-bands' END,
                CASE WHEN sparse >= 0.5 THEN 'extreme-sparsity' END, CASE WHEN kind = 'uncertain' AND greatest(sem, lay) < 0.35 THEN 'low-evidence' WHEN kind = 'uncertain' THEN 'ambiguous-scores' END], lambda x: x IS NOT NULL), ' ') END AS reasons
        FROM z"""


@query(_SPANNED)
def classify_spanned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.classify(_spanned(A.order_tables(spark, sf_dir)))
    return rows.withColumn("reasons", F.array_join("reasons", " "))


@query(f"WITH {A.ORDER_CELLS_SQL} SELECT table_id, CASE WHEN table_id % 2 = 0 THEN 'html' ELSE 'gfm' END AS representation FROM order_cells GROUP BY table_id")
def representation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.order_cells(spark, sf_dir)
    spanned = _spanned(A.order_tables(spark, sf_dir).where("table_id % 2 = 0")).select("table_id", F.inline("cells"))
    return tables.representation(cells.where("table_id % 2 = 1").unionByName(spanned))


@query(f"""WITH {A.LINE_BLOCKS_SQL}, k AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 2 THEN 'table' ELSE kind END AS kind, text FROM line_blocks),
        n AS (SELECT doc_id, idx, kind, lag(CASE WHEN kind <> 'table' THEN text END, 2) OVER o AS a, lag(CASE WHEN kind <> 'table' THEN text END) OVER o AS b, lead(CASE WHEN kind <> 'table' THEN text END) OVER o AS c
            FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
        SELECT doc_id, idx, array_to_string(list_filter([a, b, c], lambda x: x IS NOT NULL), chr(10)) AS words FROM n WHERE kind = 'table'""")
def nearby_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = A.line_blocks(spark, sf_dir).withColumn("kind", F.when(F.col("idx") % 3 == 2, "table").otherwise(F.col("kind")))
    return tables.nearby_text(blocks).select("doc_id", "idx", F.array_join("words", "\n").alias("words"))


@query("""WITH g AS (SELECT doc_id AS table_id, text, strlen(text) AS bytes, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents),
        l AS (SELECT table_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM g WHERE breaks > 5 OR bytes > 300)
        SELECT table_id, line, """ + T.utrim_sql("text") + " AS text FROM l WHERE " + T.utrim_sql("text") + " <> ''")
def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the first cell of a table of one row and two columns."""
    docs = A.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), F.lit(0).alias("r"), F.posexplode(F.array(F.col("text"), F.lit(""))).alias("c", "text"))
    return tables.layout_lines(docs).select("table_id", "line", "text")


_SCRIPTED = "concat(chr(32), replace(replace(text, ' the ', ' <sup>2</sup> '), ' of ', ' [a](https://x.y) <u>b</u> <sub>n+1</sub><br></td> '), chr(9))"


@query(f"SELECT doc_id, {post.strip_scripts_sql(_SCRIPTED)} AS stripped, {post.plain_sql(_SCRIPTED.replace('text', f'replace(text, chr(42), chr(43))'))} AS plain FROM documents")
def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scripted(c):
        c = F.replace(F.replace(c, F.lit(" the "), F.lit(" <sup>2</sup> ")), F.lit(" of "), F.lit(" [a](https://x.y) <u>b</u> <sub>n+1</sub><br></td> "))
        return F.concat(F.lit(" "), c, F.lit("\t"))

    text = F.col("text")
    return A.read(spark, sf_dir, "documents").select(
        "doc_id", post.strip_scripts(scripted(text)).alias("stripped"), post.plain(scripted(F.replace(text, F.lit("*"), F.lit("+")))).alias("plain")
    )


_TABLE_TEXT = f"""{_GFM}, h AS (SELECT table_id, list_transform(string_split(markdown, chr(10)), lambda x: list_transform(string_split(x, ' | '), lambda y: replace(replace(y, '| ', ''), ' |', ''))) AS rows FROM md),
        o AS (SELECT table_id, list_transform(list_concat(rows[1:1], rows[3:]), lambda r, i: concat(' <tr>', chr(10), array_to_string(list_transform(r, lambda x: concat('  <', CASE WHEN i = 1 THEN 'th' ELSE 'td' END, '>', chr(10), '   ', x, chr(10), '  </', CASE WHEN i = 1 THEN 'th' ELSE 'td' END, '>', chr(10))), ''), ' </tr>', chr(10))) AS parts FROM h)"""


@query(_TABLE_TEXT + " SELECT table_id, concat('<table>', chr(10), array_to_string(parts, ''), '</table>') AS html FROM o")
def html_tables_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_gfm(A.order_tables(spark, sf_dir)).select("table_id", post.html_tables("markdown").alias("html"))


@query()
def bold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "documents").select("doc_id", F.sha2(post.plain(F.col("text")), 256).alias("plain_sha256"))
