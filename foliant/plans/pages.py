"""Queries of layout, chunks, outlines, tables and geometry over pages that documents and orders are laid out on, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import vocab
from ..operators import charts, chunks, layout, outline, tables
from ..sources import adapters as A
from ..sources.adapters import table

CLEAN = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def laid_out(documents: DataFrame) -> DataFrame:
    """Documents as pages of twelve lines in three blocks, every third page in two columns, with headers and footers.

    Some lines get a bullet, a number or a hyphen, and heights differ, all by place and length, so that every rule of
    the layout reader meets cases on both sides.
    """
    rows = documents.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("k", "raw"))
    n, k, r, p, b = F.length("raw"), F.col("k"), F.col("k") % 4, F.expr("k div 12 + 1"), F.expr("(k % 12) div 4")
    two = (F.col("doc_id") + p) % 3 == 0
    text = F.when(k % 11 == 0, F.concat(F.lit("1."), (r + 1).cast("string"), F.lit(" "), F.substring(T.normalize(F.col("raw")), 1, 40))).when(k % 7 == 3, F.concat(F.lit("- "), "raw")).when(k % 5 == 1, F.concat("raw", F.lit("-"))).otherwise(F.col("raw"))
    left = F.when(two & (b == 2), 540).otherwise(80) + F.when(r == 3, 60).otherwise(0)
    wide = F.when(two & (b == 0), 700 + n * 7 % 150).otherwise(100 + n * 7 % 250)
    top = F.when(two & (b == 0), 200).when(two, 500).otherwise(200 + 360 * b) + 45 * r
    body = rows.select("doc_id", p.cast("int").alias("page_num"), k.alias("line_ord"), text.alias("text"), left.alias("left"), top.alias("top"), (left + wide).alias("right"), (top + F.when(n % 5 == 0, 40).otherwise(20)).alias("bottom"), (b + 1).cast("int").alias("block_num"), F.expr("(k % 4) div 2").cast("int").alias("par_num"))
    margin = lambda text, ord_, x0, x1, y, block: F.struct(text.alias("text"), F.lit(ord_).alias("line_ord"), F.lit(x0).alias("left"), F.lit(y).alias("top"), F.lit(x1).alias("right"), F.lit(y + 30).alias("bottom"), F.lit(block).alias("block_num"), F.lit(0).alias("par_num"))
    head = F.when(F.col("doc_id") % 4 != 1, margin(F.concat(F.lit("Report "), F.col("doc_id").cast("string")), -1, 300, 500, 20, 90))
    foot = margin(F.concat(F.lit("Page "), F.col("page_num").cast("string")), 999_999, 460, 540, 1340, 91)
    margins = body.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.inline(F.array_compact(F.array(head, foot))))
    return body.unionByName(margins).withColumn("page_width", F.lit(1000)).withColumn("page_height", F.lit(1400))


def layout_blocks(spark, d):
    """Headings, list items and paragraphs of laid-out documents in reading order."""
    items, _ = layout.analyze(laid_out(table(spark, d, "documents")))
    return items.select("doc_id", "page_num", "item_ord", "type", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("ordered", F.lit(False)).alias("ordered"), F.sha2("text", 256).alias("text_sha256"))


def layout_pages(spark, d):
    """Columns, margin lines and markdown of laid-out pages."""
    _, pages = layout.analyze(laid_out(table(spark, d, "documents")))
    return pages.select("doc_id", "page_num", "column_count", F.col("filtered_margin_lines").cast("long").alias("filtered_margin_lines"), F.sha2("markdown", 256).alias("markdown_sha256"))


def _plain(pattern: str) -> str:
    """A pattern without Java's flag for Unicode classes, quoted for SQL."""
    return pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("'", "''")


def _layout(select: str) -> str:
    bullet, ordered, number = _plain(vocab.LIST_BULLET), _plain(vocab.LIST_ORDERED), _plain(vocab.HEADING_NUMBER)
    listed = f"(regexp_matches(t, '{bullet}') OR regexp_matches(t, '{ordered}')) AND regexp_replace(t, CASE WHEN regexp_matches(t, '{bullet}') THEN '{bullet}' ELSE '{ordered}' END, '') != ''"
    return rf"""
    WITH raw AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS ls FROM documents),
    e AS (SELECT doc_id, unnest(ls) AS raw, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS k FROM raw),
    f AS (SELECT *, length(raw) AS n, k % 4 AS r, k // 12 + 1 AS p, (k % 12) // 4 AS b, (doc_id + k // 12 + 1) % 3 = 0 AS two FROM e),
    body AS (SELECT doc_id, p AS page_num, k AS line_ord, CASE WHEN k % 11 = 0 THEN '1.' || (r + 1) || ' ' || substr({CLEAN.format("raw")}, 1, 40) WHEN k % 7 = 3 THEN '- ' || raw WHEN k % 5 = 1 THEN raw || '-' ELSE raw END AS text,
        CASE WHEN two AND b = 2 THEN 540 ELSE 80 END + CASE WHEN r = 3 THEN 60 ELSE 0 END AS x0, CASE WHEN two AND b = 0 THEN 700 + n * 7 % 150 ELSE 100 + n * 7 % 250 END AS wide,
        CASE WHEN two AND b = 0 THEN 200 WHEN two THEN 500 ELSE 200 + 360 * b END + 45 * r AS y0, CASE WHEN n % 5 = 0 THEN 40 ELSE 20 END AS h, b + 1 AS block, r // 2 AS par FROM f),
    pages AS (SELECT DISTINCT doc_id, page_num, count(DISTINCT page_num) OVER (PARTITION BY doc_id) AS n_pages FROM body),
    every AS (SELECT doc_id, page_num, line_ord, {CLEAN.format("text")} AS t, x0, x0 + wide AS x1, y0, y0 + h AS y1, block, par, 'body' AS zone FROM body
        UNION ALL SELECT doc_id, page_num, -1, 'Report ' || doc_id, 300, 500, 20, 50, 90, 0, CASE WHEN n_pages >= 2 THEN 'gone' ELSE 'body' END FROM pages WHERE doc_id % 4 != 1
        UNION ALL SELECT doc_id, page_num, 999999, 'Page ' || page_num, 460, 540, 1340, 1370, 91, 0, 'gone' FROM pages),
    kept AS (SELECT *, {listed} AS is_list FROM every WHERE zone = 'body' AND t != ''),
    base AS (SELECT doc_id, median(y1 - y0) AS tall FROM kept GROUP BY doc_id),
    blk AS (SELECT doc_id, page_num, block, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, max(x1) - min(x0) >= 680 AS wide, tall FROM kept JOIN base USING (doc_id) GROUP BY ALL),
    l AS (SELECT * FROM blk WHERE NOT wide AND x1 <= 680), q AS (SELECT * FROM blk WHERE NOT wide AND x0 >= 320),
    c AS (SELECT doc_id, page_num, max(l.x1) AS inside, min(q.x0) AS outside, bool_or(l.y1 > q.y0 + greatest(12, l.tall * 0.8) AND q.y1 > l.y0 + greatest(12, l.tall * 0.8)) AS beside FROM l JOIN q USING (doc_id, page_num) GROUP BY ALL),
    m AS (SELECT blk.*, coalesce(outside - inside >= 80 AND beside, false) AS cols, CASE WHEN outside - inside >= 80 AND beside THEN (inside + outside) / 2.0 ELSE 500 END AS middle FROM blk LEFT JOIN c USING (doc_id, page_num)),
    o AS (SELECT x.doc_id, x.page_num, x.block, x.cols, count(y.block) AS rank FROM m x LEFT JOIN m y ON x.doc_id = y.doc_id AND x.page_num = y.page_num AND x.block != y.block AND CASE
        WHEN y.y1 <= x.y0 + greatest(8, x.tall * 0.6) THEN true WHEN x.y1 <= y.y0 + greatest(8, x.tall * 0.6) THEN false
        WHEN x.cols AND NOT x.wide AND NOT y.wide AND ((x.x0 + x.x1) / 2.0 >= x.middle) != ((y.x0 + y.x1) / 2.0 >= y.middle) THEN (y.x0 + y.x1) / 2.0 < y.middle ELSE (y.y0, y.x0) < (x.y0, x.x0) END GROUP BY ALL),
    s AS (SELECT kept.*, rank, cols, tall, lag(par) OVER w AS par0, lag(y1) OVER w AS y10, lag(y0) OVER w AS y00, lag(x0) OVER w AS x00, lag(is_list) OVER w AS list0 FROM kept JOIN o USING (doc_id, page_num, block) JOIN base USING (doc_id) WINDOW w AS (PARTITION BY doc_id, page_num, block ORDER BY y0, x0, line_ord)),
    v AS (SELECT *, sum(CASE WHEN par0 IS NULL OR is_list OR par != par0 OR y0 - y10 > greatest(tall * 1.1, (y10 - y00) * 0.9 + 6) OR NOT (list0 OR abs(x0 - x00) <= 40) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, block ORDER BY y0, x0, line_ord) AS part FROM s),
    seg AS (SELECT doc_id, page_num, rank, part, any_value(cols) AS cols, list(t ORDER BY y0, x0, line_ord) AS ts, avg(y1 - y0) / greatest(any_value(tall), 1.0) AS ratio, min(y0) <= 308 AS near_top, abs((min(x0) + max(x1)) / 2.0 - 500) <= 120 AS centered,
        sum(len(string_split(t, ' '))) AS words, count(*) AS n_lines FROM v GROUP BY ALL),
    txt AS (SELECT *, CASE WHEN len(ts) = 1 THEN ts[1] WHEN right(ts[1], 1) = '-' AND lower(left(ts[2], 1)) = left(ts[2], 1) AND upper(left(ts[2], 1)) != left(ts[2], 1) THEN left(ts[1], length(ts[1]) - 1) || ts[2] ELSE ts[1] || ' ' || ts[2] END AS t,
        CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY rank, part) - 1 AS INT) AS item_ord, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, rank, part) = 1 AS is_first FROM seg),
    lev AS (SELECT *, n_lines <= 2 AND words <= 18 AND length(t) <= 120 AND NOT regexp_matches(t, '[.!?。！？;；]$') AS short, regexp_extract(t, '{number}', 1) AS num FROM txt),
    item AS (SELECT *, CASE WHEN NOT short THEN NULL WHEN num != '' THEN least(4, 2 + length(num) - length(replace(num, '.', ''))) WHEN regexp_matches(t, '{_plain(vocab.HEADING_CHAPTER)}') THEN 1 WHEN regexp_matches(t, '{_plain(vocab.HEADING_SECTION)}') THEN 2 WHEN regexp_matches(t, '{_plain(vocab.HEADING_SUBSECTION)}') THEN 3
        WHEN is_first AND near_top AND (ratio >= 1.35 OR centered) THEN 1 WHEN ratio >= 1.7 THEN 2 WHEN ratio >= 1.4 THEN 3 END AS level FROM lev),
    it AS (SELECT doc_id, page_num, item_ord, cols, CAST(level AS INT) AS level, level IS NULL AND {listed} AS li, regexp_matches(t, '{bullet}') AS dot, t FROM item),
    done AS (SELECT doc_id, page_num, item_ord, cols, level, CASE WHEN level IS NOT NULL THEN 'heading' WHEN li THEN 'list_item' ELSE 'paragraph' END AS type, CASE WHEN li THEN NOT dot END AS ordered,
        CASE WHEN li THEN regexp_replace(t, CASE WHEN dot THEN '{bullet}' ELSE '{ordered}' END, '') ELSE t END AS text FROM it),
    shown AS (SELECT *, CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN CASE WHEN ordered THEN '1. ' ELSE '- ' END || text ELSE text END AS line, lag(type) OVER (PARTITION BY doc_id, page_num ORDER BY item_ord) AS before FROM done)
    {select}"""


def page_chunks(spark, d):
    """Pages cut into chunks under their headings."""
    return chunks.text_chunks(A.page_items(table(spark, d, "pages"))).select("doc_id", "ord", F.sha2("text", 256).alias("text_sha256"), F.sha2("title_context", 256).alias("context_sha256"), "char_count")


def layout_items(spark, d):
    """Headings by level, list items and paragraphs of every page."""
    found = A.page_items(table(spark, d, "pages"))
    return found.groupBy("doc_id", "type", F.coalesce("level", F.lit(0)).alias("level")).agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"))


#: Items of HTML pages: a start tag opens one, which reaches to the next start or end tag of its kind.
_ITEMS = r"""
    body AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(h, '(?i)<(h[1-6]|li|p)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(?:h[1-6]|li|p|article)>', chr(3), 'g'), chr(1)) AS ps FROM body),
    piece AS (SELECT doc_id, unnest(ps[2:]) AS x, generate_subscripts(ps[2:], 1) - 1 AS item_ord FROM cut),
    items AS (SELECT doc_id, item_ord, lower(string_split(x, chr(2))[1]) AS tag, trim(regexp_replace(regexp_replace(string_split(string_split(x, chr(2))[2], chr(3))[1], '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM piece)"""

_CHUNKS = f"""
    WITH RECURSIVE {_ITEMS.strip()},
    it AS (SELECT doc_id, item_ord, left(tag, 1) = 'h' AS head, CASE WHEN left(tag, 1) = 'h' THEN CAST(substr(tag, 2) AS INT) END AS level, CASE WHEN tag = 'li' THEN '- ' || text ELSE text END AS line, text FROM items WHERE left(tag, 1) = 'h' OR text != ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_ord) AS k FROM it),
    w AS (SELECT doc_id, k, 0 AS grp, CASE WHEN head THEN 0 ELSE length(line) + 2 END AS size, head FROM k WHERE k = 1
        UNION ALL SELECT k.doc_id, k.k, CASE WHEN k.head OR w.size > 0 AND w.size + length(k.line) > 900 THEN w.grp + 1 ELSE w.grp END, CASE WHEN k.head THEN 0 WHEN w.size > 0 AND w.size + length(k.line) > 900 THEN length(k.line) + 2 ELSE w.size + length(k.line) + 2 END, k.head FROM w JOIN k ON k.doc_id = w.doc_id AND k.k = w.k + 1),
    g AS (SELECT w.doc_id, grp, string_agg(line, ' ' ORDER BY w.k) AS t, min(w.k) AS at FROM w JOIN k USING (doc_id, k) WHERE NOT k.head GROUP BY ALL),
    chain AS (SELECT g.doc_id, grp, string_agg(h.text, ' > ' ORDER BY h.k) FILTER (h.text != '') AS context FROM g JOIN k h ON h.doc_id = g.doc_id AND h.head AND h.k < g.at
        WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id = h.doc_id AND o.head AND o.k > h.k AND o.k < g.at AND o.level <= h.level) GROUP BY ALL),
    whole AS (SELECT g.doc_id, grp, {CLEAN.format("t")} AS t, coalesce(context, '') AS context FROM g LEFT JOIN chain USING (doc_id, grp)),
    cut_at AS (SELECT doc_id, grp, t, context, 0 AS start, CASE WHEN length(t) <= 900 THEN length(t) ELSE {{stop}} END AS stop FROM (SELECT *, 0 AS start FROM whole)
        UNION ALL SELECT doc_id, grp, t, context, start, CASE WHEN length(t) - start <= 900 THEN length(t) ELSE {{stop}} END FROM (SELECT doc_id, grp, t, context, greatest(stop - 120, start + 1) AS start FROM cut_at WHERE stop < length(t))),
    parts AS (SELECT doc_id, grp, start, context, trim(substr(t, start + 1, stop - start)) AS piece FROM cut_at),
    named AS (SELECT *, trim(CASE WHEN context != '' THEN context || chr(10) || chr(10) || piece ELSE piece END) AS text FROM parts WHERE piece != '')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, start) - 1 AS INT) AS ord, sha256(text) AS text_sha256, sha256(context) AS context_sha256, CAST(length(text) AS INT) AS char_count FROM named"""
_LAST = "greatest(" + ", ".join(f"CASE WHEN contains(substr(t, start + 1, 900), '{m}') THEN 901 - instr(reverse(substr(t, start + 1, 900)), '{m}') ELSE 0 END" for m in "。.；; ") + ")"
_CHUNKS = _CHUNKS.replace("{stop}", f"CASE WHEN {_LAST} - 1 > 405 THEN start + {_LAST} ELSE start + 900 END")


#: Lines of a page of a document that is read for its outline.
OUTLINE_LINES = 40


def _outline_lines(spark, d) -> DataFrame:
    return A.document_lines(table(spark, d, "documents")).withColumn("page_num", F.expr(f"line_ord div {OUTLINE_LINES} + 1").cast("int"))


def outlines(spark, d):
    """Outlines that heading-like lines of documents' pages suggest."""
    return outline.inferred(outline.heading_candidates(_outline_lines(spark, d))).select("doc_id", "ord", "title", "page_num")


def document_summaries(spark, d):
    """Summary, topics and validity of a payload of every document."""
    lines = _outline_lines(spark, d)
    text = lines.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", T.normalize(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    found = outline.heading_candidates(lines)
    made = outline.summaries(text, found)
    none = made.select("doc_id", F.lit("report").alias("document_type"), F.create_map().cast("map<string,string>").alias("contract"))
    own = made.select("doc_id", (F.col("doc_id") % 15).cast("int").alias("n"))
    ids = own.select("doc_id", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n")))).alias("ord")).select("doc_id", "ord", F.when(F.col("ord") % 3 == 0, "table").otherwise("text").alias("type"))
    context = outline.rag_context(made, ids.withColumn("chunk_id", F.format_string("chunk_%04d_%s", "ord", "type")))
    out = outline.payload(made, outline.inferred(found), none.filter("doc_id % 2 = 0"), context)
    return out.select("doc_id", F.sha2("summary", 256).alias("summary_sha256"), F.array_join("topics", "|").alias("topics"), F.size("outline").alias("outline_rows"), "fixed_json.document_type", "rag_context.chunk_count", "rag_context.table_chunk_count", F.array_join("rag_context.referenced_chunk_ids", ",").alias("chunk_ids"), "schema_valid")


_PAGED = rf"""lines AS (SELECT doc_id, i - 1 AS line_ord, (i - 1) // {OUTLINE_LINES} + 1 AS page_num, {CLEAN.format("text")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(text) != ''),
    cand AS (SELECT * FROM (SELECT doc_id, page_num, t AS title, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_ord) AS rank FROM lines WHERE t != '' AND length(t) <= 96 AND regexp_matches(t, '{outline.HEADING}')) WHERE rank <= 5),
    outl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, rank) AS ord FROM cand WHERE rank <= 2) WHERE ord <= 24)"""


def box_geometry(spark, d):
    """Boxes from line items: clipped, overlapping, widened, on padded and turned pages."""
    c, i = F.col, lambda x: x.cast("int")
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", i(c("l_partkey") % 190 - 30).alias("x"), i(c("l_suppkey") % 170 - 30).alias("y"), i(c("l_orderkey") % 60).alias("w"), i(c("l_linenumber") * 9 % 50).alias("h"))
    w, h = F.lit(120), F.lit(100)
    a, b = G.clipped(c("x"), c("y"), c("x") + c("w"), c("y") + c("h"), w, h), G.clipped(c("y"), c("x"), c("y") + 40, c("x") + 30, w, h)
    corners = F.array(F.struct(c("x").alias("x"), c("y").alias("y")), F.struct(c("y").alias("x"), c("x").alias("y")), F.struct((c("x") + c("w")).alias("x"), F.lit(7).alias("y")))
    spelled = lambda box: F.coalesce(F.concat_ws(",", *[box[k].cast("string") for k in ("left", "top", "right", "bottom")]), F.lit(""))
    text = lambda box: F.when(box.isNotNull(), spelled(box)).otherwise("none")
    turned = G.turned_back(c("x"), c("y"), c("w"), c("h"), 6, 90.0, (F.lit(112), F.lit(132)), (w, h))
    return own.select(
        "l_orderkey", "l_linenumber", text(a).alias("clipped"), F.coalesce(G.area(a), F.lit(0)).alias("area"), F.floor(F.coalesce(G.iou(a, b), F.lit(0.0)) * 1000).cast("long").alias("iou_thousandths"), G.overlap(c("x"), c("x") + c("w"), c("y"), c("y") + 40).alias("shared"),
        text(G.expanded(a, 10, 8, w, h)).alias("expanded"), text(G.unpadded(c("x"), c("y"), c("w"), c("h"), 5, w, h)).alias("unpadded"), text(G.of_points(corners, w, h)).alias("around"), text(turned).alias("turned"),
    )


def _box_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    at = lambda v, m: f"CAST(round_even(CAST(greatest(0, least({v}, {m})) AS DOUBLE), 0) AS INT)"
    a, b, c, e = at(x0, 120), at(y0, 100), at(x1, 120), at(y1, 100)
    return f"CASE WHEN {c} > {a} AND {e} > {b} THEN [{a}, {b}, {c}, {e}] END"


_TEXT_OF = "CASE WHEN {0} IS NULL THEN 'none' ELSE array_to_string({0}, ',') END"
#: A quarter turn back: offsets from the middle of the turned page (112 x 132), on the page (120 x 100).
_TURN = "SELECT *, [x - 6, x - 6 + w] AS xs, [y - 6, y - 6 + h] AS ys FROM own"
_BOXES = f"""
    WITH own AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 190 - 30 AS INT) AS x, CAST(l_suppkey % 170 - 30 AS INT) AS y, CAST(l_orderkey % 60 AS INT) AS w, CAST(l_linenumber * 9 % 50 AS INT) AS h FROM lineitem),
    t AS ({_TURN}),
    b AS (SELECT *, {_box_sql("x", "y", "x + w", "y + h")} AS a, {_box_sql("y", "x", "y + 40", "x + 30")} AS o, {_box_sql("x - 5", "y - 5", "x + w - 5", "y + h - 5")} AS u,
        {_box_sql("list_min([x, y, x + w])", "list_min([y, x, 7])", "list_max([x, y, x + w])", "list_max([y, x, 7])")} AS p, {_box_sql("60 - (ys[2] - 66)", "50 + (xs[1] - 56)", "60 - (ys[1] - 66)", "50 + (xs[2] - 56)")} AS r FROM t),
    m AS (SELECT *, {_box_sql("a[1] - 10", "a[2] - 8", "a[3] + 10", "a[4] + 8")} AS e, (a[3] - a[1]) * (a[4] - a[2]) AS area_a, (o[3] - o[1]) * (o[4] - o[2]) AS area_o,
        greatest(0, least(a[3], o[3]) - greatest(a[1], o[1])) * greatest(0, least(a[4], o[4]) - greatest(a[2], o[2])) AS meet FROM b)
    SELECT l_orderkey, l_linenumber, {_TEXT_OF.format("a")} AS clipped, CAST(coalesce(area_a, 0) AS INT) AS area, CAST(floor(CASE WHEN a IS NULL OR o IS NULL THEN 0 ELSE CAST(meet AS DOUBLE) / (area_a + area_o - meet) * 1000 END) AS BIGINT) AS iou_thousandths,
        CAST(greatest(0, least(x + w, y + 40) - greatest(x, y)) AS INT) AS shared, CASE WHEN a IS NULL THEN 'none' ELSE {_TEXT_OF.format("e")} END AS expanded, {_TEXT_OF.format("u")} AS unpadded, {_TEXT_OF.format("p")} AS around, {_TEXT_OF.format("r")} AS turned FROM m"""


def _order_tables(spark, d) -> DataFrame:
    """Orders as tables with an empty column, short and empty rows, and signs that files must escape."""
    c = F.col
    line = F.array(F.concat(F.lit(" part  "), c("l_partkey").cast("string")), F.lit(""), F.when(c("l_linenumber") % 2 == 0, F.lit('say "x", <y> & z')).otherwise(F.lit("a|b")), F.format_string("%d", c("l_quantity").cast("int")))
    line = F.when(c("l_linenumber") % 3 == 0, F.slice(line, 1, 3)).when(c("l_linenumber") == 7, F.array(F.lit(" "), F.lit(""))).otherwise(line)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("r")))), lambda x: x["r"]).alias("body"))
    head = F.array(F.array(*map(F.lit, ("Item", "", "Note's", "Qty"))))
    return rows.select(c("l_orderkey").alias("doc_id"), F.lit("page_001_table_01").alias("table_id"), F.lit(1).alias("page_num"), F.concat(head, "body").alias("rows"))


def table_exports(spark, d):
    """Orders' tables without empty rows and columns, as CSV, HTML and markdown."""
    own = _order_tables(spark, d).withColumn("rows", tables.normalized(F.col("rows")))
    rows = F.col("rows")
    return own.select("doc_id", F.size("rows").alias("row_count"), F.size(F.get("rows", F.lit(0))).alias("col_count"), F.sha2(tables.csv(rows), 256).alias("csv_sha256"), F.sha2(tables.html(rows), 256).alias("html_sha256"), F.sha2(tables.markdown(rows), 256).alias("markdown_sha256"))


_EXPORTS = r"""
    WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, 'part ' || l_partkey AS a, CASE WHEN l_linenumber % 2 = 0 THEN 'say "x", <y> & z' ELSE 'a|b' END AS b, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) END AS c FROM lineitem WHERE l_linenumber != 7
        UNION ALL SELECT DISTINCT l_orderkey, 0, 'Item', 'Note''s', 'Qty' FROM lineitem),
    e AS (SELECT *, CASE WHEN k = 0 THEN 'th' ELSE 'td' END AS tag, CASE WHEN b LIKE '%"%' THEN '"' || replace(b, '"', '""') || '"' ELSE b END AS quoted, replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe, replace(b, '|', '\|') AS bar FROM r)
    SELECT doc_id, CAST(count(*) AS INT) AS row_count, 3 AS col_count, sha256(string_agg(a || ',' || quoted || ',' || c || chr(13) || chr(10), '' ORDER BY k, a, c)) AS csv_sha256,
        sha256('<table>' || string_agg('<tr><' || tag || '>' || a || '</' || tag || '><' || tag || '>' || safe || '</' || tag || '><' || tag || '>' || c || '</' || tag || '></tr>', '' ORDER BY k, a, c) || '</table>') AS html_sha256,
        sha256(string_agg('| ' || a || ' | ' || bar || ' | ' || c || ' |' || CASE WHEN k = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY k, a, c)) AS markdown_sha256 FROM e GROUP BY doc_id"""


def chart_answers(spark, d):
    """Five questions about each year's table of months and two priorities, beside a plain table that is no chart."""
    c = F.col
    sums = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("doc_id"), F.month("o_orderdate").alias("m")).agg(*[F.sum(F.when(c("o_orderpriority") == p, F.floor(c("o_totalprice") / 1000) % 900)).cast("long").alias(f"v{i}") for i, p in enumerate(("1-URGENT", "5-LOW"))])
    cell = lambda v: F.coalesce((v % 997).cast("string"), F.lit(""))
    body = lambda *cols: F.transform(F.array_sort(F.collect_list(F.struct("m", F.array(F.format_string("m%02d", c("m")), *cols).alias("r")))), lambda x: x["r"])
    heads = lambda *names: F.array(F.array(*map(F.lit, names)))
    by_year = sums.groupBy(c("doc_id").cast("long").alias("doc_id")).agg(body(cell(c("v0")), cell(c("v1"))).alias("two"), body(cell(c("v1"))).alias("one"))
    own = by_year.select("doc_id", F.inline(F.array(
        F.struct(F.lit("t1").alias("table_id"), F.lit(1).alias("page_num"), F.concat(heads("Code", "Urgent"), "one").alias("rows")), F.struct(F.lit("t2").alias("table_id"), F.lit(2).alias("page_num"), F.concat(heads("Month", "Urgent", "Low"), "two").alias("rows")))))
    asked = ("Which month has the highest Low value?", "lowest Urgent", "What is the sum of Low?", "How is the trend of Urgent?", "Tell me about it", " ")
    questions = by_year.select("doc_id", F.posexplode(F.array(*map(F.lit, asked))).alias("i", "query")).select((c("doc_id") * 10 + c("i")).alias("query_id"), "doc_id", "query")
    found = charts.points(own)
    return charts.answer(questions, found, charts.series(found), charts.candidates(own, found)).select("query_id", "status", "answer", "table_id", "name", "confidence")


_CHARTS = """
    WITH p AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(floor(o_totalprice / 1000) % 900) FILTER (o_orderpriority = '1-URGENT') AS u, sum(floor(o_totalprice / 1000) % 900) FILTER (o_orderpriority = '5-LOW') AS l FROM orders GROUP BY ALL),
    s AS (SELECT y, 'm' || lpad(m::VARCHAR, 2, '0') AS label, m, 'Urgent' AS name, CAST(CAST(u AS BIGINT) % 997 AS DOUBLE) AS v FROM p WHERE u IS NOT NULL UNION ALL SELECT y, 'm' || lpad(m::VARCHAR, 2, '0'), m, 'Low', CAST(CAST(l AS BIGINT) % 997 AS DOUBLE) FROM p WHERE l IS NOT NULL),
    a AS (SELECT y, name, count(*) AS n, arg_max(label, (v, -m)) AS hi, max(v) AS hv, arg_min(label, (v, m)) AS lo, min(v) AS lv, sum(v) AS total, arg_min(label, m) AS f, arg_max(label, m) AS g, arg_max(v, m) - arg_min(v, m) AS delta FROM s GROUP BY ALL),
    q(i, name) AS (VALUES (0, 'Low'), (1, 'Urgent'), (2, 'Low'), (3, 'Urgent'), (4, 'Urgent'))
    SELECT CAST(y * 10 + i AS BIGINT) AS query_id, 'ok' AS status, CASE i WHEN 0 THEN hi || ' has the max Low value: ' || hv || '.' WHEN 1 THEN lo || ' has the min Urgent value: ' || lv || '.' WHEN 2 THEN 'The total Low value is ' || total || '.'
        WHEN 3 THEN 'Urgent is ' || CASE WHEN delta > 0 THEN 'increasing' WHEN delta < 0 THEN 'decreasing' ELSE 'flat' END || ' from ' || f || ' to ' || g || ' (delta ' || delta || ').' ELSE name || ' has ' || n || ' points; the highest visible value is ' || hi || ' at ' || hv || '.' END AS answer,
        't2' AS table_id, name, CAST(0.74 AS DOUBLE) AS confidence FROM a JOIN q USING (name)
    UNION ALL SELECT DISTINCT CAST(y * 10 + 5 AS BIGINT), 'error', '', NULL, NULL, 0.0 FROM p"""


QUERIES = {f.__name__: f for f in (layout_blocks, layout_pages, page_chunks, layout_items, outlines, document_summaries, box_geometry, table_exports, chart_answers)}

ORACLES = {
    "layout_blocks": _layout("SELECT doc_id, page_num, item_ord, type, coalesce(level, 0) AS level, coalesce(ordered, false) AS ordered, sha256(text) AS text_sha256 FROM done"),
    "layout_pages": _layout("""SELECT a.doc_id, a.page_num, CASE WHEN coalesce(cols, false) THEN 2 ELSE 1 END AS column_count, gone AS filtered_margin_lines, sha256(coalesce(md, '_No structured text detected._')) AS markdown_sha256
        FROM (SELECT doc_id, page_num, count(*) FILTER (zone = 'gone') AS gone FROM every WHERE t != '' GROUP BY ALL) a LEFT JOIN (SELECT doc_id, page_num, bool_or(cols) AS cols,
            string_agg(CASE WHEN before IS NULL THEN '' WHEN before = 'list_item' AND type = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END || line, '' ORDER BY item_ord) AS md FROM shown GROUP BY ALL) b USING (doc_id, page_num)"""),
    "page_chunks": _CHUNKS,
    "layout_items": f"WITH {_ITEMS.strip()} SELECT doc_id, CASE WHEN tag = 'li' THEN 'list_item' WHEN tag = 'p' THEN 'paragraph' ELSE 'heading' END AS type, CASE WHEN left(tag, 1) = 'h' THEN CAST(substr(tag, 2) AS INT) ELSE 0 END AS level, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars FROM items GROUP BY 1, 2, 3",
    "outlines": f"WITH {_PAGED} SELECT doc_id, CAST(ord AS INT) AS ord, title, CAST(page_num AS INT) AS page_num FROM outl",
    "document_summaries": f"""WITH {_PAGED},
        whole AS (SELECT doc_id, {CLEAN.format("string_agg(t, ' ' ORDER BY line_ord)")} AS t FROM lines GROUP BY doc_id),
        top AS (SELECT doc_id, string_agg(title, '|' ORDER BY page_num, rank) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, rank) AS r FROM (SELECT doc_id, title, min((page_num, rank)) AS at, min(page_num) AS page_num, arg_min(rank, (page_num, rank)) AS rank FROM cand GROUP BY doc_id, title)) WHERE r <= 8 GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM outl GROUP BY doc_id), docs AS (SELECT DISTINCT doc_id FROM lines),
        ids AS (SELECT doc_id, unnest(range(1, doc_id % 15 + 1)) AS o FROM docs),
        ctx AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (o % 3 = 0) AS tabs, string_agg('chunk_' || lpad(o::VARCHAR, 4, '0') || CASE WHEN o % 3 = 0 THEN '_table' ELSE '_text' END, ',' ORDER BY o) FILTER (o <= 12) AS chunk_ids FROM ids GROUP BY doc_id)
        SELECT doc_id, sha256(CASE WHEN length(whole.t) <= 520 THEN whole.t ELSE rtrim(substr(whole.t, 1, 519)) || '…' END) AS summary_sha256, coalesce(topics, '') AS topics, CAST(coalesce(n, 0) AS INT) AS outline_rows, CASE WHEN doc_id % 2 = 0 THEN 'report' ELSE '' END AS document_type,
            coalesce(chunks, 0) AS chunk_count, coalesce(tabs, 0) AS table_chunk_count, coalesce(chunk_ids, '') AS chunk_ids, true AS schema_valid FROM whole LEFT JOIN top USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN ctx USING (doc_id)""",
    "box_geometry": _BOXES,
    "table_exports": _EXPORTS,
    "chart_answers": _CHARTS,
}
