"""Queries of words, review, bundles, consolidation and evidence over inputs that reach both sides of each rule, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import bundles, consolidate, evidence, review, robustness, words, workbench
from ..sources import adapters as A
from ..sources import uploads
from ..sources.adapters import table
from .pages import CLEAN, laid_out


def _any(column: str, hints) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in hints) + ")"


def _recognized(spark, d) -> DataFrame:
    """Line items as words of a recognizer: circles, strokes and blanks among them, some of a turned pass."""
    c = F.col
    k = c("l_partkey") % 9
    text = F.when(k == 0, "O").when(k == 1, "____").when(k == 2, " ").when(k == 3, "x").otherwise(F.concat(F.lit("W-"), c("l_partkey").cast("string")))
    sure = F.when(c("l_suppkey") % 17 == 0, F.lit(None)).otherwise((c("l_suppkey") * 7 % 101).cast("double"))
    left, wide = c("l_linenumber") * 60, F.when(k == 1, 120).otherwise(10 + c("l_partkey") % 20)
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), c("l_linenumber").alias("word_ord"), text.alias("text"), sure.alias("confidence"), left.cast("int").alias("left"), (c("l_orderkey") % 500).cast("int").alias("top"), (left + wide).cast("int").alias("right"),
        (c("l_orderkey") % 500 + 20).cast("int").alias("bottom"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (c("l_suppkey") % 3).cast("int").alias("line_num"), c("l_linenumber").cast("int").alias("word_num"), F.lit("primary").alias("source"), F.when(c("l_suppkey") % 4 == 0, 90.0).otherwise(0.0).alias("angle"),
        c("l_partkey"), c("l_suppkey"),
    )
    return rows.dropDuplicates(["doc_id", "word_ord"])


def _single(spark, d) -> DataFrame:
    """_recognized() of the orders whose line numbers don't repeat, so that a word has one place."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("m")).filter("n = m")
    return _recognized(spark, d).join(rows.select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_semi")


_WORDS = """one AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_linenumber)),
    rec AS (SELECT l_orderkey AS doc_id, l_linenumber AS word_ord, CASE l_partkey % 9 WHEN 0 THEN 'O' WHEN 1 THEN '____' WHEN 2 THEN ' ' WHEN 3 THEN 'x' ELSE 'W-' || l_partkey END AS text, CASE WHEN l_suppkey % 17 = 0 THEN -1 ELSE l_suppkey * 7 % 101 END AS c,
        l_linenumber * 60 AS x0, l_linenumber * 60 + CASE WHEN l_partkey % 9 = 1 THEN 120 ELSE 10 + l_partkey % 20 END AS x1, l_suppkey % 3 AS line, CASE WHEN l_suppkey % 4 = 0 THEN 90 ELSE 0 END AS angle, l_partkey, l_suppkey FROM lineitem SEMI JOIN one USING (l_orderkey))"""


def words_kept(spark, d):
    """Words that pass the filters of confidence, turned passes and graphic artifacts, and why others don't."""
    own = words.filter_artifacts(words.keep_rotated(words.usable(_single(spark, d)).select("*")))
    return own.select("doc_id", "word_ord", words.match_key(F.col("text")).alias("match_key"), F.col("confidence").cast("long").alias("confidence"), F.coalesce("rejected_reason", F.lit("")).alias("rejected_reason"))


_KEPT = f"""
    WITH {_WORDS},
    k AS (SELECT *, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS n FROM rec WHERE trim(text) != ''),
    r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, angle, line) AS alone, (x1 - x0) / 20.0 AS aspect FROM k WHERE angle = 0 OR n >= 2 AND c >= 70 OR n = 1 AND c >= 85 AND text NOT IN ('o', 'O', '0'))
    SELECT doc_id, word_ord, CASE WHEN n > 0 THEN lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) ELSE text END AS match_key, CAST(c AS BIGINT) AS confidence,
        CASE WHEN alone = 1 AND text = 'O' AND aspect BETWEEN 0.6 AND 1.7 AND c < 80 THEN 'circle_like_graphic' WHEN text = '____' AND (aspect >= 5 OR aspect <= 0.2) AND c < 75 THEN 'table_or_shape_line' ELSE '' END AS rejected_reason FROM r"""


def merged_words(spark, d):
    """A second pass, shifted by 0, 10 or 30 of a word's 50 pixels, merged into the first."""
    c = F.col
    base = _single(spark, d).filter("l_partkey % 9 not in (1, 2)").withColumn("right", c("left") + 50).withColumn("confidence", F.coalesce("confidence", F.lit(-1.0)))
    shift = F.element_at(F.array(F.lit(0), F.lit(10), F.lit(30)), (c("l_suppkey") % 3 + 1).cast("int"))
    extra = base.filter("l_partkey % 2 = 0").withColumn("left", c("left") + shift).withColumn("right", c("right") + shift).withColumn("confidence", (c("l_partkey") * 11 % 101).cast("double"))
    extra = extra.withColumn("text", F.when(c("l_suppkey") % 5 == 0, "other").otherwise(F.lower("text"))).withColumn("source", F.lit("sparse_fallback"))
    drop = ("l_partkey", "l_suppkey")
    return words.merge_passes(base.drop(*drop), extra.drop(*drop)).select("doc_id", "word_ord", "text", F.col("confidence").cast("long").alias("confidence"), F.col("left").cast("int").alias("left"), "source")


_MERGED = f"""
    WITH {_WORDS},
    b AS (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 30 END AS s, l_partkey * 11 % 101 AS c2, CASE WHEN l_suppkey % 5 = 0 THEN 'other' ELSE lower(text) END AS t2 FROM rec WHERE l_partkey % 9 NOT IN (1, 2)),
    j AS (SELECT *, l_partkey % 2 = 0 AS has, (50 - s) / (50.0 + s) AS iou, contains(lower(regexp_replace(text, '-', '')), lower(regexp_replace(t2, '-', ''))) OR contains(lower(regexp_replace(t2, '-', '')), lower(regexp_replace(text, '-', ''))) AS agrees FROM b),
    m AS (SELECT *, has AND iou >= 0.55 AND (agrees OR iou >= 0.75) AS copy FROM j),
    w AS (SELECT *, copy AND c2 >= c + 8 AND (agrees OR c < 35) AS won FROM m)
    SELECT doc_id, word_ord, CASE WHEN won THEN t2 ELSE text END AS text, CAST(CASE WHEN won THEN c2 ELSE c END AS BIGINT) AS confidence, CAST(x0 + CASE WHEN won THEN s ELSE 0 END AS INT) AS "left", CASE WHEN won THEN 'sparse_fallback' ELSE 'primary' END AS source FROM w
    UNION ALL SELECT doc_id, word_ord, t2, CAST(c2 AS BIGINT), CAST(x0 + s AS INT), 'sparse_fallback' FROM w WHERE has AND NOT copy"""


def otsu_thresholds(spark, d):
    """Thresholds of fifty histograms over part numbers."""
    bins = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("image_id"), (F.col("l_partkey") * F.col("l_partkey") % 256).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return words.otsu(bins).select("image_id", "threshold")


_OTSU = """
    WITH h AS (SELECT l_orderkey % 50 AS image_id, CAST(l_partkey * l_partkey % 256 AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
    c AS (SELECT *, CAST(sum(n) OVER u AS BIGINT) AS w, CAST(sum(n * bin) OVER u AS BIGINT) AS s, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS w1, CAST(sum(n * bin) OVER (PARTITION BY image_id) AS BIGINT) AS s1 FROM h WINDOW u AS (PARTITION BY image_id ORDER BY bin)),
    v AS (SELECT *, CASE WHEN w1 > w THEN w * (w1 - w) * pow(CAST(s AS DOUBLE) / w - CAST(s1 - s AS DOUBLE) / (w1 - w), 2) END AS v FROM c)
    SELECT image_id, CAST(coalesce(arg_max(bin, (v, -bin)) FILTER (v > 0), 180) AS INT) AS threshold FROM v GROUP BY image_id"""


def _review(spark, d):
    """(lines, doubtful lines, signatures, handwriting) of laid-out documents whose words have the adapters' stand-in confidence."""
    c = F.col
    own = laid_out(table(spark, d, "documents")).filter("line_ord between 0 and 999998").withColumn("line_num", c("line_ord"))
    kind = c("line_ord") % 8
    text = F.when(kind == 2, F.concat(F.lit("Signature: "), F.substring(T.normalize(c("text")), 1, 20))).when(kind == 5, F.concat(F.lit("Address "), "text")).otherwise(c("text"))
    lines = own.withColumn("text", T.normalize(text)).withColumn("confidence", ((c("doc_id") * 31 + c("line_ord") * 17) % 101).cast("double"))
    key = ["doc_id", "page_num", "block_num", "par_num", "line_num"]
    word = F.posexplode(F.split("text", " ")).alias("w", "word")
    sure = ((c("doc_id") * 31 + c("line_num") * 17 + c("w") * 7) % 101).cast("double")
    # a line's words share its box from left to right, apart from all other lines
    seen = lines.select(*key, "left", "top", "right", "bottom", word).withColumn("confidence", F.when(c("w") % 9 == 8, -1.0).otherwise(F.greatest(sure, F.when(c("line_num") % 3 == 0, 90.0).otherwise(0.0))))
    # rounded as in the SQL
    doubtful = review.low_confidence_lines(lines, seen).withColumn("avg_confidence", T.rounded_even(c("mean_confidence"), 2))
    signed = review.signature_regions(lines, doubtful)
    labels = lines.select("doc_id", "page_num").distinct().withColumn("label", F.when(c("doc_id") % 3 == 0, "form").otherwise("report"))
    fields = lines.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.inline(F.array(F.struct(F.lit(1).alias("ord"), F.lit("address").alias("field"), F.lit("Address").alias("label"), F.lit("").alias("value")), F.struct(F.lit(2).alias("ord"), F.lit("name").alias("field"), F.lit("").alias("label"), F.lit("the").alias("value")))))
    return lines, doubtful, signed, review.handwriting_regions(doubtful, signed, labels, fields)


def review_regions(spark, d):
    """Signature and handwriting regions of laid-out documents with their boxes, reasons and fields."""
    _, _, signed, written = _review(spark, d)
    box = lambda: F.concat_ws(",", *[F.col(x).cast("string") for x in ("left", "top", "right", "bottom")])
    one = signed.select("doc_id", "page_num", "line_ord", F.lit("signature").alias("type"), box().alias("box"), F.col("linked").cast("string").alias("detail"), F.lit("").alias("field"), F.lit(-1).cast("long").alias("confidence"))
    two = written.select("doc_id", "page_num", "line_ord", F.lit("handwriting").alias("type"), box().alias("box"), F.col("reason").alias("detail"), F.col("linked_field").alias("field"), F.floor("avg_confidence").cast("long").alias("confidence"))
    return one.unionByName(two)


def review_pages(spark, d):
    """Regions of each kind on every page, and how many of them are queued."""
    lines, doubtful, signed, written = _review(spark, d)
    missing = lines.select("doc_id", "page_num").distinct().filter("doc_id % 5 = 0").select("doc_id", "page_num", F.lit("phone").alias("field"), F.lit("").alias("value"), F.lit(None).cast("double").alias("avg_confidence"), F.lit("important field is empty or missing").alias("reason"))
    counts = review.page_counts(lines, signed, written, missing, doubtful)
    queued = workbench.queue(workbench.region_items(missing, written, signed, doubtful)).groupBy("doc_id", "page_num").agg(F.count("*").alias("queued"))
    return workbench.page_views(counts.select("doc_id", "page_num", "needs_review"), counts).join(queued, ["doc_id", "page_num"], "left").fillna(0, ["queued"])


def _review_sql(select: str) -> str:
    at = lambda v, m: f"CAST(round_even(CAST(greatest(0, least({v}, {m})) AS DOUBLE), 0) AS INT)"
    area = lambda p: f"greatest(0, {p}x1 - {p}x0) * greatest(0, {p}y1 - {p}y0)"
    meet = "greatest(0, least(s.x1, l.x1) - greatest(s.x0, l.x0)) * greatest(0, least(s.y1, l.y1) - greatest(s.y0, l.y0))"
    iou = f"coalesce({meet} / nullif(CAST({area('s.')} + {area('l.')} - {meet} AS DOUBLE), 0), 0)"
    return rf"""
    WITH raw AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS ls FROM documents),
    e AS (SELECT doc_id, unnest(ls) AS raw, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS k FROM raw),
    f AS (SELECT *, length(raw) AS n, k % 4 AS r, k // 12 + 1 AS p, (k % 12) // 4 AS b, (doc_id + k // 12 + 1) % 3 = 0 AS two FROM e),
    g AS (SELECT doc_id, k, p, CASE WHEN k % 11 = 0 THEN '1.' || (r + 1) || ' ' || substr({CLEAN.format("raw")}, 1, 40) WHEN k % 7 = 3 THEN '- ' || raw WHEN k % 5 = 1 THEN raw || '-' ELSE raw END AS t,
        CASE WHEN two AND b = 2 THEN 540 ELSE 80 END + CASE WHEN r = 3 THEN 60 ELSE 0 END AS x0, CASE WHEN two AND b = 0 THEN 700 + n * 7 % 150 ELSE 100 + n * 7 % 250 END AS wide,
        CASE WHEN two AND b = 0 THEN 200 WHEN two THEN 500 ELSE 200 + 360 * b END + 45 * r AS y0, CASE WHEN n % 5 = 0 THEN 40 ELSE 20 END AS h FROM f),
    lines AS (SELECT doc_id, p, k, {CLEAN.format("CASE k % 8 WHEN 2 THEN 'Signature: ' || substr(" + CLEAN.format("t") + ", 1, 20) WHEN 5 THEN 'Address ' || t ELSE t END")} AS t, x0, x0 + wide AS x1, y0, y0 + h AS y1 FROM g),
    w AS (SELECT doc_id, k, i - 1 AS w FROM (SELECT doc_id, k, unnest(range(1, len(string_split(t, ' ')) + 1)) AS i FROM lines)),
    c AS (SELECT doc_id, k, CASE WHEN w % 9 = 8 THEN NULL ELSE greatest((doc_id * 31 + k * 17 + w * 7) % 101, CASE WHEN k % 3 = 0 THEN 90 ELSE 0 END) END AS c FROM w),
    l AS (SELECT lines.*, a AS avg FROM lines JOIN (SELECT doc_id, k, round_even(avg(c), 2) AS a, count(*) FILTER (c < 85) AS low FROM c GROUP BY ALL) USING (doc_id, k) WHERE low > 0 AND t != ''),
    s0 AS (SELECT doc_id, p, k, {at("x0 - 16", 1000)} AS x0, {at("y0 - 16", 1400)} AS y0, {at("x1 + 260.0", 1000)} AS x1, {at("y1 + greatest(54.0, (y1 - y0) * 2.5)", 1400)} AS y1 FROM lines WHERE regexp_matches(t, '{vocab.SIGNATURE}')),
    near AS (SELECT s.*, l.x0 AS lx0, l.y0 AS ly0, l.x1 AS lx1, l.y1 AS ly1, coalesce({iou} >= 0.04, false) AS touches FROM s0 s LEFT JOIN l USING (doc_id, p)),
    s AS (SELECT doc_id, p, k, least(x0, min(lx0) FILTER (touches)) AS x0, least(y0, min(ly0) FILTER (touches)) AS y0, greatest(x1, max(lx1) FILTER (touches)) AS x1, greatest(y1, max(ly1) FILTER (touches)) AS y1, count(*) FILTER (touches) AS linked FROM near GROUP BY doc_id, p, k, x0, y0, x1, y1),
    by_sign AS (SELECT l.doc_id, l.k, bool_or({iou} >= 0.35) AS near FROM l JOIN s USING (doc_id, p) GROUP BY ALL),
    h AS (SELECT l.*, CASE WHEN near THEN 'low-confidence text near signature area' WHEN doc_id % 3 = 0 THEN 'low-confidence line on form-like page' WHEN regexp_matches(t, '{vocab.FIELD_HINT}') THEN 'field-like low-confidence line' WHEN avg < 77 THEN 'generic handwriting candidate' END AS reason
        FROM l LEFT JOIN by_sign USING (doc_id, k) WHERE NOT regexp_matches(t, '{vocab.SIGNATURE}')),
    hw AS (SELECT *, CASE WHEN contains(t, 'Address') THEN 'address' WHEN contains(t, 'the') THEN 'name' ELSE '' END AS field FROM h WHERE reason IS NOT NULL)
    {select.replace("{x0}", at("x0 - 10", 1000)).replace("{y0}", at("y0 - 8", 1400)).replace("{x1}", at("x1 + 10", 1000)).replace("{y1}", at("y1 + 8", 1400))}"""


def _bundle_pages(spark, d) -> DataFrame:
    """Ten documents a bundle, each one page; every third is given a line that starts one."""
    c = F.col
    head = F.when(c("doc_id") % 3 == 0, F.array(F.lit("Annual Report summary"))).when(c("doc_id") % 7 == 1, F.array(F.lit("Tax Invoice"), F.lit("Invoice No: 7"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select(F.expr("doc_id div 10").alias("bundle"), (c("doc_id") % 10).cast("int").alias("page_num"), F.concat(head, F.split("text", "\n")).alias("lines"), (c("doc_id") % 2).cast("int").alias("heading_count"), F.lit(0).alias("paragraph_count"), (c("doc_id") % 5 == 1).cast("int").alias("item_table_count"))


def bundle_documents(spark, d):
    """Bundles of pages, classified page by page from their text, and split."""
    pages = bundles.classify(_bundle_pages(spark, d), "bundle")
    return bundles.segments(bundles.split(pages, "bundle"), "bundle").withColumnRenamed("bundle", "doc_id")


def bundle_pages(spark, d):
    """Label and start score of each page of a bundle, with its first four lines with text."""
    pages = bundles.classify(_bundle_pages(spark, d), "bundle")
    return pages.select(F.col("bundle").alias("doc_id"), "page_num", "label", "hits", F.sha2("top_text", 256).alias("top_sha256"), "start_score")


def consolidated_orders(spark, d):
    """Orders as documents of items, statement lines, forms, contracts or nothing, with their kind and checks."""
    c = F.col
    orders = table(spark, d, "orders")
    docs = orders.select(
        c("o_orderkey").alias("doc_id"), F.when(c("o_orderkey") % 11 == 0, "Your Balance").otherwise("plain").alias("blob"), (c("o_orderkey") % 3).cast("int").alias("page_count"), F.when(c("o_orderkey") % 2 == 0, F.lit(0.5)).alias("tax"),
        F.when(c("o_orderkey") % 4 != 3, F.floor("o_totalprice").cast("double")).alias("total"), (c("o_orderkey") % 5 == 0).alias("has_contract"), F.when(c("o_orderkey") % 7 == 0, F.lit(True)).alias("has_form"), (c("o_orderkey") % 2 == 1).alias("is_bundle"),
    )
    line = table(spark, d, "lineitem")
    cell = lambda x: x.cast("string")
    body = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.array(F.concat(F.lit("part "), cell(c("l_partkey") % 50)), cell(F.floor("l_quantity").cast("int")), F.lit(""), cell(F.floor("l_extendedprice").cast("long") % 1000)).alias("r"))))
    head, foot = F.array(F.array(*map(F.lit, ("Item", "Qty", "Price", "Amount")))), F.array(F.array(*map(F.lit, ("Total", "", "", "7"))))
    tables_ = line.filter("l_orderkey % 6 != 1").groupBy(c("l_orderkey").alias("doc_id")).agg(F.concat(head, F.transform(body, lambda x: x["r"]), foot).alias("rows")).select("doc_id", F.lit("t1").alias("table_id"), F.lit(1).alias("page_num"), "rows")
    receipt = line.filter("l_orderkey % 12 = 1").select(c("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), (c("l_linenumber") * 10_000_000 + c("l_partkey")).cast("long").alias("row_index"), F.concat(F.lit("r"), cell(c("l_partkey") % 50)).alias("description"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("unit_price"), (F.floor("l_extendedprice") % 1000).cast("double").alias("amount"))
    items = consolidate.items_or_receipt(consolidate.items_from_tables(tables_).withColumn("row_index", c("row_index").cast("long")), receipt).withColumn("ord", c("row_index"))
    moves = line.filter("l_orderkey % 13 = 0").select(c("l_orderkey").alias("doc_id"), (c("l_linenumber") * 10_000_000 + c("l_partkey")).cast("long").alias("ord"), F.lit(1).alias("page_num"), F.lit("2026-01-01").alias("date"), F.concat(F.lit("move "), cell(c("l_partkey") % 3)).alias("description"), F.lit(None).cast("double").alias("debit"), F.lit(1.0).alias("credit"), F.lit(1.0).alias("amount"), F.lit(None).cast("double").alias("balance"))
    stated = docs.filter("doc_id % 13 = 0").select("doc_id", F.lit(10.0).alias("opening"), F.lit(12.0).alias("closing"))
    return consolidate.consolidated(docs, items, moves, stated).select("doc_id", "status", "document_kind", "item_count", "duplicate_items", F.col("item_sum").cast("long").alias("item_sum"), "total_check", "transaction_count", "duplicate_transactions", "balance_check")


_ORDERS = """
    WITH t AS (SELECT l_orderkey AS doc_id, 'part' || l_partkey % 50 AS what, CAST(floor(l_quantity) AS INT) AS q, CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS a FROM lineitem WHERE l_orderkey % 6 != 1 UNION ALL SELECT l_orderkey, 'r' || l_partkey % 50, NULL, CAST(floor(l_extendedprice) AS BIGINT) % 1000 FROM lineitem WHERE l_orderkey % 12 = 1),
    u AS (SELECT doc_id, what, q, a, count(*) AS n FROM t GROUP BY ALL),
    i AS (SELECT doc_id, count(*) AS items, sum(n) - count(*) AS dups, sum(a) AS total FROM u GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS moves, sum(n) - count(*) AS mdups FROM (SELECT l_orderkey AS doc_id, l_partkey % 3 AS what, count(*) AS n FROM lineitem WHERE l_orderkey % 13 = 0 GROUP BY ALL) GROUP BY doc_id),
    o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 != 3 THEN floor(o_totalprice) END AS stated, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END AS tax, i.*, m.* EXCLUDE (doc_id) FROM orders LEFT JOIN i ON o_orderkey = i.doc_id LEFT JOIN m ON o_orderkey = m.doc_id)
    SELECT k AS doc_id, CASE WHEN k % 3 > 1 OR items > 0 OR moves > 0 THEN 'ok' ELSE 'skipped' END AS status,
        CASE WHEN moves > 0 OR k % 11 = 0 THEN 'bank_statement' WHEN items > 0 OR stated IS NOT NULL THEN 'invoice_receipt' WHEN k % 5 = 0 THEN 'contract' WHEN k % 7 = 0 THEN 'form' WHEN k % 2 = 1 THEN 'mixed_bundle' ELSE 'generic' END AS document_kind,
        coalesce(items, 0) AS item_count, CAST(coalesce(dups, 0) AS BIGINT) AS duplicate_items, CAST(coalesce(total, 0) AS BIGINT) AS item_sum, CASE WHEN items IS NULL OR stated IS NULL THEN 'not_available' WHEN abs(stated - total - tax) <= greatest(0.05, abs(stated) * 0.01) THEN 'matched' ELSE 'mismatch' END AS total_check,
        coalesce(moves, 0) AS transaction_count, CAST(coalesce(mdups, 0) AS BIGINT) AS duplicate_transactions, CASE WHEN k % 13 != 0 THEN 'not_available' WHEN abs(2 - coalesce(moves, 0)) <= 0.05 THEN 'matched' ELSE 'mismatch' END AS balance_check FROM o"""


def evidence_records(spark, d):
    """Units of each document from chunks, a summary, an outline and fixed fields, numbered in order."""
    c = F.col
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = (c("doc_id") % 4).cast("int")
    part = docs.select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("ord", "text"))
    chunks = part.select("doc_id", "ord", F.when(c("ord") % 2 == 0, "text").otherwise("table").alias("type"), "text", F.when(c("ord") == 0, F.array(F.lit(7))).alias("page_nums"), F.when(c("ord") == 1, F.lit(2)).alias("first_page"), F.when(c("ord") == 1, (c("doc_id") % 5).cast("int")).alias("last_page"), F.lit("").alias("title_context"))
    sums = docs.select("doc_id", F.when(n > 0, F.concat(F.lit("Sum "), n.cast("string"))).otherwise("").alias("summary"), n.alias("page_count"))
    outline = docs.filter(n == 2).select("doc_id", F.lit(1).alias("ord"), F.lit("Scope").alias("title"), F.when(c("doc_id") % 8 == 2, F.lit(3)).alias("page_num"))
    fields = docs.select("doc_id", F.inline(F.array(F.struct(F.lit(0).alias("ord"), F.lit("party_a").alias("label"), F.when(n == 1, "Acme").otherwise(" ").alias("value")), F.struct(F.lit(1).alias("ord"), F.lit("end_date").alias("label"), F.lit("2027-04-30").alias("value")))))
    units = evidence.units(evidence.document_records(chunks, sums, outline, fields))
    return units.select("doc_id", "unit_id", F.sha2("text", 256).alias("text_sha256"), F.array_join(F.transform("page_nums", lambda x: x.cast("string")), ",").alias("pages"))


_RECORDS = f"""
    WITH ch AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:3]) AS text, generate_subscripts(string_split(text, chr(10))[1:3], 1) - 1 AS o FROM documents),
    r AS (SELECT doc_id, 0 AS part, o, CASE WHEN o % 2 = 0 THEN 'chunk_text' ELSE 'chunk_table' END AS kind, text, CASE o WHEN 0 THEN '7' WHEN 1 THEN coalesce(array_to_string(range(2, doc_id % 5 + 1), ','), '') ELSE '' END AS pages FROM ch
        UNION ALL SELECT doc_id, 1, 0, 'direct_pdf_summary', CASE WHEN doc_id % 4 > 0 THEN 'Sum ' || doc_id % 4 ELSE '' END, array_to_string(range(1, doc_id % 4 + 1), ',') FROM documents
        UNION ALL SELECT doc_id, 2, 1, 'direct_pdf_outline', 'Scope', CASE WHEN doc_id % 8 = 2 THEN '3' ELSE '' END FROM documents WHERE doc_id % 4 = 2
        UNION ALL SELECT doc_id, 3, 0, 'direct_pdf_fixed_json', 'party_a: Acme', '' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 3, 1, 'direct_pdf_fixed_json', 'end_date: 2027-04-30', '' FROM documents),
    c AS (SELECT *, {CLEAN.format("text")} AS t FROM r)
    SELECT doc_id, 'evidence_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, o) AS VARCHAR), 4, '0') || '_' || kind AS unit_id, sha256(t) AS text_sha256, pages FROM c WHERE t != ''"""


def baseline_layers(spark, d):
    """What each of the four layers found in every document."""
    c = F.col
    docs = table(spark, d, "documents")
    seen = A.document_words(docs).withColumn("confidence", F.when(c("word_num") % 10 == 9, -1.0).otherwise(c("confidence")))
    items = A.document_lines(docs).select("doc_id", F.when(c("line_ord") % 5 == 0, "heading").when(c("line_ord") % 5 == 1, "table").otherwise("paragraph").alias("type"))
    counts = docs.select("doc_id", F.when(c("doc_id") % 2 == 0, c("doc_id") % 3).cast("long").alias("chart_candidate_count"), (c("doc_id") % 4).cast("long").alias("evidence_unit_count"))
    out = robustness.baseline(seen, A.document_lines(docs), items, counts)
    return out.select("doc_id", "word_count", F.floor("average_confidence").cast("long").alias("confidence_floor"), "low_confidence_words", F.floor(c("low_confidence_ratio") * 100).cast("long").alias("low_percent"), "line_count", "heading_count", "layout_table_item_count", "evidence_unit_count", "table_count", "chart_qa_ready")


_BASELINE = r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    w AS (SELECT doc_id, k, unnest(range(1, n + 1)) - 1 AS j FROM (SELECT doc_id, k, len(list_filter(string_split(line, ' '), lambda x: x != '')) AS n FROM l)),
    c AS (SELECT doc_id, CASE WHEN j % 10 = 9 THEN NULL ELSE (doc_id * 31 + k * 17 + j * 7) % 101 END AS c FROM w),
    a AS (SELECT doc_id, count(*) AS n, count(c) AS known, avg(c) AS mean, count(*) FILTER (c < 85) AS low FROM c GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (k % 5 = 0) AS heads, count(*) FILTER (k % 5 = 1) AS tabs FROM l WHERE trim(line) != '' GROUP BY doc_id)
    SELECT doc_id, n AS word_count, CAST(floor(round_even(mean, 3)) AS BIGINT) AS confidence_floor, low AS low_confidence_words, CAST(floor(round_even(CAST(low AS DOUBLE) / greatest(1, known), 4) * 100) AS BIGINT) AS low_percent, coalesce(lines, 0) AS line_count, coalesce(heads, 0) AS heading_count, coalesce(tabs, 0) AS layout_table_item_count,
        doc_id % 4 AS evidence_unit_count, CAST(0 AS BIGINT) AS table_count, doc_id % 2 = 0 AND doc_id % 3 > 0 AS chart_qa_ready FROM a LEFT JOIN i USING (doc_id)"""


def upload_kinds(spark, d):
    """Kind and mode of files named after customers, and which requests a fingerprint answers from another's result."""
    c = F.col
    k = c("c_custkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".txt", "", ".webp"))), (k % 5 + 1).cast("int")))
    mime = F.element_at(F.array(F.lit("application/pdf"), F.lit("IMAGE/gif"), F.lit("text/plain"), F.lit(None)), (k % 4 + 1).cast("int"))
    own = table(spark, d, "customer").select(F.lpad(k.cast("string"), 12, "0").alias("job_id"), uploads.upload_kind(name, mime).alias("kind"), uploads.preprocess_mode(F.element_at(F.array(*map(F.lit, (" Binary ", "none", "x"))), (k % 3 + 1).cast("int"))).alias("mode"), c("c_nationkey").alias("n"))
    asked = own.filter("kind is not null").withColumn("fingerprint", uploads.fingerprint(c("kind"), c("mode"), c("n")))
    return uploads.once(asked).select("job_id", "kind", "mode", "runs_as", "cached")


_UPLOADS = """
    WITH o AS (SELECT lpad(c_custkey::VARCHAR, 12, '0') AS job_id, CASE c_custkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 4 THEN 'image' ELSE CASE c_custkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' END END AS kind, CASE c_custkey % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'none' ELSE 'clean' END AS mode, c_nationkey FROM customer)
    SELECT job_id, kind, mode, min(job_id) OVER w AS runs_as, job_id != min(job_id) OVER w AS cached FROM o WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY kind, mode, c_nationkey)"""


QUERIES = {f.__name__: f for f in (words_kept, merged_words, otsu_thresholds, review_regions, review_pages, bundle_documents, bundle_pages, consolidated_orders, evidence_records, baseline_layers, upload_kinds)}


def bundle_sql(routed, segments: bool) -> str:
    """routed: SQL of the router over a table of pages (doc_id, text) with heading_count and item_table_count."""
    starters = " ".join(f"WHEN '{label}' THEN (" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in hints) + ")" for label, hints in vocab.STARTERS.items())
    pages = rf"""{routed},
    tops AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_ord) FILTER (r <= 4) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_ord) AS r FROM lines WHERE line != '') GROUP BY doc_id),
    lows AS (SELECT routed.*, coalesce(top, '') AS top, replace(lower({CLEAN.format("coalesce(top, '')")}), 'ß', 'ss') AS low FROM routed LEFT JOIN tops USING (doc_id)),
    pg AS (SELECT doc_id // 10 AS bundle, CAST(doc_id % 10 AS INT) AS page_num, label, confidence, top, CASE label {starters} END AS hits, kv, amounts, heads, tabs FROM lows),
    sc AS (SELECT *, CASE WHEN hits > 0 THEN 2.5 + least(1.5, (hits - 1) * 0.5) ELSE 0 END + CASE WHEN label IN ('form', 'id') AND kv >= 3 THEN 1.5 ELSE 0 END + CASE WHEN label IN ('invoice', 'receipt') AND (tabs > 0 OR amounts >= 2) THEN 1 ELSE 0 END
        + CASE WHEN label = 'report' AND hits > 0 AND heads >= 1 THEN 1 ELSE 0 END + CASE WHEN confidence >= 0.75 THEN 0.5 ELSE 0 END AS score FROM pg)"""
    if not segments:
        return pages + " SELECT bundle AS doc_id, page_num, label, CAST(hits AS INT) AS hits, sha256(top) AS top_sha256, CAST(score AS DOUBLE) AS start_score FROM sc"
    return pages.replace("WITH ", "WITH RECURSIVE ", 1) + """,
    p AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY page_num) AS k, lag(label) OVER (PARTITION BY bundle ORDER BY page_num) AS prev FROM sc),
    g AS (SELECT *, CASE WHEN prev IS NULL OR hits < 1 OR score < 2.5 THEN 0 WHEN label != prev OR label IN ('invoice', 'receipt', 'form', 'id') THEN 2 WHEN label = 'report' AND prev = 'report' AND score >= 3.5 THEN 1 ELSE 0 END AS kind FROM p),
    w AS (SELECT bundle, k, 1 AS segment, 1 AS n FROM g WHERE k = 1
        UNION ALL SELECT g.bundle, g.k, CASE WHEN kind = 2 OR kind = 1 AND w.n >= 2 THEN w.segment + 1 ELSE w.segment END, CASE WHEN kind = 2 OR kind = 1 AND w.n >= 2 THEN 1 ELSE w.n + 1 END FROM w JOIN g ON g.bundle = w.bundle AND g.k = w.k + 1),
    a AS (SELECT w.bundle, w.segment, g.label, count(*) AS n, sum(confidence) AS c, min(page_num) AS first, max(page_num) AS last FROM w JOIN g USING (bundle, k) GROUP BY ALL)
    SELECT bundle AS doc_id, segment, min(first) AS start_page, max(last) AS end_page, CAST(sum(n) AS BIGINT) AS page_count, first(label ORDER BY n DESC, c DESC, first) AS label, CAST(printf('%.3f', sum(c) / sum(n)) AS DOUBLE) AS confidence FROM a GROUP BY bundle, segment"""


ORACLES = {
    "words_kept": _KEPT,
    "merged_words": _MERGED,
    "otsu_thresholds": _OTSU,
    "review_regions": _review_sql("""SELECT doc_id, CAST(p AS INT) AS page_num, k AS line_ord, 'signature' AS type, array_to_string([x0, y0, x1, y1], ',') AS box, CAST(linked AS VARCHAR) AS detail, '' AS field, CAST(-1 AS BIGINT) AS confidence FROM s
        UNION ALL SELECT doc_id, CAST(p AS INT), k, 'handwriting', array_to_string([{x0}, {y0}, {x1}, {y1}], ','), reason, field, CAST(floor(avg) AS BIGINT) FROM hw"""),
    "review_pages": _review_sql("""SELECT doc_id, CAST(p AS INT) AS page_num, coalesce(ns, 0) > 0 OR coalesce(nh, 0) > 0 OR doc_id % 5 = 0 AS needs_review, coalesce(ns, 0) AS signature_region_count, coalesce(nh, 0) AS handwriting_region_count, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS suspicious_field_count, coalesce(nl, 0) AS low_confidence_region_count,
        CAST(greatest(0, least(tot, 120 - (sum(tot) OVER (PARTITION BY doc_id ORDER BY p) - tot))) AS BIGINT) AS queued FROM (SELECT *, coalesce(ns, 0) + coalesce(nh, 0) + coalesce(nl, 0) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS tot FROM (SELECT DISTINCT doc_id, p FROM lines)
        LEFT JOIN (SELECT doc_id, p, count(*) AS ns FROM s GROUP BY ALL) USING (doc_id, p) LEFT JOIN (SELECT doc_id, p, count(*) AS nh FROM hw GROUP BY ALL) USING (doc_id, p) LEFT JOIN (SELECT doc_id, p, count(*) AS nl FROM l GROUP BY ALL) USING (doc_id, p))"""),
    "consolidated_orders": _ORDERS,
    "evidence_records": _RECORDS,
    "baseline_layers": _BASELINE,
    "upload_kinds": _UPLOADS,
}
