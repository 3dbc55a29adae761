"""Reading order, headings, lists and paragraphs from recognized lines.

lines(doc_id, page_num, line_ord, text, left, top, right, bottom, block_num, par_num, page_width, page_height).
"""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.folds import fold_groups

ITEMS = "doc_id long, page_num int, item_ord int, text string, line_count int, word_count int, avg_height double, near_top boolean, centered boolean, column_count int, base_height double"


def is_page_number(text: Column) -> Column:
    return T.normalize(text).rlike(vocab.PAGE_NUMBER)


def margin_zone(top: Column, bottom: Column, height: Column) -> Column:
    """header, footer or null."""
    return F.when(top <= height * 0.12, "header").when(bottom >= height * 0.9, "footer")


def repeated_margins(lines: DataFrame) -> DataFrame:
    """(doc_id, zone, margin_key, pages) of header and footer texts on half of a document's pages, two at least."""
    zone = margin_zone(F.col("top"), F.col("bottom"), F.col("page_height"))
    counts = lines.groupBy("doc_id").agg(F.countDistinct("page_num").alias("n"))
    keyed = lines.withColumn("zone", zone).filter("zone is not null").withColumn("margin_key", T.margin_key(F.col("text"))).filter("margin_key != '' and length(margin_key) <= 120")
    found = keyed.groupBy("doc_id", "zone", "margin_key").agg(F.countDistinct("page_num").alias("pages")).join(counts, "doc_id")
    return found.filter((F.col("n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))).select("doc_id", "zone", "margin_key", "pages")


def body_lines(lines: DataFrame) -> DataFrame:
    """lines without blank ones, repeated headers and footers, and page numbers in a margin."""
    zone = margin_zone(F.col("top"), F.col("bottom"), F.col("page_height"))
    keyed = lines.withColumn("zone", zone).withColumn("margin_key", T.margin_key(F.col("text"))).filter("margin_key != ''")
    kept = keyed.filter(F.col("zone").isNull() | ~is_page_number(F.col("text")))
    return kept.join(repeated_margins(lines).drop("pages"), ["doc_id", "zone", "margin_key"], "left_anti").drop("zone", "margin_key")


def list_prefix(text: Column) -> Column:
    """struct(ordered, content) of a list item, or null."""
    t = T.normalize(text)
    bullet, ordered = F.regexp_extract(t, vocab.LIST_BULLET, 1) != "", F.regexp_extract(t, vocab.LIST_ORDERED, 1) != ""
    content = F.when(bullet, F.regexp_replace(t, vocab.LIST_BULLET, "")).otherwise(F.regexp_replace(t, vocab.LIST_ORDERED, ""))
    return F.when((bullet | ordered) & (content != ""), F.struct((~bullet).alias("ordered"), content.alias("content")))


def heading_level(text: Column) -> Column:
    """The level that a heading's numbering tells, or null."""
    t = T.normalize(text)
    number = F.regexp_extract(t, vocab.HEADING_NUMBER, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(number != "", F.least(F.lit(4), 2 + dots)).when(t.rlike(vocab.HEADING_CHAPTER), 1).when(t.rlike(vocab.HEADING_SECTION), 2).when(t.rlike(vocab.HEADING_SUBSECTION), 3)


def _columns(blocks: list[dict], width: float, tall: float) -> tuple[int, float]:
    """(columns, where they part): two where narrow blocks stand side by side with a gutter of 0.08 of the page's width."""
    narrow = [b for b in blocks if not b["full"]]
    left, right = [b for b in narrow if b["right"] <= width * 0.68], [b for b in narrow if b["left"] >= width * 0.32]
    slack = max(12.0, tall * 0.8)
    if len(narrow) > 1 and left and right:
        inner, outer = max(b["right"] for b in left), min(b["left"] for b in right)
        beside = any(a["bottom"] > b["top"] + slack and b["bottom"] > a["top"] + slack for a in left for b in right)
        if outer - inner >= width * 0.08 and beside:
            return 2, (inner + outer) / 2
    return 1, width / 2


def _before(a: dict, b: dict, columns: int, slack: float) -> int:
    """Negative if block a is read before b: above it, else in an earlier column, else by its top and left."""
    if a["bottom"] <= b["top"] + slack:
        return -1
    if b["bottom"] <= a["top"] + slack:
        return 1
    if columns > 1 and not a["full"] and not b["full"] and a["column"] != b["column"]:
        return a["column"] - b["column"]
    return (a["top"], a["left"]) > (b["top"], b["left"]) or -((a["top"], a["left"]) < (b["top"], b["left"]))


def _parts(rows: list[dict], width: float, tall: float) -> list[list[dict]]:
    """A block's lines as paragraphs and list items."""
    out: list[list[dict]] = []
    for row in rows:
        if out:
            first, last = out[-1][0], out[-1][-1]
            near = row["top"] - last["bottom"] <= max(tall * 1.1, (last["bottom"] - last["top"]) * 0.9 + 6)
            level = first["is_list"] or abs(row["left"] - first["left"]) <= width * 0.04
            if not row["is_list"] and row["par_num"] == last["par_num"] and near and level:
                out[-1].append(row)
                continue
        out.append([row])
    return out


def _read_page(page: list[dict]) -> list[tuple]:
    """Segments of one page in reading order: blocks by column, lines joined to paragraphs."""
    width, height, tall = (float(page[0][c]) for c in ("page_width", "page_height", "base_height"))
    groups: dict[tuple, list[dict]] = {}
    for row in page:
        groups.setdefault((row["source"], row["angle"], row["block_num"]), []).append(row)
    blocks = []
    for rows in groups.values():
        box = {"left": min(r["left"] for r in rows), "top": min(r["top"] for r in rows), "right": max(r["right"] for r in rows), "bottom": max(r["bottom"] for r in rows)}
        blocks.append(box | {"rows": rows, "full": box["right"] - box["left"] >= width * 0.68})
    columns, middle = _columns(blocks, width, tall)
    for b in blocks:
        b["column"] = int((b["left"] + b["right"]) / 2 >= middle)
    out = []
    for block in sorted(blocks, key=cmp_to_key(lambda a, b: _before(a, b, columns, max(8.0, tall * 0.6)))):
        for rows in _parts(block["rows"], width, tall):
            text = T.joined(r["clean"] for r in rows)
            x0, x1, y0 = min(r["left"] for r in rows), max(r["right"] for r in rows), min(r["top"] for r in rows)
            high = sum(r["bottom"] - r["top"] for r in rows) / len(rows)
            out.append((rows[0]["doc_id"], rows[0]["page_num"], len(out), text, len(rows), sum(len(r["clean"].split()) for r in rows), high, y0 <= height * 0.22, abs((x0 + x1) / 2 - width / 2) <= width * 0.12, columns, tall))
    return out


def segments(lines: DataFrame) -> DataFrame:
    """Paragraph-like pieces of each page in reading order; see ITEMS. One group is one page.

    base_height is the median height of all of a document's lines that aren't margins, 18 without any. lines may have
    source and angle, else all are of one pass.
    """
    own = body_lines(lines).withColumn("clean", T.normalize(F.col("text"))).withColumn("is_list", list_prefix(F.col("text")).isNotNull())
    for name, value in (("source", "primary"), ("angle", 0.0)):
        own = own if name in own.columns else own.withColumn(name, F.lit(value))
    tall = F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))
    base = own.groupBy("doc_id").agg(F.coalesce(F.median(tall), F.lit(18.0)).alias("base_height"))
    return fold_groups(own.join(base, "doc_id"), ["doc_id", "page_num"], ["top", "left", "line_ord"], _read_page, ITEMS)


def classify(found: DataFrame) -> DataFrame:
    """segments() as layout items: type (heading, list_item, paragraph), level, ordered, text."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "item_ord")) == 1
    own = found.withColumn("is_first", first).withColumn("ratio", F.col("avg_height") / F.greatest(F.col("base_height"), F.lit(1.0)))
    text = F.col("text")
    short = (F.col("line_count") <= 2) & (F.col("word_count") <= 18) & (F.length(text) <= 120) & ~text.rlike("[.!?。！？;；]$")
    level = (
        F.when(short & heading_level(text).isNotNull(), heading_level(text))
        .when(short & F.col("is_first") & F.col("near_top") & ((F.col("ratio") >= 1.35) | F.col("centered")), 1)
        .when(short & (F.col("ratio") >= 1.7), 2)
        .when(short & (F.col("ratio") >= 1.4), 3)
    )
    listed = list_prefix(text)
    out = own.withColumn("level", level.cast("int")).withColumn("listed", F.when(F.col("level").isNull(), listed))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("listed").isNotNull(), "list_item").otherwise("paragraph")
    return out.select("doc_id", "page_num", "item_ord", kind.alias("type"), "level", F.col("listed.ordered").alias("ordered"), F.coalesce("listed.content", "text").alias("text"), "column_count")


NO_TEXT = "_No structured text detected._"


def markdown(items: DataFrame, by: tuple = ("doc_id",)) -> DataFrame:
    """(by…, markdown): headings, lists and paragraphs, list items without blank lines between them; by page or document."""
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("type") == "list_item", F.concat(F.when(F.col("ordered"), "1. ").otherwise("- "), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "item_ord", "type", line.alias("line"))))
    joined = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit("").alias("last")), lambda acc, x: F.struct(
        F.concat(acc["out"], F.when(acc["last"] == "", "").when((acc["last"] == "list_item") & (x["type"] == "list_item"), "\n").otherwise("\n\n"), x["line"]).alias("out"), x["type"].alias("last")))
    return items.groupBy(*by).agg(F.coalesce(F.nullif(joined["out"], F.lit("")), F.lit(NO_TEXT)).alias("markdown"))


def analyze(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, pages): layout items of all pages, and of each page column_count, filtered_margin_lines and its markdown.

    A page whose lines are all margins or blank has no items, one column and NO_TEXT as markdown.
    """
    items = classify(segments(lines))
    body = body_lines(lines).groupBy("doc_id", "page_num").agg(F.count("*").alias("kept"))
    every = lines.filter(T.normalize(F.col("text")) != "").groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))
    shown = markdown(items, ("doc_id", "page_num")).join(items.groupBy("doc_id", "page_num").agg(F.max("column_count").alias("column_count")), ["doc_id", "page_num"])
    pages = every.join(body, ["doc_id", "page_num"], "left").join(shown, ["doc_id", "page_num"], "left")
    return items, pages.select("doc_id", "page_num", F.coalesce("column_count", F.lit(1)).alias("column_count"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("filtered_margin_lines"), F.coalesce("markdown", F.lit(NO_TEXT)).alias("markdown"))
