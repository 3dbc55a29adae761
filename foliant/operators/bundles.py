"""Splitting of page bundles into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from . import router


def starter_hits(top_text: Column, label: Column) -> Column:
    """How many of the label's first-page keywords the page's top lines contain."""
    low, out = T.canonical(top_text), F.lit(0)
    for name, words in vocab.STARTERS.items():
        out = F.when(label == name, T.count_contained(low, words)).otherwise(out)
    return out


def start_score(label: Column, hits: Column, key_values: Column, item_tables: Column, amount_lines: Column, headings: Column, confidence: Column) -> Column:
    """How much a page looks like the first of a document."""
    zero = F.lit(0.0)
    return (
        F.when(hits > 0, 2.5 + F.least(F.lit(1.5), (hits - 1) * 0.5)).otherwise(zero)
        + F.when(label.isin("form", "id") & (key_values >= 3), 1.5).otherwise(zero)
        + F.when(label.isin("invoice", "receipt") & ((item_tables > 0) | (amount_lines >= 2)), 1.0).otherwise(zero)
        + F.when((label == "report") & (hits > 0) & (headings >= 1), 1.0).otherwise(zero)
        + F.when(confidence >= 0.75, 0.5).otherwise(zero)
    )


def classify(pages: DataFrame, key: str = "doc_id", top: int = 4) -> DataFrame:
    """pages(key, page_num, lines, heading_count, paragraph_count, item_table_count) -> label, confidence, hits, start_score.

    Every page is routed as a document of one page; keywords of its `top` first lines with text tell whether it starts one.
    """
    routed = router.route(pages.withColumn("page_count", F.lit(1)))
    top_text = F.array_join(F.slice("lines", 1, top), "\n")
    out = routed.withColumn("top_text", top_text).withColumn("hits", starter_hits(F.col("top_text"), F.col("label")))
    score = start_score(F.col("label"), F.col("hits"), F.col("key_value_count"), F.col("item_table_count"), F.col("amount_line_count"), F.col("heading_count"), F.col("confidence"))
    return out.select(key, "page_num", "label", "confidence", "top_text", "hits", T.rounded(score, 2).alias("start_score"))


def split(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages(key, page_num, label, confidence, hits, start_score) with segment, numbered from 1 in page order.

    A page starts a segment with a starter keyword and a new label, a short document's label, or, in a run of report
    pages, a start score of 3.5 in a segment of two pages already. Only the last needs the segment's length, which a
    fold over the bundle's pages carries.
    """
    before = Window.partitionBy(key).orderBy("page_num")
    starts = (F.col("hits") > 0) & (F.col("start_score") >= 2.5)
    flagged = pages.withColumn("previous", F.lag("label").over(before))
    hard = starts & F.col("previous").isNotNull() & ((F.col("label") != F.col("previous")) | F.col("label").isin(*vocab.SHORT_LABELS))
    soft = starts & (F.col("label") == "report") & (F.col("previous") == "report") & (F.col("start_score") >= 3.5)
    kind = F.when(F.coalesce(hard, F.lit(False)), 2).when(F.coalesce(soft, F.lit(False)), 1).otherwise(0)
    rows = flagged.withColumn("kind", kind).drop("previous").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_num", "label", "confidence", "kind"))).alias("pages"))

    def step(acc, page):
        new = (page["kind"] == 2) | ((page["kind"] == 1) & (acc["length"] >= 2))
        segment, length = acc["segment"] + new.cast("int"), F.when(new, 1).otherwise(acc["length"] + 1)
        return F.struct(segment.alias("segment"), length.alias("length"), F.concat(acc["out"], F.array(segment)).alias("out"))

    start = F.struct(F.lit(1).alias("segment"), F.lit(0).alias("length"), F.array().cast("array<int>").alias("out"))
    folded = rows.withColumn("segments", F.aggregate("pages", start, step, lambda acc: acc["out"]))
    return folded.select(key, F.explode(F.arrays_zip("pages", "segments")).alias("x")).select(key, "x.pages.page_num", "x.pages.label", "x.pages.confidence", F.col("x.segments").alias("segment"))


def segments(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per segment of split(): start_page, end_page, page_count, label (most pages, then most confidence, then first), confidence."""
    by_label = pages.groupBy(key, "segment", "label").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.min("page_num").alias("first"), F.max("page_num").alias("last"))
    best = F.max(F.struct("n", "c", (-F.col("first")).alias("early"), "label"))
    out = by_label.groupBy(key, "segment").agg(F.min("first").alias("start_page"), F.max("last").alias("end_page"), F.sum("n").alias("page_count"), best["label"].alias("label"), (F.sum("c") / F.sum("n")).alias("confidence"))
    return out.withColumn("confidence", T.rounded(F.col("confidence"), 3))
