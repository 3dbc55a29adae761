"""Series in tables, their summaries, and questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def number(cell: Column) -> Column:
    """The first number of a cell, percent and currency signs removed, or null."""
    token = F.regexp_extract(T.normalize(cell), vocab.PERCENT_MONEY, 0)
    bare = F.regexp_replace(F.regexp_replace(T.normalize(token), r"(?i)^(USD|CNY|RMB)", ""), r"(?U)[$€£¥,%\s]", "")
    return T.rounded(bare.try_cast("double"), 4)


def points(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, page_num, col_idx, name, row_index, label, value) of numeric columns with two values and more."""
    header = F.get("rows", F.lit(0))
    named = F.filter(F.transform(header, lambda c, i: F.when(T.contains_any(T.canonical(c), vocab.DIMENSION_WORDS), i)), lambda i: i.isNotNull())
    wide = tables.filter(F.size("rows") >= 3).withColumn("header", header).withColumn("dimension", F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(0)))
    rows = wide.select("doc_id", "table_id", "page_num", "header", "dimension", F.posexplode(F.slice("rows", 2, F.size("rows") - 1)).alias("i", "row"))
    cells = rows.select("doc_id", "table_id", "page_num", "header", "dimension", (F.col("i") + 2).alias("row_index"), "row", F.posexplode("row").alias("col_idx", "cell"))
    cells = cells.filter("col_idx != dimension and col_idx < size(header)").withColumn("value", number(F.col("cell"))).filter("value is not null")
    name = F.coalesce(F.nullif(T.normalize(F.get("header", F.col("col_idx"))), F.lit("")), F.format_string("column_%d", F.col("col_idx") + 1))
    label = F.coalesce(T.normalize(F.get("row", F.col("dimension"))), F.format_string("row_%d", F.col("row_index")))
    counted = cells.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "table_id", "col_idx"))).filter("n >= 2")
    return counted.select("doc_id", "table_id", "page_num", "col_idx", name.alias("name"), "row_index", label.alias("label"), "value")


def series(found: DataFrame, key: tuple = ("doc_id", "table_id", "col_idx", "name")) -> DataFrame:
    """Per series of points(): point_count, first of the greatest and of the least, total, trend and its delta."""
    early = -F.col("row_index")
    out = found.groupBy(*key).agg(
        F.count("*").alias("point_count"), F.max(F.struct("value", early.alias("e"), "label")).alias("hi"), F.min(F.struct("value", "row_index", "label")).alias("lo"),
        F.sum("value").alias("sum"), F.min(F.struct("row_index", "value", "label")).alias("first"), F.max(F.struct("row_index", "value", "label")).alias("last"),
    )
    delta = T.rounded(F.col("last.value") - F.col("first.value"), 4)
    return out.select(*key, "point_count", F.col("first.label").alias("first_label"), F.col("last.label").alias("last_label"), F.col("hi.label").alias("max_label"), F.col("hi.value").alias("max_value"), F.col("lo.label").alias("min_label"), F.col("lo.value").alias("min_value"), T.rounded(F.col("sum"), 4).alias("total"), delta.alias("trend_delta"), F.when(delta > 0, "increasing").when(delta < 0, "decreasing").otherwise("flat").alias("trend"))


def candidates(tables: DataFrame, found: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Tables that answer chart questions: with a chart hint in them or in a chunk of their page, or with two series and more."""
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), " ")
    hinted = tables.select("doc_id", "table_id", "page_num", T.contains_any(T.canonical(text), vocab.CHART_HINTS).alias("own"))
    if chunks is not None:
        context = T.canonical(F.concat_ws(" ", "title_context", "text"))
        pages = chunks.filter(T.contains_any(context, vocab.CHART_HINTS)).select("doc_id", F.explode("page_nums").alias("page_num")).distinct().withColumn("near", F.lit(True))
        hinted = hinted.join(pages, ["doc_id", "page_num"], "left")
    else:
        hinted = hinted.withColumn("near", F.lit(None).cast("boolean"))
    counts = found.groupBy("doc_id", "table_id").agg(F.countDistinct("col_idx").alias("series_count"), F.count("*").alias("point_count"))
    out = hinted.join(counts, ["doc_id", "table_id"]).withColumn("has_context", F.col("own") | F.coalesce("near", F.lit(False))).filter("has_context or series_count >= 2")
    reliability = T.rounded(F.least(F.lit(0.95), F.when(F.col("has_context"), 0.72).otherwise(0.58) + F.when(F.col("series_count") >= 2, 0.08).otherwise(0.0)), 3)
    return out.select("doc_id", "table_id", "page_num", F.concat(F.lit("chart_"), "table_id").alias("candidate_id"), "series_count", "point_count", "has_context", reliability.alias("reliability"))


def intent(query: Column) -> Column:
    """max, min, total, trend or summary."""
    low, out = T.canonical(query), F
    for name, words in vocab.CHART_INTENTS.items():
        out = out.when(T.contains_any(low, words), name)
    return out.otherwise("summary")


def answer(questions: DataFrame, found: DataFrame, summaries: DataFrame, tables: DataFrame) -> DataFrame:
    """questions(query_id, doc_id, query) -> status, answer, intent, table_id, name (of the series), page_num, confidence.

    found: points(); summaries: series(); tables: candidates(), from which alone answers come. The best candidate shares
    the most words with the question, then is the more reliable, then the first; so is its series by its name.
    """
    asked = questions.select("query_id", "doc_id", T.normalize(F.col("query")).alias("query"), intent(F.col("query")).alias("intent"), T.tokens(F.col("query"), vocab.CHART_STOPWORDS).alias("q"))
    words = found.groupBy("doc_id", "table_id").agg(F.concat_ws(" ", F.collect_set("name"), F.collect_set("label")).alias("words"))
    known = asked.filter("query != ''").join(tables.select("doc_id", "table_id", "page_num", "reliability"), "doc_id").join(words, ["doc_id", "table_id"])
    known = known.withColumn("hits", F.size(F.array_intersect("q", T.tokens(F.col("words"), vocab.CHART_STOPWORDS))))
    first = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("reliability"), "page_num", "table_id")
    chosen = known.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "words", "hits")
    both = chosen.join(summaries, ["doc_id", "table_id"]).withColumn("hits", F.size(F.array_intersect("q", T.tokens(F.col("name"), vocab.CHART_STOPWORDS))))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "col_idx"))).filter("r = 1")
    shown = lambda c: F.col(c).cast("string")
    text = (
        F.when(F.col("intent").isin("max", "min"), F.concat(F.when(F.col("intent") == "max", F.col("max_label")).otherwise(F.col("min_label")), F.lit(" has the "), "intent", F.lit(" "), "name", F.lit(" value: "), F.when(F.col("intent") == "max", shown("max_value")).otherwise(shown("min_value")), F.lit(".")))
        .when(F.col("intent") == "total", F.concat(F.lit("The total "), "name", F.lit(" value is "), shown("total"), F.lit(".")))
        .when(F.col("intent") == "trend", F.concat("name", F.lit(" is "), "trend", F.lit(" from "), "first_label", F.lit(" to "), "last_label", F.lit(" (delta "), shown("trend_delta"), F.lit(").")))
        .otherwise(F.concat("name", F.lit(" has "), F.col("point_count").cast("string"), F.lit(" points; the highest visible value is "), "max_label", F.lit(" at "), shown("max_value"), F.lit(".")))
    )
    sure = T.rounded(F.least(F.lit(0.92), F.col("reliability") + 0.08), 3)
    out = asked.select("query_id", "query").join(best.select("query_id", "intent", "table_id", "name", "page_num", text.alias("answer"), sure.alias("confidence")), "query_id", "left")
    status = F.when(F.col("query") == "", "error").when(F.col("answer").isNull(), "insufficient_evidence").otherwise("ok")
    return out.select("query_id", status.alias("status"), F.coalesce("answer", F.lit("")).alias("answer"), "intent", "table_id", "name", "page_num", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
