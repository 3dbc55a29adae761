"""Routing of documents to a label by additive signals.

Documents come as arrays of normalized lines, so a batch is routed in one pass without a shuffle; lines that come as
rows are gathered per document by gather(). Every signal is a row of (label, signal, weight) before it is summed.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def gather(lines: DataFrame, key: tuple = ("doc_id",)) -> DataFrame:
    """lines(key…, page_num, top, left, line_ord, text) -> (key…, lines array<string> in reading order, page_count)."""
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "top", "left", "line_ord", "text")))
    return lines.groupBy(*key).agg(F.transform(ordered, lambda x: x["text"]).alias("lines"), F.countDistinct("page_num").cast("int").alias("page_count"))


def features(docs: DataFrame) -> DataFrame:
    """docs(lines, page_count, heading_count, paragraph_count, item_table_count, …) with the feature columns added."""
    lines = F.filter(F.transform("lines", T.normalize), lambda x: x != "")
    out = docs.withColumn("lines", lines).withColumn("blob", T.canonical(F.array_join("lines", " ")))
    count = lambda test: F.size(F.filter("lines", test))
    return (
        out.withColumn("word_count", F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(F.split(x, " "))))
        .withColumn("key_value_count", count(lambda x: x.rlike(vocab.KEY_VALUE)))
        .withColumn("checkbox_count", F.aggregate("lines", F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(vocab.CHECKBOX))))
        .withColumn("amount_line_count", count(lambda x: x.rlike(vocab.AMOUNT_LINE)))
        .withColumns({f"hits_{k}": T.count_contained(F.col("blob"), getattr(vocab, f"{k.upper()}_HINTS")) for k in vocab.LABELS})
        .withColumn("total_hint", T.contains_any(F.col("blob"), vocab.TOTAL_HINTS))
        .withColumn("tax_hint", T.contains_any(F.col("blob"), vocab.TAX_HINTS))
    )


def item_tables(rows: Column) -> Column:
    """Whether a table's first row looks like an item header."""
    header = F.array_join(F.filter(F.transform(F.get(rows, F.lit(0)), T.canonical), lambda c: c != ""), " ")
    return F.coalesce(T.contains_any(header, vocab.ITEM_HEADER_HINTS), F.lit(False))


def rules(form_fields: Column | None = None, receipt_items: Column | None = None) -> list[tuple[Column, str, Column | None, Column]]:
    """(test, label, signal, weight) over a row with features(); without a signal it is a silent adjustment."""
    c, blob = F.col, F.col("blob")
    hits = {k: c(f"hits_{k}") for k in vocab.LABELS}
    total, tax = c("total_hint"), c("tax_hint")
    form_fields, receipt_items = F.coalesce(form_fields, F.lit(0)) if form_fields is not None else F.lit(0), F.coalesce(receipt_items, F.lit(0)) if receipt_items is not None else F.lit(0)
    numbered = lambda name, n: F.concat(F.lit(f"{name}:"), n.cast("string"))
    least = lambda most, x: F.least(F.lit(float(most)), x.cast("double"))
    long_ = c("word_count") >= 120
    return [
        (F.lit(True), "report", None, F.lit(1.0)),
        (hits["invoice"] > 0, "invoice", numbered("invoice_keywords", hits["invoice"]), 8 + least(3, hits["invoice"] - 1)),
        (hits["invoice"] > 0, "receipt", None, F.lit(-1.5)),
        (hits["receipt"] > 0, "receipt", numbered("receipt_keywords", hits["receipt"]), 8 + least(2, hits["receipt"] - 1)),
        (hits["receipt"] > 0, "invoice", None, F.lit(-1.5)),
        (hits["form"] > 0, "form", numbered("form_keywords", hits["form"]), 5.5 + least(2, hits["form"] - 1)),
        (hits["report"] > 0, "report", numbered("report_keywords", hits["report"]), 4 + least(2, hits["report"] - 1)),
        (hits["id"] > 0, "id", numbered("id_keywords", hits["id"]), 8 + least(4, hits["id"] - 1)),
        (c("key_value_count") >= 3, "form", numbered("key_value_lines", c("key_value_count")), least(7, c("key_value_count") * 1.4)),
        ((c("key_value_count") >= 3) & (c("page_count") <= 2), "id", F.lit("compact_key_value_layout"), F.lit(1.5)),
        (c("checkbox_count") > 0, "form", numbered("checkbox_markers", c("checkbox_count")), least(4, 1.5 + c("checkbox_count") * 0.6)),
        (c("item_table_count") > 0, "invoice", numbered("item_tables", c("item_table_count")), 4 + least(2, c("item_table_count"))),
        (c("item_table_count") > 0, "receipt", numbered("item_tables", c("item_table_count")), F.lit(2.0)),
        (total, "invoice", F.lit("has_total_hint"), F.lit(2.5)),
        (total, "receipt", F.lit("has_total_hint"), F.lit(2.5)),
        (total, "report", None, F.lit(-1.0)),
        (tax, "invoice", F.lit("has_tax_hint"), F.lit(2.5)),
        (tax, "receipt", F.lit("has_tax_hint"), F.lit(1.5)),
        (tax, "report", None, F.lit(-0.5)),
        ((c("amount_line_count") >= 3) & (c("page_count") == 1), "receipt", numbered("money_lines", c("amount_line_count")), least(3, c("amount_line_count") * 0.5)),
        (c("heading_count") >= 1, "report", numbered("heading_items", c("heading_count")), least(4, 1.5 + c("heading_count") * 0.7)),
        (c("paragraph_count") >= 3, "report", numbered("paragraph_items", c("paragraph_count")), least(5, 2 + c("paragraph_count") * 0.5)),
        (c("paragraph_count") >= 3, "id", None, F.lit(-1.5)),
        (c("page_count") >= 2, "report", F.lit("multi_page_document"), F.lit(2.5)),
        (long_, "report", F.lit("long_text_document"), F.lit(2.5)),
        (long_, "receipt", None, F.lit(-1.0)),
        (long_, "id", None, F.lit(-1.0)),
        (blob.rlike(vocab.BIRTH_DATE), "id", F.lit("date_of_birth_field"), F.lit(3.0)),
        (form_fields >= 3, "form", numbered("form_fields", form_fields), least(4, form_fields * 0.8)),
        (receipt_items >= 1, "invoice", numbered("receipt_items", receipt_items), least(3, 1 + receipt_items * 0.5)),
    ]


def signals(found: list[tuple[Column, str, Column | None, Column]]) -> Column:
    """array<struct(label, signal, weight)> of the rules that have a signal and hold."""
    made = [F.when(test, F.struct(F.lit(label).alias("label"), signal.alias("signal"), weight.cast("double").alias("weight"))) for test, label, signal, weight in found if signal is not None]
    return F.array_compact(F.array(*made))


def route(docs: DataFrame, form_fields: Column | None = None, receipt_items: Column | None = None) -> DataFrame:
    """features() with signals, scores by label, label (first of the highest), confidence, selected_pipeline and downstream."""
    found, out = rules(form_fields, receipt_items), features(docs)
    for label in vocab.LABELS:
        terms = [F.when(test, weight.cast("double")).otherwise(0.0) for test, own, _, weight in found if own == label]
        out = out.withColumn(f"score_{label}", reduce(add, terms, F.lit(0.0)))
    ranked = F.array(*[F.struct(F.col(f"score_{x}").alias("score"), F.lit(-i).alias("rank"), F.lit(x).alias("label")) for i, x in enumerate(vocab.LABELS)])
    out = out.withColumn("ranked", F.sort_array(ranked, asc=False)).withColumn("label", F.get("ranked", F.lit(0))["label"])
    top, second = F.greatest(F.get("ranked", F.lit(0))["score"], F.lit(0.0)), F.greatest(F.get("ranked", F.lit(1))["score"], F.lit(0.0))
    sure = F.when(top <= 0, 0.0).otherwise(T.rounded(F.least(F.lit(0.99), 0.45 + F.greatest(F.lit(0.0), top - second) / F.greatest(top, F.lit(1.0)) * 0.5), 3))
    plans = F.create_map(*[x for k, v in vocab.PIPELINES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    plan = F.element_at(plans, F.col("label"))
    return out.withColumn("confidence", sure).withColumn("matched_signals", signals(found)).withColumn("selected_pipeline", plan).withColumn("downstream", F.when(F.size(plan) > 3, F.element_at(plan, -1)).otherwise("")).drop("ranked")


def label_counts(routed: DataFrame) -> DataFrame:
    """(label, document_count) of a batch."""
    return routed.groupBy("label").agg(F.count("*").alias("document_count"))
