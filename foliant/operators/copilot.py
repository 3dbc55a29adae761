"""The overview of a processed document: stages, readiness, key facts and suggested questions.

documents(doc_id, label, confidence, summary, total, tax, effective_date, end_date, detected_bundle, most_fragile_layer,
and COUNTS): what the stages left; a null count means that nothing was found, a null review_page_count or variant_count
that the stage didn't run, a null segment_count that no bundle was looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

COUNTS = (
    "page_count", "segment_count", "word_count", "low_confidence_words", "table_count", "field_count", "chunk_count", "table_chunk_count", "evidence_count", "signature_count", "handwriting_count", "suspicious_count", "review_page_count", "variant_count",
)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def review_estimate() -> Column:
    """What a person should look at: regions, doubtful fields and doubtful words."""
    return _n("signature_count") + _n("handwriting_count") + _n("suspicious_count") + _n("low_confidence_words")


def stages(documents: DataFrame) -> DataFrame:
    """(doc_id, ord, stage_id, status, detail), eight rows a document; status: completed, pending, empty or needs_review."""
    done = lambda test: F.when(F.coalesce(test, F.lit(False)), "completed").otherwise("pending")
    status = {
        "classification": done(F.col("label") != ""),
        "splitting": F.when(_n("segment_count") > 0, "completed").otherwise("empty"),
        "ocr_layout_extraction": done(_n("page_count") > 0),
        "chunking": done(_n("chunk_count") > 0),
        "qa_summary": done((T.normalize(F.col("summary")) != "") | (_n("evidence_count") > 0)),
        "human_review": F.when(review_estimate() > 0, "needs_review").otherwise(done(F.col("review_page_count").isNotNull())),
        "robustness": done(F.col("variant_count").isNotNull()),
        "exports": F.lit("completed"),
    }
    detail = {
        "classification": F.coalesce("label", F.lit("unknown")), "splitting": _n("segment_count"), "ocr_layout_extraction": _n("word_count"), "chunking": _n("chunk_count"), "qa_summary": _n("evidence_count"), "human_review": review_estimate(),
        "robustness": F.coalesce("most_fragile_layer", F.lit("unknown")), "exports": F.lit("json, markdown"),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("stage_id"), status[name].alias("status"), detail[name].cast("string").alias("detail")) for i, name in enumerate(vocab.STAGES)])
    return documents.select("doc_id", F.inline(rows))


def readiness(found: DataFrame) -> DataFrame:
    """(doc_id, readiness, score, completed_stages, review_stages, pending_stages): partial while a stage is pending."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    named = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("ord", "stage_id")))), lambda x: x["stage_id"])
    out = found.groupBy("doc_id").agg(n("completed", "needs_review").alias("completed_stages"), F.count("*").alias("stage_count"), named("needs_review").alias("review_stages"), named("pending").alias("pending_stages"))
    status = F.when(F.size("pending_stages") > 0, "partial").when(F.size("review_stages") > 0, "ready_with_review").otherwise("ready")
    return out.select("doc_id", status.alias("readiness"), T.rounded(F.col("completed_stages") / F.greatest(F.lit(1), F.col("stage_count")), 3).alias("score"), "completed_stages", "review_stages", "pending_stages")


# The questions that a document suggests, in order, always or where something was found.
ALWAYS_ASKED = ["这份文档属于什么类型？", "有哪些页面或子文档需要人工复核？", "这份文档的摘要是什么？"]
ASKED_OF = {"total": "总金额是多少？", "tax": "税额是多少？", "contract_dates": "合同起止日期是哪天？", "bundle": "这个混合包被切成了哪些子文档？", "fragile": "这个文档链路最脆弱的是哪一层？"}


def questions() -> Column:
    """array<string> of the questions that a row of documents suggests."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    asked = {"total": F.col("total").isNotNull(), "tax": F.col("tax").isNotNull(), "contract_dates": some("effective_date") | some("end_date"), "bundle": F.coalesce("detected_bundle", F.lit(False)), "fragile": some("most_fragile_layer")}
    return F.array_compact(F.array(*map(F.lit, ALWAYS_ASKED), *[F.when(asked[k], text) for k, text in ASKED_OF.items()]))


def markdown(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, markdown): title, readiness and a line a stage."""
    line = F.concat(F.lit("- "), "stage_id", F.lit(": "), "status", F.lit(" ("), F.coalesce("detail", F.lit("")), F.lit(")"))
    lines = found.withColumn("line", line).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("# "), F.coalesce(F.initcap("label"), F.lit("Document")), F.lit(" "), F.col("doc_id").cast("string"))
    return documents.join(lines, "doc_id").join(readiness(found), "doc_id").select("doc_id", F.concat_ws("\n\n", head, F.concat(F.lit("Readiness: "), "readiness"), "lines").alias("markdown"))


def key_facts(fields: DataFrame) -> DataFrame:
    """fields(doc_id, part, label, value, ord) -> (doc_id, facts map 'part.label' -> value): fields with a value, the last of each name, without a receipt's items."""
    name = F.concat_ws(".", "part", "label")
    kept = fields.filter((T.normalize(F.col("value")) != "") & ~((F.col("part") == "receipt_invoice") & (F.col("label") == "items")))
    last = kept.groupBy("doc_id", name.alias("name")).agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("facts"))
