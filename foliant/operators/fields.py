"""Candidate values of fields, questions about them, and the contract schema.

lines(doc_id, page_num, line_ord, text); fields as of forms.extract(); receipts as of receipts.extract().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

COLUMNS = ["doc_id", "field_key", "value", "page_num", "line_ord", "snippet", "source", "confidence"]


def _hits(text: Column, words_by_field: dict, value) -> Column:
    """array<struct(field_key, value)> of the fields whose words the line contains."""
    low = T.canonical(text)
    rows = [F.when(T.contains_any(low, words), F.struct(F.lit(k).alias("field_key"), value(k).alias("value"))) for k, words in words_by_field.items()]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def line_candidates(lines: DataFrame) -> DataFrame:
    """Candidates that lines give by keyword, by a date, and by a label with a colon."""
    own = lines.withColumn("text", T.normalize(F.col("text"))).filter("text != ''")
    text = F.col("text")
    pattern = lambda k: T.iso_date(text) if "date" in k else F.regexp_extract(text, vocab.INVOICE_NUMBER, 1) if k == "invoice_number" else T.normalize(F.try_element_at(T.money_tokens(text), F.lit(-1)))
    after = lambda _: F.regexp_extract(text, r"(?U)[:：]\s*(.+)$", 1)
    date = F.filter(F.array(F.struct(F.lit("document_date").alias("field_key"), T.iso_date(text).alias("value"))), lambda x: x["value"].isNotNull())
    parts = [(_hits(text, vocab.LINE_PATTERNS, pattern), "line_pattern", 0.78), (date, "line_date", 0.68), (_hits(text, vocab.LINE_LABELS, after), "line_label", 0.74)]
    tag = lambda source, sure: lambda x: F.struct(x["field_key"].alias("field_key"), x["value"].alias("value"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
    tagged = [F.transform(array, tag(source, sure)) for array, source, sure in parts]
    rows = own.select("doc_id", "page_num", "line_ord", F.col("text").alias("snippet"), F.explode(F.concat(*tagged)).alias("x"))
    return rows.select("doc_id", "x.field_key", T.normalize(F.col("x.value")).alias("value"), "page_num", "line_ord", "snippet", "x.source", "x.confidence")


def form_candidates(fields: DataFrame) -> DataFrame:
    return fields.select("doc_id", F.col("field").alias("field_key"), "value", "page_num", F.lit(-1).alias("line_ord"), F.coalesce("label", "value").alias("snippet"), F.lit("form_result").alias("source"), F.lit(0.93).alias("confidence"))


def receipt_candidates(receipts: DataFrame) -> DataFrame:
    names = {"vendor": "vendor", "date": "document_date", "invoice_number": "invoice_number", "subtotal": "subtotal_amount", "tax": "tax_amount", "total": "total_amount"}
    rows = F.array(*[F.struct(F.lit(k).alias("field_key"), F.col(c).cast("string").alias("value")) for c, k in names.items()])
    sure = F.when(F.col("x.field_key").isin("total_amount", "tax_amount"), 0.96).otherwise(0.9)
    return receipts.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.field_key", "x.value", F.lit(1).alias("page_num"), F.lit(-1).alias("line_ord"), F.col("x.value").alias("snippet"), F.lit("receipt_invoice_result").alias("source"), sure.alias("confidence"))


def index(*parts: DataFrame) -> DataFrame:
    """All candidates, each (field, value, page) of a document once, the surest first; ord is their order."""
    every = reduce(DataFrame.unionByName, [p.select(COLUMNS) for p in parts]).filter("value is not null and value != ''")
    sure = [F.desc("confidence"), F.coalesce("page_num", F.lit(0)), "line_ord", "field_key", "source"]
    first = F.row_number().over(Window.partitionBy("doc_id", "field_key", "value", "page_num").orderBy(*sure))
    once = every.withColumn("r", first).filter("r = 1").drop("r")
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*sure, "value")))


def intents(query: Column) -> Column:
    """Fields that a question asks for, the more special ones first; a fallback where it names none."""
    low = T.canonical(query)
    named = F.filter(F.array(*[F.when(T.contains_any(low, words), k) for k, words in vocab.INTENT_ALIASES.items()]), lambda x: x.isNotNull())
    several = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(F.size(named) > 0, named)
        .when(T.contains_any(low, ("金额", "amount")), several("total_amount", "tax_amount", "subtotal_amount"))
        .when(T.contains_any(low, ("日期", "哪天", "date")), several("contract_start_date", "contract_end_date", "document_date"))
        .otherwise(several("document_date", "name", "total_amount"))
    )


def answer(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """questions(query_id, doc_id, query) -> status, answer, page_num, matched_field, source, confidence: the best candidate of the document."""
    words = F.filter(F.split(T.canonical(F.col("query")), r"(?U)[\s,，。！？?]+"), lambda t: F.length(t) >= 2)
    asked = questions.select("query_id", "doc_id", "query", intents(F.col("query")).alias("intents"), words.alias("words"))
    both = asked.join(candidates, "doc_id")
    at = F.array_position("intents", F.col("field_key"))
    ends = lambda suffix: F.exists("intents", lambda i: i.endswith(suffix))
    amounts = F.col("field_key").isin("total_amount", "tax_amount", "subtotal_amount")
    low = T.canonical(F.col("snippet"))
    score = (
        F.col("confidence") * 10
        + F.when(at > 0, 12 + F.size("intents") - (at - 1)).when((F.col("field_key") == "document_date") & ends("_date"), 6).when(amounts & ends("_amount"), 5).otherwise(0)
        + F.least(F.lit(4), F.size(F.filter("words", lambda w: low.contains(w))))
        + F.when(F.col("source").isin("receipt_invoice_result", "form_result"), 1.5).otherwise(0.0)
    )
    best = both.withColumn("score", score).groupBy("query_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("early"), "value", "page_num", "field_key", "source", "snippet")).alias("b"))
    out = questions.select("query_id", "query").join(best, "query_id", "left")
    status = F.when(T.normalize(F.col("query")) == "", "invalid_query").when(F.col("b").isNull(), "no_answer").otherwise("ok")
    out = out.withColumn("status", status).withColumn("b", F.when(F.col("status") == "ok", F.col("b")))
    return out.select("query_id", "status", F.coalesce("b.value", F.lit("")).alias("answer"), "b.page_num", F.coalesce("b.field_key", F.lit("")).alias("matched_field"), "b.source", F.coalesce(T.rounded(F.least(F.lit(0.99), F.col("b.score") / 24), 3), F.lit(0.0)).alias("confidence"))


def contracts(lines: DataFrame) -> DataFrame:
    """(doc_id, is_contract, …fields of the contract schema) from the first line that fits each field's pattern."""
    own = lines.withColumn("text", T.normalize(F.col("text"))).filter("text != ''")
    own = own.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "line_ord")))
    text = F.col("text")

    def first(name: str) -> Column:
        pattern = vocab.CONTRACT_PATTERNS[name]
        ok, value = text.rlike(pattern), F.regexp_extract(text, pattern, 1)
        if name == "contract_title":
            ok, value = ok & (F.col("index") <= 6) & (F.length(text) <= 120), text
        if name.endswith("_date"):
            value = F.coalesce(T.iso_date(value), value)
        return F.min(F.when(ok, F.struct("index", T.normalize(value).alias("v"))))["v"]

    blob = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "\n")
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("index") <= 6, F.struct("index", "text")))), lambda x: x["text"]), "\n")
    out = own.groupBy("doc_id").agg(*[first(n).alias(n) for n in vocab.CONTRACT_FIELDS], F.lower(blob).alias("blob"), head.alias("head"))
    party = F.col("blob").rlike(vocab.CONTRACT_PATTERNS["party_a"]) | F.col("blob").rlike(vocab.CONTRACT_PATTERNS["party_b"])
    hints = T.count_contained(F.col("blob"), vocab.CONTRACT_HINTS) + F.when(F.col("head").rlike(vocab.CONTRACT_PATTERNS["contract_title"]), 3).otherwise(0) + F.when(party, 2).otherwise(0) + F.when(F.col("contract_number").isNotNull(), 1).otherwise(0)
    is_contract = hints >= 3
    return out.select("doc_id", is_contract.alias("is_contract"), *[F.when(is_contract, F.coalesce(F.col(n), F.lit(""))).otherwise("").alias(n) for n in vocab.CONTRACT_FIELDS])
