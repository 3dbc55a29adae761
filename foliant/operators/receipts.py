"""Receipts and invoices from ordered lines and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def vendor_score(text: Column, index: Column, low: Column, money: Column) -> Column:
    """How much one of a first page's first lines (index from 0, case folded, money values) looks like the vendor."""
    one = lambda test, x: F.when(test, float(x)).otherwise(0.0)
    return (
        one(T.contains_any(low, vocab.VENDOR_WORDS), 4) + F.when(index == 0, 3.0).when(index <= 2, 1.5).otherwise(0.0) + one(text.rlike(r"\p{L}"), 1) + one(~text.rlike(r"(?U)\d"), 1)
        + one(F.length(text) > 64, -2) + one(T.contains_any(low, vocab.NOT_VENDOR_WORDS), -3) + one(F.size(money) > 0, -3)
    )


def _keyword_rank(low: Column, words) -> Column:
    """Words left from the first word that the text contains, 0 for none."""
    out = F
    for i, w in enumerate(words):
        out = out.when(low.contains(w), len(words) - i)
    return out.otherwise(0)


def _amount(words) -> Column:
    """max struct (score, early, value) over lines with index and text."""
    rank, value = _keyword_rank(F.col("low"), words), F.try_element_at("money", F.lit(-1))
    return F.max(F.when((rank > 0) & value.isNotNull(), F.struct((rank * 10 + F.col("index") * 0.1).alias("score"), (-F.col("index")).alias("early"), value.alias("value"))))["value"]


def extract(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page_num, line_ord, text) -> vendor, document_type, date, invoice_number, currency, subtotal, tax, total."""
    own = lines.withColumn("text", T.normalize(F.col("text"))).filter("text != ''")
    own = own.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "line_ord")) - 1)
    own = own.withColumn("low", T.canonical(F.col("text"))).withColumn("money", T.money_values(F.col("text"))).withColumn("day", T.iso_date(F.col("text")))
    score = F.when((F.col("page_num") == 1) & (F.col("index") < 8), vendor_score(F.col("text"), F.col("index"), F.col("low"), F.col("money")))
    best = F.max(F.when(score.isNotNull(), F.struct(score.alias("score"), (-F.col("index")).alias("early"), F.col("text").alias("text"))))
    date = F.min(F.when(F.col("day").isNotNull(), F.struct("index", "day")))["day"]
    blob = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "\n")
    out = own.groupBy("doc_id").agg(
        best.alias("best"), F.min(F.when(F.col("page_num") == 1, F.struct("index", "text")))["text"].alias("top"), date.alias("date"), blob.alias("blob"),
        _amount(vocab.SUBTOTAL_WORDS).alias("subtotal"), _amount(vocab.TAX_WORDS).alias("tax"), _amount(vocab.TOTAL_WORDS).alias("total"),
    )
    low = T.canonical(F.col("blob"))
    kind = F.when(T.contains_any(low, vocab.INVOICE_WORDS), "invoice").when(T.contains_any(low, vocab.RECEIPT_WORDS), "receipt").otherwise("invoice")
    currency = F.when(F.col("blob").contains("$") | low.contains("usd"), "USD").when(F.col("blob").contains("¥") | low.contains("rmb") | low.contains("cny"), "CNY").when(F.col("blob").contains("€"), "EUR").when(F.col("blob").contains("£"), "GBP").otherwise("")
    vendor = F.when(F.col("best.score") >= 0, F.col("best.text")).otherwise(F.coalesce("top", F.lit("")))
    return out.select("doc_id", vendor.alias("vendor"), kind.alias("document_type"), "date", F.regexp_extract("blob", vocab.INVOICE_NUMBER, 1).alias("invoice_number"), currency.alias("currency"), "subtotal", "tax", "total")


def table_score(rows: Column) -> Column:
    """How much a table looks like a list of items; at most 0 is no such table."""
    text = F.array_join(F.transform(F.get(rows, F.lit(0)), T.canonical), " ")
    every = tuple(w for words in vocab.ITEM_COLUMNS.values() for w in words)
    one = lambda words, x: F.when(T.contains_any(text, words), float(x)).otherwise(0.0)
    score = one(every, 6) + one(vocab.ITEM_COLUMNS["description"], 3) + one(vocab.ITEM_COLUMNS["amount"], 3) + one(vocab.ITEM_COLUMNS["quantity"], 2) + F.least(F.lit(4), F.size(rows) - 1)
    return F.when(F.size(rows) < 2, -1.0).otherwise(score)


def best_tables(tables: DataFrame) -> DataFrame:
    """Each document's best item table, the first of equals."""
    first = Window.partitionBy("doc_id").orderBy(F.desc("table_score"), "page_num", "table_id")
    return tables.withColumn("table_score", table_score(F.col("rows"))).withColumn("r", F.row_number().over(first)).filter("r = 1 and table_score > 0").drop("r", "table_score")


def line_items(lines: DataFrame) -> DataFrame:
    """Items of documents without an item table: lines of a description and an amount."""
    text = F.col("text")
    own = lines.withColumn("text", T.normalize(text)).filter(~T.contains_any(T.canonical(text), vocab.LINE_ITEM_SKIP_WORDS) & T.iso_date(text).isNull())
    own = own.withColumn("money", T.money_values(text)).filter(F.size("money") > 0).withColumn("description", F.regexp_replace(F.regexp_replace(text, vocab.MONEY, ""), r"^[ \-:|]+|[ \-:|]+$", ""))
    own = own.filter((F.length("description") >= 2) & F.col("description").rlike(r"\p{L}"))
    quantity = T.rounded(F.nullif(F.regexp_extract("text", r"(?iU)\b(\d+(?:\.\d+)?)\s*(?:x|×)\b", 1), F.lit("")).try_cast("double"), 2)
    return own.select("doc_id", "page_num", "line_ord", T.normalize(F.col("description")).alias("description"), quantity.alias("quantity"), F.try_element_at("money", F.lit(-2)).alias("unit_price"), F.try_element_at("money", F.lit(-1)).alias("amount"))
