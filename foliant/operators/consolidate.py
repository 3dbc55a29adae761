"""Items and statement lines across pages: keep-first deduplication, sums and reconciliation with stated totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def keep_first(records: DataFrame, key: Column, order: list, doc: str = "doc_id") -> DataFrame:
    """records with dedupe_key, is_duplicate and duplicate_count (copies of the kept record) within each document."""
    w = Window.partitionBy(doc, "dedupe_key")
    return records.withColumn("dedupe_key", key).withColumn("is_duplicate", F.row_number().over(w.orderBy(*order)) > 1).withColumn("duplicate_count", F.count("*").over(w) - 1)


def duplicate_pairs(deduped: DataFrame, order: list, doc: str = "doc_id") -> DataFrame:
    """(doc, dedupe_key, kept_page_num, duplicate_page_num) of each dropped record."""
    w = Window.partitionBy(doc, "dedupe_key").orderBy(*order)
    return deduped.withColumn("kept_page_num", F.first("page_num").over(w)).filter("is_duplicate").select(doc, "dedupe_key", "kept_page_num", F.col("page_num").alias("duplicate_page_num"))


def _plain(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def item_key() -> Column:
    words = F.regexp_replace(T.canonical(F.col("description")), "[^a-z0-9一-鿿]+", "")
    return F.concat_ws("|", words, _plain(F.col("quantity")), _plain(F.col("unit_price")), _plain(F.col("amount")))


def transaction_key() -> Column:
    words = F.regexp_replace(T.canonical(F.col("description")), "[^a-z0-9一-鿿]+", "")
    return F.concat_ws("|", F.coalesce("date", F.lit("")), words, *[_plain(F.col(c)) for c in ("debit", "credit", "amount", "balance")])


def _header_text(row: Column) -> Column:
    return F.array_join(F.filter(F.transform(row, T.canonical), lambda c: c != ""), " ")


def _column(header: Column, words) -> Column:
    """Place of the first header cell with one of the words, or null."""
    hits = F.filter(F.transform(header, lambda c, i: F.when(T.contains_any(T.canonical(c), words), i)), lambda i: i.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def _all_words(columns) -> tuple:
    return tuple(w for words in columns.values() for w in words)


def items_from_tables(tables: DataFrame) -> DataFrame:
    """Item rows of all tables with an item header: tables(doc_id, table_id, page_num, rows array<array<string>>)."""
    header = F.col("header")
    named = tables.filter(F.size("rows") >= 2).withColumn("header", F.get("rows", F.lit(0))).filter(T.contains_any(_header_text(header), _all_words(vocab.ITEM_COLUMNS)))
    for name, words in vocab.ITEM_COLUMNS.items():
        at = _column(header, words)
        named = named.withColumn(f"at_{name}", F.coalesce(at, F.lit(0)) if name == "description" else at)
    rows = named.select("doc_id", "table_id", "page_num", "at_description", "at_quantity", "at_unit_price", "at_amount", F.posexplode(F.slice("rows", 2, F.size("rows") - 1)).alias("i", "row"))
    rows = rows.withColumn("row", F.transform("row", T.normalize)).filter(F.exists("row", lambda c: c != "")).filter(~T.contains_any(_header_text(F.col("row")), vocab.SUMMARY_WORDS))
    cell = lambda name: F.get("row", F.col(f"at_{name}"))
    numbers = F.filter(F.transform(F.filter("row", lambda c: c != ""), T.number_cell), lambda v: v.isNotNull())
    out = rows.select(
        "doc_id", "table_id", "page_num", (F.col("i") + 2).alias("row_index"), F.coalesce(cell("description"), F.get("row", F.lit(0))).alias("description"),
        T.number_cell(cell("quantity")).alias("quantity"), T.number_cell(cell("unit_price")).alias("unit_price"), F.coalesce(T.number_cell(cell("amount")), F.try_element_at(numbers, F.lit(-1))).alias("amount"),
    )
    return out.filter((F.col("description") != "") | F.col("amount").isNotNull())


def transactions_from_tables(tables: DataFrame) -> DataFrame:
    """Rows of all tables with a statement header (a date, an amount, and a balance or the word transaction)."""
    header, columns = F.col("header"), vocab.TRANSACTION_COLUMNS
    text = _header_text(header)
    amounts = columns["amount"] + columns["debit"] + columns["credit"]
    is_statement = T.contains_any(text, columns["date"]) & T.contains_any(text, amounts) & (T.contains_any(text, columns["balance"]) | T.contains_any(text, ("transaction", "交易")))
    named = tables.filter(F.size("rows") >= 2).withColumn("header", F.get("rows", F.lit(0))).filter(is_statement)
    for name, words in columns.items():
        named = named.withColumn(f"at_{name}", _column(header, words))
    rows = named.select("doc_id", "table_id", "page_num", *[f"at_{n}" for n in columns], F.posexplode(F.slice("rows", 2, F.size("rows") - 1)).alias("i", "row"))
    rows = rows.withColumn("row", F.transform("row", T.normalize)).filter(F.exists("row", lambda c: c != ""))
    cell = lambda name: F.get("row", F.col(f"at_{name}"))
    number = {n: T.number_cell(cell(n)) for n in ("debit", "credit", "amount", "balance")}
    raw, change = F.coalesce(cell("date"), F.lit("")), T.rounded(F.coalesce(number["credit"], F.lit(0.0)) - F.coalesce(number["debit"], F.lit(0.0)), 2)
    either = number["debit"].isNotNull() | number["credit"].isNotNull()
    out = rows.select(
        "doc_id", "table_id", "page_num", (F.col("i") + 2).alias("row_index"), T.iso_date(raw).alias("parsed"), raw.alias("raw"), F.coalesce(cell("description"), F.array_join("row", " ")).alias("description"),
        number["debit"].alias("debit"), number["credit"].alias("credit"), F.coalesce(number["amount"], F.when(either, change)).alias("amount"), number["balance"].alias("balance"),
    )
    return out.filter("parsed is not null or amount is not null or balance is not null").withColumn("date", F.coalesce("parsed", "raw")).drop("parsed", "raw")


def balances(lines: DataFrame) -> DataFrame:
    """(doc_id, opening, closing): the first opening and the last closing balance by keyword."""
    low, value = T.canonical(F.col("text")), T.last_money(F.col("text"))
    pick = lambda words: F.when(T.contains_any(low, words) & value.isNotNull(), F.struct("line_ord", value.alias("v")))
    return lines.groupBy("doc_id").agg(F.min(pick(vocab.OPENING_WORDS))["v"].alias("opening"), F.max(pick(vocab.CLOSING_WORDS))["v"].alias("closing"))


def _status(difference: Column, tolerance: Column) -> Column:
    return F.when(difference.isNull(), "not_available").when(F.abs(difference) <= tolerance, "matched").otherwise("mismatch")


def _exact_sum(amount: Column) -> Column:
    """The sum of the amounts in whatever order they come: exact to 1e-10 where all are below 1e15, else of doubles."""
    exact = F.when(F.abs(amount) < 1e15, amount).cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(amount), F.sum(exact).cast("double")).otherwise(F.sum(amount))


def reconcile_items(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Per document of totals(doc_id, tax, total): item_count, duplicates, item_sum, calculated_total, difference, tolerance, status.

    raw_sum and raw_difference are the sum and the difference before they are rounded, null where there is none.
    """
    kept = keep_first(items, item_key(), ["ord"])
    sums = kept.groupBy("doc_id").agg(F.count_if(~F.col("is_duplicate")).alias("item_count"), F.count_if("is_duplicate").alias("duplicates"), _exact_sum(F.when(~F.col("is_duplicate"), F.col("amount"))).alias("raw_sum"))
    out = totals.join(sums, "doc_id", "left").withColumn("item_sum", T.rounded(F.coalesce("raw_sum", F.lit(0.0)), 2))
    out = out.withColumn("calculated_total", F.when(F.col("item_count") > 0, T.rounded(F.col("item_sum") + F.coalesce("tax", F.lit(0.0)), 2)))
    out = out.withColumn("difference", T.rounded(F.col("total") - F.col("calculated_total"), 2)).withColumn("tolerance", F.greatest(F.lit(0.05), F.coalesce(F.abs("total") * 0.01, F.lit(0.05))))
    out = out.withColumn("raw_difference", F.col("total") - (F.col("raw_sum") + F.coalesce("tax", F.lit(0.0))))
    return out.select("doc_id", F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "item_sum", "calculated_total", "difference", "tolerance", _status(F.col("difference"), F.col("tolerance")).alias("status"), "raw_sum", "raw_difference")


def reconcile_statements(transactions: DataFrame, stated: DataFrame) -> DataFrame:
    """Per document of stated(doc_id, opening, closing): transaction_count, duplicates, net_change, calculated_closing, difference, status."""
    kept = keep_first(transactions, transaction_key(), ["ord"])
    sums = kept.groupBy("doc_id").agg(F.count_if(~F.col("is_duplicate")).alias("transaction_count"), F.count_if("is_duplicate").alias("duplicates"), F.sum(F.when(~F.col("is_duplicate"), F.col("amount"))).alias("sum"))
    out = stated.join(sums, "doc_id", "left").withColumn("net_change", T.rounded(F.coalesce("sum", F.lit(0.0)), 2))
    out = out.withColumn("calculated_closing", T.rounded(F.col("opening") + F.col("net_change"), 2)).withColumn("difference", T.rounded(F.col("closing") - F.col("calculated_closing"), 2))
    return out.select("doc_id", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "opening", "closing", "net_change", "calculated_closing", "difference", _status(F.col("difference"), F.lit(0.05)).alias("status"))


def document_kind(blob: Column, has_transactions: Column, has_receipt: Column, has_contract: Column, has_form: Column, is_bundle: Column) -> Column:
    """The kind of a consolidated document, in order of precedence. has_receipt: items or a stated total."""
    bank = has_transactions | T.contains_any(T.canonical(blob), vocab.BANK_WORDS)
    return F.when(bank, "bank_statement").when(has_receipt, "invoice_receipt").when(has_contract, "contract").when(has_form, "form").when(is_bundle, "mixed_bundle").otherwise("generic")


def items_or_receipt(items: DataFrame, receipt_items: DataFrame) -> DataFrame:
    """Items of tables, and of documents without such items those of their receipt, with source."""
    own = items.withColumn("source", F.lit("table"))
    rest = receipt_items.join(items.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("source", F.lit("receipt_invoice_result"))
    return own.unionByName(rest, allowMissingColumns=True)


def page_summaries(pages: DataFrame, labels: DataFrame, items: DataFrame, transactions: DataFrame) -> DataFrame:
    """(doc_id, page_num, label, item_count, transaction_count) of every page."""
    key = ["doc_id", "page_num"]
    out = pages.select(*key).distinct().join(labels.select(*key, "label"), key, "left")
    for name, rows in (("item_count", items), ("transaction_count", transactions)):
        out = out.join(rows.groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    return out.select(*key, F.coalesce("label", F.lit("")).alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("item_count", "transaction_count")])


def carried_form(forms: DataFrame) -> DataFrame:
    """forms(doc_id, fields map, selected_options array): a form as it is carry over, its options once each and sorted."""
    return forms.withColumn("selected_options", F.array_sort(F.array_distinct(F.coalesce("selected_options", F.array().cast("array<string>")))))


def consolidated(documents: DataFrame, items: DataFrame, transactions: DataFrame, stated: DataFrame) -> DataFrame:
    """Per document its kind, status and both reconciliations.

    documents(doc_id, blob, page_count, tax, total, has_contract, has_form, is_bundle); items and transactions with ord;
    stated(doc_id, opening, closing). Documents of one page without items or transactions are skipped.
    """
    invoice = reconcile_items(items, documents.select("doc_id", "tax", "total")).select("doc_id", "item_count", F.col("duplicates").alias("duplicate_items"), "item_sum", "calculated_total", F.col("status").alias("total_check"))
    bank = reconcile_statements(transactions, documents.select("doc_id").join(stated, "doc_id", "left")).select("doc_id", "transaction_count", F.col("duplicates").alias("duplicate_transactions"), "net_change", F.col("status").alias("balance_check"))
    out = documents.join(invoice, "doc_id").join(bank, "doc_id")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = document_kind(F.coalesce("blob", F.lit("")), F.col("transaction_count") > 0, (F.col("item_count") > 0) | F.col("total").isNotNull(), yes("has_contract"), yes("has_form"), yes("is_bundle"))
    status = F.when((F.col("page_count") > 1) | (F.col("item_count") > 0) | (F.col("transaction_count") > 0), "ok").otherwise("skipped")
    return out.select("doc_id", status.alias("status"), kind.alias("document_kind"), "item_count", "duplicate_items", "item_sum", "calculated_total", "total_check", "transaction_count", "duplicate_transactions", "net_change", "balance_check")
