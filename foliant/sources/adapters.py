"""The engine's tables from plain texts, HTML pages and business tables; all geometry is in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; one in fewer pieces than there are cores is spread over them, as its text work is dear."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of a text: one page, line i at left 80 and top 40 i, 30 high, 10 wide a character; blank lines go."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).filter(F.trim("text") != "")
    return rows.select("doc_id", F.lit(1).alias("page_num"), F.col("i").alias("line_ord"), "text", F.lit(80).alias("left"), (F.col("i") * 40).alias("top"), (80 + 10 * F.length("text")).alias("right"), (F.col("i") * 40 + 30).alias("bottom"))


def document_words(documents: DataFrame) -> DataFrame:
    """Words of each line with a stand-in for the confidence, (31 doc + 17 line + 7 word) mod 101."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    rows = lines.select("doc_id", "line_num", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("word_num", "text"))
    sure = (F.col("doc_id") * 31 + F.col("line_num") * 17 + F.col("word_num") * 7) % 101
    left = 80 + F.col("word_num") * 60
    return rows.select(
        "doc_id", F.lit(1).alias("page_num"), (F.col("line_num") * 10000 + F.col("word_num")).alias("word_ord"), "text", sure.cast("double").alias("confidence"), left.alias("left"), (F.col("line_num") * 40).alias("top"), (left + 50).alias("right"),
        (F.col("line_num") * 40 + 30).alias("bottom"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), "line_num", "word_num", F.lit("primary").alias("source"), F.lit(0.0).alias("angle"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """Headings (h1 to h6), list items and paragraphs of HTML in page order, whatever attributes their tags have."""
    body = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    start, end = r"<(?:h[1-6]|li|p)(?:\s[^>]*)?>", r"</(?:h[1-6]|li|p|article)>"
    found = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all(body, F.lit(rf"(?is){start}.*?(?={start}|{end}|\z)"), F.lit(0))).alias("item_ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"(?i)^<(h[1-6]|li|p)", 1))
    kind = F.when(tag == "li", "list_item").when(tag == "p", "paragraph").otherwise("heading")
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", ""), r"\s+", " "))
    return found.select("doc_id", F.lit(1).alias("page_num"), "item_ord", kind.alias("type"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("level"), F.lit(False).alias("ordered"), text.alias("text"))


def order_items(lineitem: DataFrame) -> DataFrame:
    """An order's lines as items of a receipt."""
    return lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.lit(1).alias("page_num"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"), F.lit(None).cast("double").alias("quantity"),
        F.lit(None).cast("double").alias("unit_price"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("amount"),
    )


def event_transactions(events: DataFrame) -> DataFrame:
    """A user's events as lines of a statement: purchases are debits, signups and clicks credits; others go."""
    c = F.col
    debit, credit = F.when(c("event_type") == "purchase", c("value")), F.when(c("event_type").isin("signup", "click"), c("value"))
    amount = F.coalesce(credit, F.lit(0.0)) - F.coalesce(debit, F.lit(0.0))
    rows = events.filter(c("event_type").isin("purchase", "signup", "click"))
    return rows.select(c("user_id").alias("doc_id"), c("event_id").alias("ord"), F.lit(1).alias("page_num"), F.date_format("ts", "yyyy-MM-dd").alias("date"), c("event_type").alias("description"), debit.alias("debit"), credit.alias("credit"), amount.alias("amount"), F.lit(None).cast("double").alias("balance"))


def customer_lines(customer: DataFrame) -> DataFrame:
    """Customers as forms of three lines: name, telephone, mail address."""
    key = F.col("c_custkey").cast("string")
    rows = F.array(F.concat(F.lit("Full Name: "), "c_name"), F.concat(F.lit("Telephone: 138"), F.lpad(key, 8, "0")), F.concat(F.lit("E-mail: c"), key, F.lit("@example.com")), F.concat(F.lit("Address: "), F.col("c_nationkey").cast("string"), F.lit(" Main Road")))
    each = customer.select(F.col("c_custkey").alias("doc_id"), F.posexplode(rows).alias("i", "text"))
    return each.select("doc_id", F.lit(1).alias("page_num"), F.col("i").alias("line_ord"), "text", F.lit(80).alias("left"), (F.col("i") * 40).alias("top"), (80 + 10 * F.length("text")).alias("right"), (F.col("i") * 40 + 30).alias("bottom"))


def supplier_lines(supplier: DataFrame) -> DataFrame:
    """Suppliers as contracts of six lines."""
    key = F.col("s_suppkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    date = lambda m: F.concat(F.lit("2026-"), pad((key + m) % 12 + 1, 2), F.lit("-"), pad(key % 28 + 1, 2))
    rows = F.array(
        F.concat(F.lit("Consulting Service Agreement "), key.cast("string")), F.concat(F.lit("Contract No: CTA-"), pad(key, 5)), F.concat(F.lit("Party A: "), "s_name"), F.lit("Party B: Bright Future LLC"),
        F.concat(F.lit("Effective Date: "), date(0)), F.concat(F.lit("End Date: "), date(5)),
    )
    return supplier.select(key.alias("doc_id"), F.posexplode(rows).alias("line_ord", "text")).select("doc_id", F.lit(1).alias("page_num"), "line_ord", "text")


def order_receipt_lines(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as receipts of five lines: customer's store, invoice number, date, tax, total."""
    cents = F.round(F.col("o_totalprice") % 1000, 2)
    money = lambda x: F.concat(F.lit("$"), F.call_function("format_number", x, F.lit("0.00")))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    rows = F.array(
        F.concat("c_name", F.lit(" Store Ltd")), F.concat(F.lit("Invoice No: INV-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.concat(F.lit("Tax "), money(F.floor(cents) / 10)), F.concat(F.lit("Grand Total "), money(cents)),
    )
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(rows).alias("line_ord", "text")).select("doc_id", F.lit(1).alias("page_num"), "line_ord", "text")


def monthly_points(orders: DataFrame) -> DataFrame:
    """Orders by priority as a table's series: the sum of whole prices a month."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    sums = orders.groupBy("o_orderpriority", month.alias("label")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("value"))
    n = F.year(F.to_date("label", "yyyy-MM")) * 12 + F.month(F.to_date("label", "yyyy-MM"))
    return sums.select(F.lit(1).alias("doc_id"), F.col("o_orderpriority").alias("name"), n.alias("row_index"), "label", "value")


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """Turns as pages of a bundle: user turns are forms, assistant turns reports, system turns receipts."""
    label = F.when(F.col("role") == "user", "form").when(F.col("role") == "assistant", "report").otherwise("receipt")
    hits, score = (F.length("text") % 3).cast("int"), 2.5 + (F.length("text") % 5) / 2
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), label.alias("label"), (F.length("text") % 4 / 8 + 0.5).alias("confidence"), hits.alias("hits"), score.alias("start_score"))


def event_revisions(events: DataFrame) -> DataFrame:
    """Events as revisions of a user's field, one a type."""
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("batch_id"), F.col("event_id").alias("ord"), F.col("value").alias("new_value"))
