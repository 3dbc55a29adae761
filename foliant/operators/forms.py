"""Key-value fields and checkboxes of forms.

lines(doc_id, page_num, line_ord, text, left, top, right, bottom).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

#: All labels, longer ones first.
ALIASES = sorted(((name, alias) for name, own in vocab.FIELD_ALIASES.items() for alias in own), key=lambda x: -len(x[1]))
SOURCES = ("inline", "right_neighbor", "below_neighbor", "checkbox")


def label_key(text: Column) -> Column:
    return F.regexp_replace(T.canonical(text), r"(?U)[\s:：_\-.·/\\|()\[\]{}]+", "")


def clean_value(text: Column) -> Column:
    return T.normalize(F.regexp_replace(F.regexp_replace(T.normalize(text), r"^[:：\-—_.,;| ]+", ""), "_{2,}", " "))


def alias(text: Column) -> Column:
    """struct(field, rest) for a line that begins with a label, the longest one, or null."""
    t, out = T.normalize(text), F
    low = T.canonical(text)
    for name, label in ALIASES:
        out = out.when(low.startswith(label), F.struct(F.lit(name).alias("field"), F.substring(t, F.lit(len(label) + 1), F.length(t)).alias("rest")))
    return out


def is_label(text: Column) -> Column:
    keys = sorted({a.replace(" ", "").replace("-", "") for _, a in ALIASES})
    return label_key(text).isin(*keys)


def normalize_value(field: Column, value: Column) -> Column:
    v = clean_value(value)
    phone = F.coalesce(T.first_match(v, vocab.MOBILE), F.nullif(T.normalize(F.regexp_extract(v, vocab.PHONE, 0)), F.lit("")), v)
    genders = F.create_map(*[F.lit(x) for pair in vocab.GENDERS.items() for x in pair])
    return (
        F.when(field == "date", F.coalesce(T.iso_date(v), v))
        .when(field == "phone", phone)
        .when(field == "email", F.coalesce(T.first_match(v, vocab.EMAIL), v))
        .when(field == "id_number", F.coalesce(F.upper(T.first_match(v, vocab.CN_ID)), v))
        .when(field == "gender", F.coalesce(F.element_at(genders, F.lower(v)), v))
        .otherwise(v)
    )


def ordered(lines: DataFrame) -> DataFrame:
    """lines with text normalized, blank ones gone, and their order in the document."""
    own = lines.withColumn("text", T.normalize(F.col("text"))).filter("text != ''")
    return own.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "top", "left", "line_ord")))


def _neighbours(own: DataFrame) -> DataFrame:
    """For lines that are a label alone: the nearest value to the right, else below; an address goes on over further lines."""
    labelled = own.withColumn("hit", alias(F.col("text"))).filter(F.col("hit").isNotNull() & (label_key(F.col("hit.rest")) == ""))
    label = labelled.select("doc_id", "page_num", F.col("order").alias("lo"), F.col("text").alias("label"), F.col("hit.field").alias("field"), *[F.col(c).alias(f"l_{c}") for c in ("left", "top", "right", "bottom")])
    value = own.filter(~is_label(F.col("text")))
    c, height, l_height = F.col, F.col("bottom") - F.col("top"), F.col("l_bottom") - F.col("l_top")
    overlap = F.greatest(F.lit(0), F.least("bottom", "l_bottom") - F.greatest("top", "l_top"))
    level = (overlap >= F.least(height, l_height) * 0.35) | (F.abs((c("top") + c("bottom")) / 2 - (c("l_top") + c("l_bottom")) / 2) <= F.greatest(F.lit(12.0), l_height * 0.7))
    right = (c("left") >= c("l_right") - 8) & level
    below = (c("top") >= c("l_bottom")) & (c("top") - c("l_bottom") <= F.greatest(F.lit(80.0), l_height * 4.0)) & (c("left") <= c("l_left") + F.greatest(F.lit(48.0), (c("l_right") - c("l_left")) * 0.4))
    both = label.join(value, ["doc_id", "page_num"]).filter("order != lo").withColumn("rank", F.when(right, 1).when(below, 2)).filter("rank is not null")
    gap = F.when(c("rank") == 1, c("left") - c("l_right")).otherwise(c("top") - c("l_bottom"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "lo").orderBy("rank", gap, "order"))).filter("r = 1")
    return best.select("doc_id", "page_num", "lo", "label", "field", "rank", "order", "text", "left", "top", "right", "bottom")


def _continued(found: DataFrame, own: DataFrame) -> DataFrame:
    """Addresses with the lines that follow them closely."""
    address = found.filter("field = 'address'")
    after = own.select("doc_id", "page_num", F.col("order").alias("o"), F.col("text").alias("t"), F.col("left").alias("x"), F.col("top").alias("y"), F.col("bottom").alias("z"), is_label(F.col("text")).alias("known"))
    near = address.join(after, ["doc_id", "page_num"]).filter("o > order")
    rows = near.groupBy("doc_id", "lo").agg(F.array_sort(F.collect_list(F.struct("o", "t", "x", "y", "z", "known"))).alias("next"))
    c = F.col

    def step(acc, n):
        stop = acc["stop"] | (n["y"] - acc["bottom"] > F.greatest(F.lit(20.0), (c("bottom") - c("top")) * 1.4)) | (F.abs(n["x"] - c("left")) > F.greatest(F.lit(48.0), (c("right") - c("left")) * 0.2)) | n["known"]
        return F.struct(F.when(stop, acc["out"]).otherwise(F.concat_ws(" ", acc["out"], n["t"])).alias("out"), F.when(stop, acc["bottom"]).otherwise(n["z"]).alias("bottom"), stop.alias("stop"))

    out = found.join(rows, ["doc_id", "lo"], "left")
    start = F.struct(c("text").alias("out"), c("bottom").alias("bottom"), F.lit(False).alias("stop"))
    return out.withColumn("text", F.when(c("next").isNotNull(), F.aggregate("next", start, step, lambda acc: acc["out"])).otherwise(c("text"))).drop("next")


def checkboxes(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num, order, place, label, normalized_label, checked, marker) of every box with a label."""
    own = ordered(lines).filter(F.col("text").rlike(vocab.CHECKBOX))
    marks, parts = F.regexp_extract_all("text", F.lit(vocab.CHECKBOX), F.lit(0)), F.split("text", vocab.CHECKBOX, -1)
    rows = own.select("doc_id", "page_num", "order", F.posexplode(F.arrays_zip(marks.alias("marker"), F.slice(parts, 2, F.size(marks)).alias("label"))).alias("place", "x"))
    options = F.create_map(*[F.lit(x) for pair in vocab.OPTIONS.items() for x in pair])
    label = clean_value(F.col("x.label"))
    out = rows.select("doc_id", "page_num", "order", "place", label.alias("label"), F.coalesce(F.element_at(options, F.lower(label)), label).alias("normalized_label"), F.col("x.marker").isin(*vocab.CHECKED).alias("checked"), F.col("x.marker").alias("marker"))
    return out.filter("label != ''")


def extract(lines: DataFrame) -> DataFrame:
    """(doc_id, field, value, raw_value, page_num, source, label): each field once, inline before right, below and checkbox."""
    own = ordered(lines)
    inline = own.withColumn("hit", alias(F.col("text"))).filter("hit is not null").withColumn("raw", clean_value(F.regexp_replace("hit.rest", r"(?U)^[\s:：_\-.·|]+", "")))
    one = inline.select("doc_id", "page_num", "order", F.col("hit.field").alias("field"), F.lit(0).alias("rank"), "raw", F.col("text").alias("label"))
    beside = _continued(_neighbours(own), own).select("doc_id", "page_num", F.col("lo").alias("order"), "field", "rank", clean_value(F.col("text")).alias("raw"), "label")
    boxes = checkboxes(lines).filter("checked and normalized_label in ('male', 'female')").groupBy("doc_id").agg(F.min("normalized_label").alias("raw"), F.min(F.struct("order", "page_num")).alias("at"))
    ticked = boxes.select("doc_id", F.col("at.page_num").alias("page_num"), F.col("at.order").alias("order"), F.lit("gender").alias("field"), F.lit(3).alias("rank"), "raw", F.lit("gender").alias("label"))
    every = one.unionByName(beside).unionByName(ticked).filter("raw != ''")
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("rank", "order"))).filter("r = 1")
    sources = F.array(*map(F.lit, SOURCES))
    return first.select("doc_id", "field", normalize_value(F.col("field"), F.col("raw")).alias("value"), F.col("raw").alias("raw_value"), "page_num", F.get(sources, F.col("rank")).alias("source"), "label")


def wide(fields: DataFrame) -> DataFrame:
    """One row a document: every field as a column, and field_count."""
    return fields.groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit("")).alias(f) for f in vocab.FORM_FIELDS], F.count("*").alias("field_count"))
