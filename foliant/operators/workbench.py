"""The review workbench: predicted fields, the review queue, and the append-only log of revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def field_id(source: Column, path: Column) -> Column:
    return F.concat(source, F.lit(":"), F.regexp_replace(path, r"[^a-zA-Z0-9_.:-]+", "_"))


def predicted_fields(parts: dict[str, DataFrame]) -> DataFrame:
    """parts by source, each (doc_id, label, value, page_num, confidence) -> all fields with id and order.

    Sources are form, contract, receipt_invoice and multi_page_consolidation.
    """
    prefix = {"form": "form.fields.", "contract": "contract.fields.", "receipt_invoice": "receipt_invoice.normalized_receipt.", "multi_page_consolidation": "multi_page_consolidation."}
    out = None
    for source, rows in parts.items():
        path = F.concat(F.lit(prefix[source]), F.col("label"))
        own = rows.select("doc_id", F.lit(source).alias("source"), path.alias("field_path"), "label", T.normalize(F.col("value").cast("string")).alias("value"), F.col("page_num").cast("int").alias("page_num"), F.col("confidence").cast("double").alias("confidence"))
        out = own if out is None else out.unionByName(own)
    order = Window.partitionBy("doc_id").orderBy(F.col("page_num").isNull(), F.coalesce("page_num", F.lit(999999)), "source", "label")
    return out.withColumn("field_id", field_id(F.col("source"), F.col("field_path"))).withColumn("ord", F.row_number().over(order))


def queue(items: DataFrame, limit: int = vocab.QUEUE_LIMIT) -> DataFrame:
    """items(doc_id, type, page_num, text, confidence, field_path, source) -> each document's first `limit` in queue order.

    The limit is the queue's feature. A confidence of 0 sorts last among the known ones.
    """
    place = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 999.0).otherwise(F.col("confidence"))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page_num", F.lit(999999)), F.col("confidence").isNull(), place, "type", "source", "text")
    path = F.concat_ws(".", "type", F.col("page_num").cast("string"), F.coalesce("field_path", F.lit("")), "text")
    named = items.withColumn("text", T.normalize(F.col("text"))).withColumn("queue_id", F.substring(field_id(F.col("source"), path), 1, 160)).withColumn("status", F.lit("pending"))
    return named.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= limit)


def region_items(suspicious: DataFrame, handwriting: DataFrame, signatures: DataFrame, doubtful: DataFrame) -> DataFrame:
    """A review's regions as items of queue(); each kind is numbered on its page in its order."""
    parts = (
        ("suspicious_field", "suspicious_fields", suspicious, "field", F.coalesce(F.nullif("value", F.lit("")), "field"), F.col("avg_confidence"), F.concat(F.lit("form.fields."), "field")),
        ("handwriting_region", "handwriting_regions", handwriting, "line_ord", F.col("text"), F.col("avg_confidence"), F.col("linked_field")),
        ("signature_region", "signature_regions", signatures, "line_ord", F.col("label_text"), F.lit(None), F.lit("")),
        ("low_confidence_region", "low_confidence_regions", doubtful, "line_ord", F.col("text"), F.col("avg_confidence"), F.lit("")),
    )
    out = None
    for kind, path, rows, order, text, sure, field in parts:
        n = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(order))
        own = rows.select("doc_id", F.lit(kind).alias("type"), "page_num", text.alias("text"), sure.cast("double").alias("confidence"), field.alias("field_path"), F.concat(F.lit(f"review.{path}."), n.cast("string")).alias("source"))
        out = own if out is None else out.unionByName(own)
    return out


def page_views(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """pages(doc_id, page_num, text, page_width, page_height) with the review's counts, 0 where there are none."""
    names = [c for c in counts.columns if c.endswith("_count")]
    return pages.join(counts.select("doc_id", "page_num", *names), ["doc_id", "page_num"], "left").fillna(0, names)


def state(documents: DataFrame, fields: DataFrame, queued: DataFrame, revisions: DataFrame) -> DataFrame:
    """(doc_id, predicted_field_count, review_queue_count, revision_count) of every document."""
    out = documents.select("doc_id").distinct()
    for name, rows in (("predicted_field_count", fields), ("review_queue_count", queued), ("revision_count", revisions)):
        out = out.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    return out.fillna(0)


def sanitize(revisions: DataFrame) -> DataFrame:
    """Revisions with a field id, texts normalized, status corrected where it is absent; those that change nothing stay."""
    return revisions.filter("field_id is not null and field_id != ''").withColumns({c: T.normalize(F.col(c)) for c in ("old_value", "new_value")}).withColumn("review_status", F.coalesce(F.nullif(T.normalize(F.col("review_status")), F.lit("")), F.lit("corrected")))


def latest(revisions: DataFrame, key: tuple = ("doc_id", "field_id"), order: tuple = ("batch_id", "ord")) -> DataFrame:
    """The last revision of each field."""
    rest = [c for c in revisions.columns if c not in key]
    return revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[F.col(f"r.{c}") for c in rest])


def apply(fields: DataFrame, revisions: DataFrame) -> DataFrame:
    """Predicted fields with the last revision's value in place of theirs, and revised."""
    last = latest(revisions).select("doc_id", "field_id", "new_value")
    return fields.join(last, ["doc_id", "field_id"], "left").withColumn("revised", F.col("new_value").isNotNull()).withColumn("value", F.coalesce("new_value", "value")).drop("new_value")
