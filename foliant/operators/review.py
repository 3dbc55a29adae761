"""Regions that a person should look at: signatures, handwriting, doubtful fields.

lines as of words.lines() with page_width and page_height; words as of words.usable().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import vocab
from ..functions.folds import fold_groups


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("left", "top", "right", "bottom")])


def line_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Lines with the words that have their block, paragraph and line number, or overlap them by 0.08."""
    own = words.select("doc_id", "page_num", F.struct("left", "top", "right", "bottom").alias("w_box"), F.col("confidence").alias("w_confidence"), *[F.col(c).alias(f"w_{c}") for c in ("block_num", "par_num", "line_num")])
    same = (F.col("block_num") == F.col("w_block_num")) & (F.col("par_num") == F.col("w_par_num")) & (F.col("line_num") == F.col("w_line_num"))
    return lines.join(own, ["doc_id", "page_num"]).filter(same | (G.iou(_box(), F.col("w_box")) >= 0.08))


def low_confidence_lines(lines: DataFrame, words: DataFrame, threshold: float = vocab.LOW_CONFIDENCE) -> DataFrame:
    """Lines with a word of known confidence below the threshold: avg_confidence (mean_confidence: before it is rounded) and the number of such words."""
    known = F.when(F.col("w_confidence") >= 0, F.col("w_confidence"))
    key = ["doc_id", "page_num", "line_ord", "text", "left", "top", "right", "bottom", "page_width", "page_height"]
    out = line_words(lines, words).groupBy(*key).agg(T.rounded(F.avg(known), 2).alias("avg_confidence"), F.avg(known).alias("mean_confidence"), F.count_if(known < threshold).alias("low_words"))
    return out.filter((F.col("low_words") > 0) & (T.normalize(F.col("text")) != ""))


def signature_regions(lines: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Lines that ask for a signature, their box widened to where it goes and over doubtful lines that it touches."""
    found = lines.filter(T.normalize(F.col("text")).rlike(vocab.SIGNATURE))
    w, h = F.col("page_width"), F.col("page_height")
    wide = G.clipped(F.col("left") - 16, F.col("top") - 16, F.col("right") + F.greatest(F.lit(180.0), w * 0.26), F.col("bottom") + F.greatest(F.lit(54.0), (F.col("bottom") - F.col("top")) * 2.5), w, h)
    base = found.select("doc_id", "page_num", "line_ord", T.normalize(F.col("text")).alias("label_text"), wide.alias("region"))
    other = doubtful.select("doc_id", "page_num", _box().alias("d"))
    near = base.join(other, ["doc_id", "page_num"], "left").withColumn("touches", F.coalesce(G.iou(F.col("region"), F.col("d")) >= 0.04, F.lit(False)))
    edge = lambda f, c: f(F.when(F.col("touches"), F.col(f"d.{c}")))
    out = near.groupBy("doc_id", "page_num", "line_ord", "label_text", "region").agg(edge(F.min, "left").alias("l"), edge(F.min, "top").alias("t"), edge(F.max, "right").alias("r"), edge(F.max, "bottom").alias("b"), F.count_if("touches").alias("linked"))
    return out.select("doc_id", "page_num", "line_ord", "label_text", F.least("region.left", "l").alias("left"), F.least("region.top", "t").alias("top"), F.greatest("region.right", "r").alias("right"), F.greatest("region.bottom", "b").alias("bottom"), "linked")


def handwriting_regions(doubtful: DataFrame, signatures: DataFrame, page_labels: DataFrame, fields: DataFrame | None = None, threshold: float = vocab.LOW_CONFIDENCE) -> DataFrame:
    """Doubtful lines that may be handwriting, their box a little wider, with the reason and the field that they name.

    page_labels(doc_id, page_num, label); fields(doc_id, page_num, field, label, value, ord): of those on the line's page
    the first whose label, or else value, the line holds.
    """
    boxes = signatures.select("doc_id", "page_num", _box().alias("s")).groupBy("doc_id", "page_num").agg(F.collect_list("s").alias("signed"))
    rows = doubtful.filter(~F.col("text").rlike(vocab.SIGNATURE)).join(boxes, ["doc_id", "page_num"], "left").join(page_labels, ["doc_id", "page_num"], "left")
    near = F.coalesce(F.exists("signed", lambda s: G.iou(_box(), s) >= 0.35), F.lit(False))
    reason = (
        F.when(near, "low-confidence text near signature area")
        .when(F.col("label").isin("form", "id"), "low-confidence line on form-like page")
        .when(F.col("text").rlike(vocab.FIELD_HINT), "field-like low-confidence line")
        .when(F.col("avg_confidence") < threshold - 8, "generic handwriting candidate")
    )
    out = rows.withColumn("reason", reason).filter("reason is not null").withColumn("t", T.normalize(F.col("text"))).drop("label")
    if fields is not None:
        known = fields.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("ord", "field", T.normalize(F.col("label")).alias("l"), T.normalize(F.col("value")).alias("v")))).alias("known"))
        holds = lambda x: (x != "") & F.col("t").contains(x)
        hit = F.filter("known", lambda f: holds(f["l"]) | holds(f["v"]))
        out = out.join(known, ["doc_id", "page_num"], "left").withColumn("linked_field", F.coalesce(F.get(hit, F.lit(0))["field"], F.lit("")))
    else:
        out = out.withColumn("linked_field", F.lit(""))
    wide = G.clipped(F.col("left") - 10, F.col("top") - 8, F.col("right") + 10, F.col("bottom") + 8, F.col("page_width"), F.col("page_height"))
    return out.withColumn("wide", wide).select("doc_id", "page_num", "line_ord", F.col("t").alias("text"), "avg_confidence", "linked_field", "reason", *[F.col(f"wide.{c}").alias(c) for c in ("left", "top", "right", "bottom")])


def page_counts(pages: DataFrame, signatures: DataFrame, handwriting: DataFrame, suspicious: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(doc_id, page_num, and a count of each kind of region, needs_review) of every page."""
    key, out = ["doc_id", "page_num"], pages.select("doc_id", "page_num").distinct()
    parts = {"signature_region_count": signatures, "handwriting_region_count": handwriting, "suspicious_field_count": suspicious, "low_confidence_region_count": doubtful}
    for name, rows in parts.items():
        out = out.join(rows.groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    out = out.fillna(0, list(parts))
    return out.withColumn("needs_review", (F.col("signature_region_count") > 0) | (F.col("handwriting_region_count") > 0) | (F.col("suspicious_field_count") > 0))


def looks_suspicious(field: Column, value: Column) -> Column:
    v = T.normalize(value)
    return (
        (v == "") | v.rlike(vocab.LINE_NOISE)
        | ((field == "date") & ~v.rlike(r"(?U)\d{4}[-/年.]\d{1,2}"))
        | ((field == "phone") & (F.length(F.regexp_replace(v, r"(?U)\D", "")) < 7))
        | ((field == "id_number") & (F.length(F.regexp_replace(v, "[^0-9A-Za-z]", "")) < 8))
    )


def suspicious_fields(fields: DataFrame, pages: DataFrame, anchors: DataFrame, threshold: float = vocab.LOW_CONFIDENCE) -> DataFrame:
    """Important fields that are missing, look wrong, or stand on a doubtful line.

    fields(doc_id, field, value, page_num); pages(doc_id, page_num); anchors(doc_id, field, avg_confidence). A field
    that a document lacks is reported on each of its pages.
    """
    wanted = pages.withColumn("field", F.explode(F.array(*map(F.lit, vocab.IMPORTANT_FIELDS))))
    own = fields.select("doc_id", "field", "value", F.col("page_num").alias("own_page"))
    rows = wanted.join(own, ["doc_id", "field"], "left").filter("own_page is null or own_page = page_num").join(anchors, ["doc_id", "field"], "left")
    value = F.coalesce("value", F.lit(""))
    reason = F.when(value == "", "important field is empty or missing").when(looks_suspicious(F.col("field"), value), "field value pattern looks suspicious").when(F.col("avg_confidence") < threshold, "field line confidence is below review threshold")
    return rows.withColumn("reason", reason).filter("reason is not null").select("doc_id", "page_num", "field", value.alias("value"), "avg_confidence", "reason")


def anchors(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, avg_confidence): confidence of the first line with the field's label, value or name."""
    own = lines.select("doc_id", "page_num", "line_ord", T.normalize(F.col("text")).alias("t"), "confidence")
    has = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & F.col("t").contains(F.col(c))
    both = fields.join(own, ["doc_id", "page_num"]).filter(has("label") | has("raw_value") | has("value") | F.lower("t").contains(F.col("field")))
    return both.groupBy("doc_id", "field").agg(F.min_by("confidence", "line_ord").alias("avg_confidence"))


def dedupe(regions: DataFrame, overlap: float = 0.7) -> DataFrame:
    """Regions in order of `ord`, without those that overlap an earlier kept one of the same field; one group is one page."""

    names = regions.columns

    def fold(page: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in page:
            for k in kept:
                x = max(0, min(r["right"], k["right"]) - max(r["left"], k["left"])) * max(0, min(r["bottom"], k["bottom"]) - max(r["top"], k["top"]))
                size = lambda b: max(0, b["right"] - b["left"]) * max(0, b["bottom"] - b["top"])
                union = size(r) + size(k) - x
                if union > 0 and x / union >= overlap and not (r.get("field") and k.get("field") and r["field"] != k["field"]):
                    break
            else:
                kept.append(r)
        return [tuple(r[c] for c in names) for r in kept]

    return fold_groups(regions, ["doc_id", "page_num"], ["ord"], fold, regions.schema)
