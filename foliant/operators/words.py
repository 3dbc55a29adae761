"""Recognized words: merging of passes, artifact filter, and lines.

words(doc_id, page_num, word_ord, text, confidence, left, top, right, bottom, block_num, par_num, line_num, word_num,
source, angle). A confidence below 0 is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.folds import fold_groups

LINE_KEY = ["doc_id", "page_num", "source", "angle", "block_num", "par_num", "line_num"]


def match_key(text: Column) -> Column:
    """Letters and digits alone, case folded; the stripped text where there are none."""
    bare = F.regexp_replace(F.lower(T.normalize(text)), r"(?U)[^\p{L}\p{N}]", "")
    return F.when(bare != "", bare).otherwise(T.normalize(text))


def usable(words: DataFrame, least_confidence: float = -1.0) -> DataFrame:
    """Words with text and at least the confidence; confidences that aren't numbers count as unknown."""
    c = F.coalesce(F.col("confidence").try_cast("double"), F.lit(-1.0))
    return words.withColumn("confidence", c).filter((T.normalize(F.col("text")) != "") & (c >= least_confidence))


def keep_rotated(words: DataFrame) -> DataFrame:
    """Words of rotated passes that are sure enough: two letters or digits and 70, or one and 85 and no circle."""
    n = F.length(F.regexp_replace(F.col("text"), r"(?U)[^\p{L}\p{N}]", ""))
    circle = F.col("text").isin(*vocab.CIRCLES)
    return words.filter((F.col("angle") == 0) | ((n >= 2) & (F.col("confidence") >= 70)) | ((n == 1) & (F.col("confidence") >= 85) & ~circle))


def filter_artifacts(words: DataFrame) -> DataFrame:
    """words with rejected_reason: circles that stand alone, strokes of lines, and empty text; null for words to keep."""
    width, height = F.greatest(F.lit(1), F.col("right") - F.col("left")), F.greatest(F.lit(1), F.col("bottom") - F.col("top"))
    aspect, text = width / height, T.normalize(F.col("text"))
    alone = F.count("*").over(Window.partitionBy(*LINE_KEY)) <= 1
    circle = alone & text.isin(*vocab.CIRCLES) & aspect.between(0.6, 1.7) & (F.greatest(width, height) >= 8) & (F.col("confidence") < 80)
    stroke = text.rlike(r"^[|_\-=—–]+$") & ((aspect >= 5) | (aspect <= 0.2)) & (F.col("confidence") < 75)
    return words.withColumn("rejected_reason", F.when(text == "", "empty_text").when(circle, "circle_like_graphic").when(stroke, "table_or_shape_line"))


def lines(words: DataFrame) -> DataFrame:
    """One row a line: text in word order, box, mean of the known confidences (mean_confidence: before it is rounded, or null), low-confidence words."""
    ordered = F.array_sort(F.collect_list(F.struct("word_num", "word_ord", "text")))
    known = F.when(F.col("confidence") >= 0, F.col("confidence"))
    low = F.count_if((F.col("confidence") >= 0) & (F.col("confidence") < vocab.LOW_CONFIDENCE))
    return words.groupBy(*LINE_KEY).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        F.coalesce(T.rounded(F.avg(known), 2), F.lit(-1.0)).alias("confidence"), F.avg(known).alias("mean_confidence"), F.count("*").alias("word_count"), low.alias("low_confidence_words"), F.min("word_ord").alias("line_ord"),
    )


def merge_passes(base: DataFrame, extra: DataFrame, overlap: float = 0.55, margin: float = 8.0) -> DataFrame:
    """base with the words of a further pass that it lacks, page by page.

    A word of `extra` is a copy of the first earlier word that it overlaps by `overlap` with equal or contained text,
    or by 0.75; a copy replaces that word if it is surer by `margin` and the text agrees or the old one was below 35.
    The result depends on order, so each page is one fold.
    """
    keyed = lambda df, n: df.withColumn("match_key", match_key(F.col("text"))).withColumn("pass", F.lit(n))
    both = keyed(base, 0).unionByName(keyed(extra, 1))

    names = base.columns

    def fold(page: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for w in page:
            at = None
            if w["pass"]:
                for i, k in enumerate(kept):
                    x = max(0, min(w["right"], k["right"]) - max(w["left"], k["left"])) * max(0, min(w["bottom"], k["bottom"]) - max(w["top"], k["top"]))
                    size = lambda b: max(0, b["right"] - b["left"]) * max(0, b["bottom"] - b["top"])
                    union = size(w) + size(k) - x
                    iou = x / union if union > 0 else 0.0
                    agrees = bool(w["match_key"] and k["match_key"]) and (w["match_key"] in k["match_key"] or k["match_key"] in w["match_key"])
                    if iou >= overlap and (agrees or iou >= 0.75):
                        at = i
                        if 0 <= w["confidence"] >= k["confidence"] + margin and (agrees or k["confidence"] < 35):
                            kept[i] = w
                        break
            if at is None:
                kept.append(w)
        return [tuple(w[c] for c in names) for w in kept]

    return fold_groups(both, ["doc_id", "page_num"], ["pass", "word_ord"], fold, base.schema)


def otsu(histogram: DataFrame) -> DataFrame:
    """histogram(image_id, bin, n) -> (image_id, threshold): the first bin of greatest between-class variance, 180 if empty."""
    up = Window.partitionBy("image_id").orderBy("bin")
    whole = Window.partitionBy("image_id")
    mass = F.col("n") * F.col("bin")
    c = histogram.withColumns({"below": F.sum("n").over(up), "mass_below": F.sum(mass).over(up), "total": F.sum("n").over(whole), "mass": F.sum(mass).over(whole)})
    below, above = F.col("below"), F.col("total") - F.col("below")
    apart = F.col("mass_below") / below - (F.col("mass") - F.col("mass_below")) / above
    between = F.when((below > 0) & (above > 0), below * above * F.pow(apart, 2))
    best = c.groupBy("image_id").agg(F.max(F.struct(between.alias("v"), (-F.col("bin")).alias("b"))).alias("best"))
    return best.select("image_id", F.when(F.col("best.v") > 0, -F.col("best.b")).otherwise(180).alias("threshold"))
