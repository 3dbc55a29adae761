"""Risk of each processing layer under image degradations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def loss(before: Column, after: Column) -> Column:
    """The share that is lost, 0 to 1; 0 where there was nothing."""
    return F.when(before > 0, clamp((before - after) / before)).otherwise(0.0)


def variants() -> Column:
    """array<struct(variant, ocr, layout, extraction, reasoning)> of base risks."""
    return F.array(*[F.struct(F.lit(name).alias("variant"), *[F.lit(float(x)).alias(layer) for layer, x in zip(vocab.LAYERS, risks)]) for name, risks in vocab.VARIANTS.items()])


def risk_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low")


def proxy_scores(measured: DataFrame) -> DataFrame:
    """measured(doc_id, variant, base risks, contrast, edge, brightness before (b_) and after (d_)) with a score a layer.

    Risks of recognition and layout go on into extraction, and those into reasoning.
    """
    c = F.col
    contrast, edge = loss(c("b_contrast"), c("d_contrast")), loss(c("b_edge"), c("d_edge"))
    shift = clamp(F.abs(c("d_brightness") - c("b_brightness")) / 120.0)
    out = measured.withColumn("s_ocr", clamp(c("ocr") + contrast * 0.24 + edge * 0.26 + shift * 0.08)).withColumn("s_layout", clamp(c("layout") + edge * 0.20 + shift * 0.04))
    out = out.withColumn("s_extraction", clamp(c("extraction") + c("s_ocr") * 0.12 + c("s_layout") * 0.14)).withColumn("s_reasoning", clamp(c("reasoning") + c("s_extraction") * 0.12 + c("s_ocr") * 0.06))
    return out.withColumns({f"s_{x}": T.rounded(c(f"s_{x}"), 3) for x in vocab.LAYERS})


def with_probe(scored: DataFrame) -> DataFrame:
    """Scores raised to what a probe of degraded pages lost: word, confidence, layout, table and evidence counts a page (b_, p_)."""
    c = F.col
    own = {
        "ocr": F.greatest(loss(c("b_words"), c("p_words")), loss(c("b_confidence"), c("p_confidence"))),
        "layout": F.greatest(loss(c("b_items"), c("p_items")), loss(c("b_tables"), c("p_tables"))),
        "extraction": loss(c("b_tables"), c("p_tables")),
        "reasoning": loss(c("b_units"), c("p_units")),
    }
    return scored.withColumns({f"s_{k}": T.rounded(clamp(F.greatest(c(f"s_{k}"), F.coalesce(v, F.lit(0.0)))), 3) for k, v in own.items()})


def report(scored: DataFrame) -> DataFrame:
    """(doc_id, variant, layer, score, risk, is_weakest): the weakest layer is the first of the greatest."""
    rows = F.array(*[F.struct(F.lit(x).alias("layer"), F.lit(i).alias("i"), F.col(f"s_{x}").alias("score")) for i, x in enumerate(vocab.LAYERS)])
    top = F.array_max(F.transform(rows, lambda r: F.named_struct(F.lit("score"), r["score"], F.lit("e"), r["i"] * -1)))
    each = scored.select("doc_id", "variant", top.alias("top"), F.explode(rows).alias("r"))
    return each.select("doc_id", "variant", "r.layer", "r.score", risk_label(F.col("r.score")).alias("risk"), (F.col("r.i") == -F.col("top.e")).alias("is_weakest"))


def visual_metrics(images: DataFrame) -> DataFrame:
    """images(doc_id, page_num, variant, height, width, grey binary) -> brightness, contrast and edge strength."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.frombuffer(r.grey, dtype=np.uint8).reshape(r.height, r.width).astype(float)
                edge = (np.abs(np.diff(x, axis=1)).sum() + np.abs(np.diff(x, axis=0)).sum()) / max(1, x.size)
                out.append((r.doc_id, r.page_num, r.variant, float(x.mean()), float(x.std()), float(edge)))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "variant", "brightness", "contrast", "edge"])

    return images.select("doc_id", "page_num", "variant", "height", "width", "grey").mapInPandas(run, "doc_id long, page_num int, variant string, brightness double, contrast double, edge double")


def _contrast(y: np.ndarray, factor: float) -> np.ndarray:
    """Distances from the mean grey, which is a whole number, times the factor."""
    mean = np.floor(y.mean() + 0.5)
    return mean + (y - mean) * factor


def _smooth(y: np.ndarray, kernel) -> np.ndarray:
    """Filtered along both axes with a symmetric kernel; edges are continued."""
    half = len(kernel) // 2
    for axis in (0, 1):
        wide = np.pad(y, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        y = sum(k * np.take(wide, np.arange(i, i + y.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return y


def _sampled(y: np.ndarray, at_y: np.ndarray, at_x: np.ndarray, fill: float = 255.0) -> np.ndarray:
    """Bilinear samples at places of the page; what lies outside is white."""
    h, w = y.shape
    wide = np.pad(y, 1, constant_values=fill)
    at_y, at_x = np.clip(at_y + 1, 0, h + 1), np.clip(at_x + 1, 0, w + 1)
    j, i = np.minimum(at_y.astype(int), h), np.minimum(at_x.astype(int), w)
    v, u = at_y - j, at_x - i
    return (wide[j, i] * (1 - u) + wide[j, i + 1] * u) * (1 - v) + (wide[j + 1, i] * (1 - u) + wide[j + 1, i + 1] * u) * v


def _inside(h: int, w: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """Where pixels lie in an ellipse (left, top, right, bottom)."""
    x0, y0, x1, y1 = box
    yy, xx = np.ogrid[:h, :w]
    return ((xx - (x0 + x1) / 2) / max((x1 - x0) / 2, 0.5)) ** 2 + ((yy - (y0 + y1) / 2) / max((y1 - y0) / 2, 0.5)) ** 2 <= 1


def _grey(red: int, green: int, blue: int) -> float:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def degrade(x: np.ndarray, variant: str) -> np.ndarray:
    """A grey page (height x width) under one degradation; colours count as their grey value."""
    h, w = x.shape
    y = x.astype(float)
    over = lambda y, where, grey, alpha: np.where(where, y + (grey - y) * alpha / 255, y)
    yy, xx = np.mgrid[:h, :w]
    if variant == "scan_low_contrast":
        y = np.clip(_contrast(y, 0.72), 0, 255) * 1.08
        across, down = max(10, w // 120), max(10, h // 150)
        seed = np.where((xx % across == 0) & (yy % down == 0), (xx * 37 + yy * 17) % 31, -1)
        for value, grey, alpha in ((0, 30, 42), (7, 255, 58)):  # specks of two by two pixels
            at = seed == value
            spread = at | np.pad(at, ((0, 0), (1, 0)))[:, :w]
            y = over(y, spread | np.pad(spread, ((1, 0), (0, 0)))[:h], grey, alpha)
    elif variant == "skew":
        angle, cy, cx = np.radians(3.4), (h - 1) / 2, (w - 1) / 2
        dy, dx = yy - cy, xx - cx
        y = _sampled(y, cy + dx * np.sin(angle) + dy * np.cos(angle), cx + dx * np.cos(angle) - dy * np.sin(angle))
    elif variant == "shadow":
        mask = np.floor(np.floor(150 * np.arange(w) / max(1, w - 1)) * 0.52) / 255
        y = y + (_grey(42, 38, 34) - y) * mask[None, :]
        y = over(y, _inside(h, w, (int(w * 0.15), int(h * 0.05), int(w * 1.1), int(h * 0.7))), _grey(30, 28, 24), 26)
    elif variant == "curved":
        strip, reach = max(4, w // 170), max(6, min(30, h // 90))
        down = np.trunc(np.sin(np.arange(w) // strip * strip / max(1, w) * 2 * np.pi) * reach).astype(int)
        source = yy - down[None, :]
        y = np.where((source >= 0) & (source < h), np.take_along_axis(y, np.clip(source, 0, h - 1), axis=0), 255.0)
        # a 3 x 3 filter with 5 in the middle of ones
        box = _smooth(y, (1.0, 1.0, 1.0))
        y = (box + 4 * y) / 13
    elif variant == "screen_capture":
        small = max(1, int(h * 0.78)), max(1, int(w * 0.78))
        place = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        y = _sampled(y, *np.meshgrid(place(small[0], h), place(small[1], w), indexing="ij"))
        y = _sampled(y, *np.meshgrid(place(h, small[0]), place(w, small[1]), indexing="ij"))
        y = _contrast(y, 0.90)
        y = y + (_grey(232, 240, 255) - y) * 0.08
        gap = max(5, h // 180)
        for odd, alpha in ((0, 18), (1, 8)):
            y = over(y, (yy % gap == 0) & (yy // gap % 2 == odd), _grey(60, 80, 120), alpha)
    elif variant == "blur":
        bell = np.exp(-0.5 * (np.arange(-6, 7) / 1.8) ** 2)
        y = _contrast(_smooth(y, bell / bell.sum()), 0.92)
    else:
        raise ValueError(variant)
    return np.clip(np.rint(y), 0, 255).astype(np.uint8)


def degraded_pages(pages: DataFrame, most_pages: int = 3) -> DataFrame:
    """Each document's first `most_pages` pages (the lab's feature) in all variants, beside the original ('baseline')."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.frombuffer(r.grey, dtype=np.uint8).reshape(r.height, r.width)
                out += [(r.doc_id, r.page_num, v, r.height, r.width, (x if v == "baseline" else degrade(x, v)).tobytes()) for v in ("baseline", *vocab.VARIANTS)]
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "variant", "height", "width", "grey"])

    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    # places are found without the pictures
    place = pages.select("doc_id", "page_num").withColumn("place", first).filter(F.col("place") <= most_pages).drop("place")
    own = pages.join(place, ["doc_id", "page_num"], "left_semi").select("doc_id", "page_num", "height", "width", "grey")
    return own.mapInPandas(run, "doc_id long, page_num int, variant string, height int, width int, grey binary")


def baseline(words: DataFrame, lines: DataFrame | None = None, items: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Per document of words what each of the four layers found.

    Recognition from words (and lines), layout from items(doc_id, type), and of counts (doc_id and any of COUNTED)
    those that are there; what wasn't made counts as 0.
    """
    known = F.when(F.col("confidence") >= 0, F.col("confidence"))
    out = words.groupBy("doc_id").agg(F.count("*").alias("word_count"), F.countDistinct("page_num").alias("page_count"), T.rounded(F.coalesce(F.avg(known), F.lit(0.0)), 3).alias("average_confidence"), F.count_if(known < vocab.LOW_CONFIDENCE).alias("low_confidence_words"), F.count(known).alias("known"))
    out = out.withColumn("low_confidence_ratio", T.rounded(F.col("low_confidence_words") / F.greatest(F.lit(1), F.col("known")), 4)).drop("known")
    parts = [(lines, lambda g: g.agg(F.count("*").alias("line_count")), ["line_count"])]
    parts.append((items, lambda g: g.agg(F.count("*").alias("layout_item_count"), F.count_if(F.col("type") == "heading").alias("heading_count"), F.count_if(F.col("type") == "table").alias("layout_table_item_count")), ["layout_item_count", "heading_count", "layout_table_item_count"]))
    for df, made, names in parts:
        out = out.join(made(df.groupBy("doc_id")), "doc_id", "left") if df is not None else out.withColumns({n: F.lit(None).cast("long") for n in names})
    there = [c for c in COUNTED if counts is not None and c in counts.columns]
    out = out.join(counts.select("doc_id", *there), "doc_id", "left") if there else out
    out = out.withColumns({c: F.lit(None).cast("long") for c in COUNTED if c not in there})
    return out.fillna(0).withColumn("chart_qa_ready", F.col("chart_candidate_count") > 0)


#: What other stages count for the layers layout, extraction and reasoning.
COUNTED = (
    "layout_chunk_count", "table_chunk_count", "native_text_page_count", "table_count", "form_field_count", "selected_option_count", "receipt_line_item_count", "contract_field_count", "consolidated_item_count", "transaction_count",
    "query_candidate_count", "evidence_unit_count", "evidence_query_count", "chart_candidate_count",
)
