"""Files that come in: their kind, their pages' words, and a fingerprint by which a result is made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

WORDS = (
    "doc_id long, page_num int, word_ord int, text string, confidence double, left int, top int, right int, bottom int, "
    "block_num int, par_num int, line_num int, word_num int, source string, angle double, page_width int, page_height int"
)
PREPROCESS_MODES = ("none", "clean", "binary")


def upload_kind(name: Column, content_type: Column | None = None) -> Column:
    """pdf or image by extension, else by content type, else null."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = F.when(extension.isin(*vocab.PDF_EXTENSIONS), "pdf").when(extension.isin(*vocab.IMAGE_EXTENSIONS), "image")
    if content_type is not None:
        mime = F.lower(content_type)
        kind = F.coalesce(kind, F.when(mime.isin("application/pdf", "application/x-pdf"), "pdf").when(mime.startswith("image/"), "image"))
    return kind


def preprocess_mode(mode: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(m.isin(*PREPROCESS_MODES), m).otherwise("clean")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_file, source_kind, length, sha256) of all supported files below a folder; contents aren't kept."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("source_file"), upload_kind(name).alias("source_kind"), "length", F.sha2("content", 256).alias("sha256")).filter("source_kind is not null")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, grey binary) of the images below a folder, decoded by Spark's image source."""
    found = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            grey = []
            for r in b.itertuples():
                x = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                # blue, green, red in Spark's order
                grey.append((x[:, :, 0] if r.nChannels == 1 else np.rint(x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"path": b["origin"], "height": b["height"], "width": b["width"], "grey": grey})

    return found.mapInPandas(run, "path string, height int, width int, grey binary")


def word_records(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Words that an outside recognizer has written, one record a word; see WORDS. Rendering and recognition stay outside."""
    return spark.read.schema(WORDS).format(format).load(path)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of a request's content hash and parameters, in their order."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def once(requests: DataFrame) -> DataFrame:
    """requests(job_id, fingerprint, …): the first job of each fingerprint runs, the others reuse its result."""
    first = requests.groupBy("fingerprint").agg(F.min("job_id").alias("runs_as"))
    return requests.join(first, "fingerprint").withColumn("cached", F.col("job_id") != F.col("runs_as"))
