"""A corpus from raw documents: identify languages, drop near copies, decontaminate, replace personal data, encode.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), calls one operator and returns a DataFrame
that run() writes as Parquet in the cluster's shared folder and reads again as the next stage's docs. All but the
last return the columns of documents. Nulls, empty and repeated rows have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontaminate, language, minhash, pii
from foliant.llm.queries import tokenizer
from foliant.llm.shared import bounded, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this many percent of their word shingles' union.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; lang becomes the predicted language of the others."""
    bounded(spark)
    return language.keep_identified(docs.select(COLUMNS), language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays."""
    bounded(spark)
    return minhash.keep_first(docs.select(COLUMNS), NEAR_PERCENT)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the new text."""
    done = pii.replace(docs.select(COLUMNS), pii.session_key(spark))
    length = F.when(F.col("_n_entities") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length.cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again: the digests of both."""
    bounded(spark)
    return bpe.round_trip(docs, *tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

#: Connected components, a trained classifier and byte-pair merges aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
