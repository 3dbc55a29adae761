"""The queries opN_<name>: each operator over its whole table, with the columns that the query's contract names."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html, language, media, minhash, pii, repeats, sharding
from .oracles import ORACLES
from .shared import table


def tokenizer() -> tuple[bytes, str]:
    """The public byte-level vocabulary's rank lines and its pattern."""
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents")).drop("kept")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities replaced; the key is the session's."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark)).withColumnRenamed("_n_entities", "n_entities")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(chat.expand(turns.unionByName(own)), in_order=True)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


__all__ = ["ORACLES", "QUERIES", "tokenizer"]

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_media": op2_media,
    "op3_suffixes": op3_suffixes,
    "op4_html": op4_html,
    "op5_hilbert": op5_hilbert,
    "op6_pii": op6_pii,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat": op9_chat,
    "op10_bpe": op10_bpe,
}
