"""Outlines and summaries of documents whose text is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Limits that are the feature: characters of a heading, candidates and outline rows of a page, outline rows and topics of a document.
HEADING_CHARS, CANDIDATES, PER_PAGE, PER_DOCUMENT, SUMMARY_CHARS, TOPICS = 96, 5, 2, 24, 520, 8
# Fixed value: how a line of a heading begins, by number, chapter word or capital letter.
HEADING = r"^(?:\d+(?:\.\d+){0,3}|第[一二三四五六七八九十百千0-9]+[章节部分篇]|[A-Z][A-Za-z ]{3,})"


def from_contents(toc: DataFrame) -> DataFrame:
    """toc(doc_id, ord, level, title, page_num) with path: the titles of all ancestors and its own.

    A row's ancestors are the last rows before it of each smaller level that none between has ended.
    """
    rows = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", "title", "page_num"))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("chain"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc, r):
        chain = F.concat(F.filter(acc["chain"], lambda x: x["level"] < r["level"]), F.array(F.struct(r["level"].cast("int").alias("level"), r["title"].alias("title"))))
        return F.struct(chain.alias("chain"), F.concat(acc["paths"], F.array(F.transform(chain, lambda x: x["title"]))).alias("paths"))

    folded = rows.select("doc_id", "rows", F.aggregate("rows", start, step, lambda acc: acc["paths"]).alias("paths"))
    each = folded.select("doc_id", F.explode(F.arrays_zip("rows", "paths")).alias("x"))
    return each.select("doc_id", "x.rows.ord", "x.rows.level", "x.rows.title", "x.rows.page_num", F.col("x.paths").alias("path"))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page_num, line_ord, text) -> (doc_id, page_num, rank, title): the first CANDIDATES heading-like lines of a page."""
    own = lines.select("doc_id", "page_num", "line_ord", T.normalize(F.col("text")).alias("title"))
    own = own.filter((F.col("title") != "") & (F.length("title") <= HEADING_CHARS) & F.col("title").rlike(HEADING))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("line_ord"))).filter(F.col("rank") <= CANDIDATES).drop("line_ord")


def inferred(candidates: DataFrame) -> DataFrame:
    """Outline of documents without contents: PER_PAGE candidates a page, PER_DOCUMENT in all."""
    own = candidates.filter(F.col("rank") <= PER_PAGE)
    own = own.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "rank"))).filter(F.col("ord") <= PER_DOCUMENT)
    return own.select("doc_id", "ord", F.lit(1).alias("level"), "title", "page_num")


def summaries(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, summary, topics): the pages' text cut to SUMMARY_CHARS, and the first distinct titles of all candidates."""
    whole = pages.filter(F.coalesce("text", F.lit("")) != "").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda p: p["text"]), " ").alias("t"))
    first = candidates.groupBy("doc_id", "title").agg(F.min(F.struct("page_num", "rank")).alias("at"))
    topics = first.groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), 1, TOPICS).alias("topics"))
    every = pages.select("doc_id").distinct()
    return every.join(whole, "doc_id", "left").join(topics, "doc_id", "left").select("doc_id", T.compact(F.coalesce("t", F.lit("")), SUMMARY_CHARS).alias("summary"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


# The parts that a strict payload needs.
REQUIRED = ("summary", "outline", "fixed_json", "rag_context")


def missing_parts(payload_keys, required=REQUIRED):
    """array<string> of the required parts that a payload lacks."""
    return F.array_except(F.array(*map(F.lit, required)), payload_keys)


def valid(payload_keys, required=REQUIRED):
    """Whether a strict payload names all required parts."""
    return F.size(missing_parts(payload_keys, required)) == 0


def rag_context(documents: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, chunk_count, table_chunk_count, referenced_chunk_ids): the first `most` chunk ids of each document."""
    own = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("type") == "table").alias("table_chunk_count"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]), 1, most).alias("referenced_chunk_ids"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return documents.select("doc_id").join(own, "doc_id", "left").select("doc_id", zero("chunk_count"), zero("table_chunk_count"), F.coalesce("referenced_chunk_ids", F.array().cast("array<string>")).alias("referenced_chunk_ids"))


def payload(summaries_: DataFrame, outline: DataFrame, contract: DataFrame, context: DataFrame) -> DataFrame:
    """A strict payload a document: summary, topics, outline, fixed_json (contract map), rag_context and whether it is complete.

    contract(doc_id, document_type, contract map<string,string>); documents without one get an empty map.
    """
    rows = outline.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", "title", "page_num"))).alias("outline"))
    out = summaries_.join(rows, "doc_id", "left").join(contract, "doc_id", "left").join(context.select("doc_id", F.struct("chunk_count", "table_chunk_count", "referenced_chunk_ids").alias("rag_context")), "doc_id", "left")
    out = out.withColumn("fixed_json", F.struct(F.coalesce("document_type", F.lit("")).alias("document_type"), F.coalesce("contract", F.create_map().cast("map<string,string>")).alias("contract"))).drop("document_type", "contract")
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in REQUIRED]))
    return out.withColumn("outline", F.coalesce("outline", F.array().cast("array<struct<ord:int,level:int,title:string,page_num:int>>"))).withColumn("missing_required_fields", missing_parts(keys)).withColumn("schema_valid", F.size("missing_required_fields") == 0)
