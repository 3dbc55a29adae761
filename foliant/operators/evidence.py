"""Questions answered from evidence units by token overlap."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

TOP, LEAST = 5, 1.4
#: Questions that go to all tasks as one table; more are worked in further passes.
QUESTIONS_AT_ONCE = 500


class Question(NamedTuple):
    query_id: int
    tokens: list[str]
    intents: list[str]


def intents(query: Column) -> Column:
    """array<string> of the question's intents."""
    low = T.canonical(query)
    return F.filter(F.array(*[F.when(T.contains_any(low, words), name) for name, words in vocab.EVIDENCE_INTENTS.items()]), lambda x: x.isNotNull())


def units(records: DataFrame) -> DataFrame:
    """records(doc_id, ord, unit_type, text, page_nums, title_context) as evidence units with id and tokens; empty texts go."""
    named = records.withColumn("text", T.normalize(F.col("text"))).filter("text != ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return named.withColumn("unit_id", F.format_string("evidence_%04d_%s", n, F.col("unit_type"))).withColumn("tokens", T.tokens(F.col("text"), vocab.EVIDENCE_STOPWORDS)).withColumn("token_count", F.size("tokens"))


def outline_units(outline: DataFrame) -> DataFrame:
    """outline(doc_id, ord, level, title, page_num) as records for units()."""
    return outline.select("doc_id", "ord", F.lit("outline").alias("unit_type"), F.col("title").alias("text"), F.array("page_num").alias("page_nums"), F.lit("").alias("title_context"))


def page_range(first: Column, last: Column) -> Column:
    """array<int> of the pages from first to last, empty where one is null."""
    return F.when(first.isNotNull() & last.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def document_records(chunks: DataFrame, summaries: DataFrame, outline: DataFrame, fields: DataFrame) -> DataFrame:
    """Records for units(), in order: chunks, the summary, outline rows, fixed fields.

    chunks(doc_id, ord, type, text, page_nums, first_page, last_page, title_context): pages come from the range where
    none are named; summaries(doc_id, summary, page_count); fields(doc_id, ord, label, value).
    """
    none, empty = F.array().cast("array<int>"), F.lit("")
    place = lambda part, ord_: F.struct(F.lit(part).alias("part"), ord_.cast("long").alias("ord"))
    named = F.when(F.size(F.coalesce("page_nums", none)) > 0, F.col("page_nums")).otherwise(page_range(F.col("first_page"), F.col("last_page")))
    every = chunks.select("doc_id", place(0, F.col("ord")).alias("ord"), F.concat(F.lit("chunk_"), F.coalesce("type", F.lit("unknown"))).alias("unit_type"), "text", named.alias("page_nums"), F.coalesce("title_context", empty).alias("title_context"))
    every = every.unionByName(summaries.select("doc_id", place(1, F.lit(0)).alias("ord"), F.lit("direct_pdf_summary").alias("unit_type"), F.col("summary").alias("text"), page_range(F.lit(1), F.col("page_count").cast("int")).alias("page_nums"), empty.alias("title_context")))
    every = every.unionByName(outline.select("doc_id", place(2, F.col("ord")).alias("ord"), F.lit("direct_pdf_outline").alias("unit_type"), F.col("title").alias("text"), F.when(F.col("page_num").isNotNull(), F.array("page_num")).otherwise(none).alias("page_nums"), empty.alias("title_context")))
    shown = F.when(T.normalize(F.col("value")) != "", F.concat("label", F.lit(": "), "value"))
    return every.unionByName(fields.select("doc_id", place(3, F.col("ord")).alias("ord"), F.lit("direct_pdf_fixed_json").alias("unit_type"), shown.alias("text"), none.alias("page_nums"), empty.alias("title_context")))


def unit_score(query: Column, tokens: Column, low: Column, title_tokens: Column, unit_type: Column) -> Column:
    """Score of a unit for a question struct(tokens, intents)."""
    by_intent = F.lit(0.0)
    for name, words in vocab.EVIDENCE_INTENTS.items():
        by_intent = by_intent + F.when(F.array_contains(query["intents"], name) & T.contains_any(low, words), 1.5).otherwise(0.0)
    amount = F.when((unit_type == "chunk_table") & F.array_contains(query["intents"], "amount"), 0.8).otherwise(0.0)
    score = F.size(F.array_intersect(query["tokens"], tokens)) * 2.0 + by_intent + F.size(F.array_intersect(query["tokens"], title_tokens)) * 0.8 + amount
    return F.when(F.size(query["tokens"]) == 0, 0.0).otherwise(score)


def _flags(low: Column) -> Column:
    """Whether a text holds a word of each intent."""
    return F.array(*[T.contains_any(low, words) for words in vocab.EVIDENCE_INTENTS.values()])


def _scored(found: DataFrame, asked: list, top: int) -> DataFrame:
    """(query_id, score, doc_id, ord): each task's best units of each question.

    A unit's overlaps with all questions are one sum of rows of a (token x question) table, so a unit costs its tokens
    times the questions in numpy, and a task returns `top` rows a question at most.
    """
    number = {t: i for i, t in enumerate(sorted({t for q in asked for t in q.tokens}))}
    table = np.zeros((len(number), len(asked)), dtype=np.float32)
    for j, q in enumerate(asked):
        table[[number[t] for t in q.tokens], j] = 1
    names = list(vocab.EVIDENCE_INTENTS)
    wants = np.array([[n in q.intents for n in names] for q in asked], dtype=np.float64).reshape(len(asked), len(names))
    query_ids, answerable = [q.query_id for q in asked], np.array([bool(q.tokens) for q in asked])
    sent = found.sparkSession.sparkContext.broadcast((list(number), table, wants))

    def run(batches):
        known, table, wants = sent.value
        known, amount = pa.array(known, pa.string()), wants[:, names.index("amount")]
        best: list[list[tuple]] = [[] for _ in query_ids]

        def sums(lists):
            """Rows of the table added up over each row's tokens."""
            n = len(lists)
            flat = pc.index_in(lists.flatten(), value_set=known) if len(known) else pa.nulls(len(lists.flatten()), pa.int32())
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            hit = flat.is_valid().to_numpy(zero_copy_only=False)
            at, row = flat.filter(flat.is_valid()).to_numpy(zero_copy_only=False), row[hit]
            out = np.zeros((n, len(query_ids)))
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[row[first]] = np.add.reduceat(table[at], first, axis=0)
            return out

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                doc, place, kinds = (part.column(i).to_pylist() for i in range(3))
                score = sums(part.column(3)) * 2.0 + np.array(part.column(5).to_pylist(), dtype=np.float64).reshape(len(doc), -1) @ wants.T * 1.5 + sums(part.column(4)) * 0.8
                score += np.array([k == "chunk_table" for k in kinds])[:, None] * amount[None, :] * 0.8
                score = np.round(score, 3) * answerable
                for j in range(len(query_ids)):
                    own = score[:, j]
                    least = -best[j][-1][0] if len(best[j]) == top else 0.0
                    pick = np.flatnonzero((own > 0) & (own >= least))
                    if len(pick) > top:
                        pick = pick[own[pick] >= np.partition(own[pick], -top)[-top]]
                    if len(pick):
                        best[j] = sorted(best[j] + [(-own[i], doc[i], place[i]) for i in pick])[:top]
        out = [(query_ids[j], -s, d, p) for j, own in enumerate(best) for s, d, p in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["query_id", "score", "doc_id", "ord"])

    own = found.select(F.col("doc_id").cast("long"), F.col("ord").cast("long"), "unit_type", "tokens", T.tokens(F.coalesce("title_context", F.lit("")), vocab.EVIDENCE_STOPWORDS), _flags(F.lower("text")))
    return own.mapInArrow(run, "query_id long, score double, doc_id long, ord long")


def ranked(questions: DataFrame, found: DataFrame, top: int = TOP) -> tuple[DataFrame, int]:
    """((query_id, rank, score, doc_id, ord) of the best `top` units of each question, how many questions there are).

    questions(query_id, query) are a stated set, which goes to every task in parts of QUESTIONS_AT_ONCE: each unit is
    read once a part, and only `top` rows a question and task are shuffled. Ties go by (doc_id, ord).
    """
    asked = questions.select("query_id", T.tokens(F.col("query"), vocab.EVIDENCE_STOPWORDS).alias("q_tokens"), intents(F.col("query")).alias("intents"))
    rows = [Question(r.query_id, r.q_tokens, r.intents) for r in asked.collect()]
    parts = [_scored(found, rows[i : i + QUESTIONS_AT_ONCE], top) for i in range(0, len(rows), QUESTIONS_AT_ONCE)] or [_scored(found, [], top)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), len(rows)


def top_units(questions: DataFrame, found: DataFrame, top: int = TOP, within: str | None = None) -> DataFrame:
    """(query_id, rank, score, …unit columns): the best `top` units of each question, ties in (doc_id, unit order).

    within: a column of both sides that must be equal, such as doc_id for questions about one document; then questions
    and units are joined on it; else see ranked().
    """
    if within:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord")
        asked = questions.select("query_id", F.struct(T.tokens(F.col("query"), vocab.EVIDENCE_STOPWORDS).alias("tokens"), intents(F.col("query")).alias("intents")).alias("q"), F.col(within).alias("_within"))
        both = found.join(asked, F.col(within) == F.col("_within")).drop("_within")
        scored = unit_score(F.col("q"), F.col("tokens"), F.lower("text"), T.tokens(F.coalesce("title_context", F.lit("")), vocab.EVIDENCE_STOPWORDS), F.col("unit_type"))
        own = both.withColumn("score", T.rounded(scored, 3)).filter("score > 0").drop("q")
        return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best, n = ranked(questions, found, top)
    # at most `top` rows a question of the stated set
    return found.join(F.broadcast(best) if n * top <= 100_000 else best, ["doc_id", "ord"])


def best_sentence(text: Column, query_tokens: Column) -> Column:
    """The sentence with the most tokens of the question, the first of equals, cut to 420 characters."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[。.!?；;])\s+|\n+"), T.normalize), lambda s: s != "")
    scored = F.transform(parts, lambda s, i: F.named_struct(F.lit("n"), F.size(F.array_intersect(query_tokens, T.tokens(s, vocab.EVIDENCE_STOPWORDS))), F.lit("early"), i * -1, F.lit("s"), s))
    return T.compact(F.coalesce(F.array_max(scored)["s"], text), 420)


def answers(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per question: status, answer, score, confidence, evidence (unit ids, best first), pages."""
    asked = questions.select("query_id", "query", intents(F.col("query")).alias("intents"), T.tokens(F.col("query"), vocab.EVIDENCE_STOPWORDS).alias("query_tokens"))
    best = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "doc_id", "unit_id", "text", "page_nums"))).alias("top"))
    out = asked.join(best, "query_id", "left").withColumn("first", F.get("top", F.lit(0))).withColumn("score", F.coalesce("first.score", F.lit(0.0)))
    out = out.withColumn("snippet", best_sentence(F.col("first.text"), F.col("query_tokens")))
    search = F.concat_ws("\n", "snippet", "first.text")
    has = lambda name: F.array_contains("intents", name)
    money = F.try_element_at(T.money_tokens(search), F.lit(-1))
    date = T.first_match(search, vocab.EVIDENCE_DATE)
    answer = F.when(has("amount") & money.isNotNull(), T.normalize(money)).when(has("date") & date.isNotNull(), T.normalize(date)).when(has("summary"), T.compact(F.col("snippet"), 260)).otherwise(T.compact(F.col("snippet"), 220))
    ok = F.col("score") >= LEAST
    return out.select(
        "query_id", F.when(T.normalize(F.col("query")) == "", "error").when(ok, "ok").otherwise("insufficient_evidence").alias("status"), F.when(ok, answer).otherwise("").alias("answer"), "score",
        F.when(ok, T.rounded(F.least(F.lit(0.95), 0.45 + F.col("score") / 16), 3)).otherwise(0.0).alias("confidence"), F.when(ok, F.transform("top", lambda t: t["unit_id"])).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.when(ok, F.array_sort(F.array_distinct(F.flatten(F.transform("top", lambda t: t["page_nums"]))))).otherwise(F.array().cast("array<int>")).alias("pages"),
    )
