"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions alone.

Words of a text are its runs of bytes that aren't ASCII separators, A-Z lower-cased. A window is WINDOW consecutive
words of an item; an item of fewer words is one window.

1. Corpus frequencies of all test terms are counted (the corpus's words are added up before they are joined).
2. The index stores training postings (term, document, position) of each window's LISTS rarest terms and of the terms
   of proximity queries, as a table.
3. A window is sought from its rarest term: that term's list, less the term's place in the item, gives the diagonals
   (document position of the item's first word) on which the window may lie; the lists of the next rarest terms are
   intersected at their offsets in turn.
4. Windows that are left lie on few documents. Of these the postings of all words are made, and the lists of every
   place of the windows are intersected on their diagonals; places in a row that agree are phrase matches where they
   hold a whole window.
5. Proximity matches come from the same stored postings: places where an item's rarest terms lie close together.

Each join is on (document, position, term) or on a test-side table, which is broadcast only where its counted bytes
allow it (see shared.small); nothing but such keys is shuffled, never a text. Rows of the same text and id are
one document to the index.

Defined results: null and empty texts have no words, no hits, and are not contaminated; null or wordless items never
match; repeated items each count; rows that share a doc_id share their hits; a null doc_id is an id like others; an
empty table on either side gives no hits; other columns are not read. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words before A-Z is lower-cased.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists of a window that are intersected before all words of a document are looked up.
LISTS = 3
#: Proximity: so many of an item's rarest terms within so many words.
NEAR_TERMS, NEAR_WORDS = 4, 20
#: What names a document in the index: ids may repeat with other texts.
DOC = ["doc_id", "row"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def places(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, size, place, term) of every word of the items that have words; item: a key of id and text."""
    own = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0).dropDuplicates(["item"])
    return own.select("item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))


def term_counts(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(term, n): corpus frequency of every test term, over all documents; 0 where it never comes."""
    counted = docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return at.select("term").distinct().join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def windows(at: DataFrame, counts: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(item, start, need, and place0, term0, … of its `lists` rarest places) of each window whose words all come in the corpus."""
    last = F.greatest(F.lit(0), F.least(F.col("place"), F.col("size") - window))
    spread = at.join(counts, "term").withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - window + 1), last)))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "place", "term"))), 1, lists)
    own = spread.groupBy("item", "size", "start").agg(rarest.alias("rarest")).filter(F.get("rarest", F.lit(0))["n"] > 0)
    part = lambda i: [F.get("rarest", F.lit(i))["place"].alias(f"place{i}"), F.get("rarest", F.lit(i))["term"].alias(f"term{i}")]
    return own.select("item", "start", F.least("size", F.lit(window)).alias("need"), *[c for i in range(lists) for c in part(i)])


def near_terms(at: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS) -> DataFrame:
    """(item, item_id, term, rank, need): each item's rarest distinct terms; need: how many it has."""
    distinct = at.select("item", "item_id", "term").distinct().join(counts, "term")
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))).filter(F.col("rank") <= terms)
    return ranked.select("item", "item_id", "term", "rank", F.count("*").over(Window.partitionBy("item")).alias("need"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, pos, term) of every word, or of those in terms (term)."""
    every = docs.select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return every if terms is None else every.join(small(terms), "term").select(*DOC, "pos", "term")


class Index:
    """Test-side tables and the stored postings of one corpus against one benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = NEAR_TERMS):
        """near: how many of an item's rarest terms a proximity query takes; None: no such queries."""
        self.docs, self.window = keyed(docs), window
        self.at = materialize(places(benchmark), "test-places")
        counts = materialize(term_counts(docs, self.at), "test-terms")
        self.windows = materialize(windows(self.at, counts, window), "test-windows")
        terms = [self.windows.select(F.col(f"term{i}").alias("term")) for i in range(LISTS)]
        if near is not None:
            self.near = materialize(near_terms(self.at, counts, near), "near-terms")
            terms.append(self.near.select("term"))
        every = terms[0]
        for t in terms[1:]:
            every = every.union(t)
        wanted = materialize(every.filter("term is not null").distinct(), "index-terms")
        self.postings = materialize(postings(self.docs, wanted), "postings")

    def candidates(self) -> DataFrame:
        """(item, start, need, doc_id, row, diagonal): windows all of whose rarest terms lie on one diagonal of a document."""
        first = self.postings.join(small(self.windows), F.col("term") == F.col("term0")).withColumn("diagonal", F.col("pos") - F.col("place0"))
        found = first.filter(F.col("diagonal") + F.col("start") >= 0).drop("pos", "term", "place0", "term0")
        for i in range(1, LISTS):
            place, term = f"place{i}", f"term{i}"
            listed = F.col(f"w.{term}").isNotNull()
            here = _same_document("w", "p") & (F.col("w.diagonal") + F.col(f"w.{place}") == F.col("p.pos")) & (F.col(f"w.{term}") == F.col("p.term"))
            both = found.filter(F.col(term).isNotNull()).alias("w").join(self.postings.alias("p"), here, "left_semi")
            found = both.unionByName(found.alias("w").filter(~listed)).drop(place, term)
        return found

    def phrase_matches(self) -> DataFrame:
        """(doc_id, row, item_id, first, last): runs of document words, each made of whole windows of the item."""
        found = materialize(self.candidates(), "candidates")
        diagonal = ["item", *DOC, "diagonal"]
        # windows that overlap on a diagonal are one stretch of places
        so_far = Window.partitionBy(*diagonal).orderBy("start")
        apart = found.dropDuplicates([*diagonal, "start"]).withColumn("fresh", F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("need")).over(so_far), F.lit(True)).cast("int"))
        stretch = apart.withColumn("stretch", F.sum("fresh").over(so_far)).groupBy(*diagonal, "stretch").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("need") - 1).alias("z"), F.max("need").alias("need"))
        asked = stretch.select(*diagonal, "need", F.explode(F.sequence("a", "z")).alias("place")).withColumn("pos", F.col("diagonal") + F.col("place"))
        asked = asked.join(small(self.at.select("item", "item_id", "place", "term")), ["item", "place"])
        named = materialize(found.select(*DOC).distinct(), "candidate-documents")
        texts = self.docs.alias("d").join(small(named).alias("n"), _same_document("d", "n"), "left_semi")
        full = postings(texts)
        here = _same_document("w", "p") & (F.col("w.pos") == F.col("p.pos")) & (F.col("w.term") == F.col("p.term"))
        agree = asked.alias("w").join(full.alias("p"), here, "left_semi")
        order = Window.partitionBy(*diagonal).orderBy("place")
        run = agree.withColumn("run", F.col("place") - F.row_number().over(order)).groupBy(*diagonal, "item_id", "need", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        return run.filter(F.col("last") - F.col("first") + 1 >= F.col("need")).select(*DOC, "item_id", "first", "last")

    def proximity_matches(self, within: int = NEAR_WORDS) -> DataFrame:
        """(doc_id, row, item_id, first, last): places where an item's rarest terms all come within `within` words."""
        hits = self.postings.join(small(self.near), "term")
        behind = Window.partitionBy(*DOC, "item").orderBy("pos").rangeBetween(-within + 1, 0)
        seen = hits.select(*DOC, "item_id", F.col("pos").alias("last"), "need", F.size(F.collect_set("rank").over(behind)).alias("got"), F.min("pos").over(behind).alias("first"))
        return seen.filter(F.col("got") >= F.col("need")).select(*DOC, "item_id", "first", "last")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, first, last): see Index.phrase_matches."""
    return Index(docs, benchmark, window, None).phrase_matches().drop("row")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, within: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, item_id, first, last): see Index.proximity_matches. Items with fewer distinct terms need all they have."""
    return Index(docs, benchmark, near=terms).proximity_matches(within).drop("row")


def hit_counts(matches: DataFrame) -> DataFrame:
    """(doc_id, n_hit, n_items, items_sha256) of documents with matches; n_hit is the length of the union of runs."""
    so_far = Window.partitionBy("doc_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(so_far), F.lit(-1))))
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    return matches.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").cast("long").alias("n_hit"), F.countDistinct("item_id").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match) of every document."""
    index = Index(docs, benchmark)
    hits = hit_counts(materialize(index.phrase_matches(), "matches"))
    near = index.proximity_matches().groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_near"))
    both = materialize(hits.alias("h").join(near.alias("n"), F.col("h.doc_id").eqNullSafe(F.col("n.doc_id")), "full").select(F.coalesce("h.doc_id", "n.doc_id").alias("hit_id"), "n_hit", "n_items", "items_sha256", "n_near"), "hits")
    counted = docs.select("doc_id", F.coalesce(F.size(F.array_remove(F.split("text", RAW_SEPARATORS), "")), F.lit(0)).cast("long").alias("n_words"))
    out = counted.join(small(both), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), zero("n_near"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, without a whole window of any item."""
    hit = materialize(phrase_matches(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.alias("kept").join(small(hit).alias("hit"), F.col("kept.doc_id").eqNullSafe(F.col("hit.doc_id")), "left_anti")
