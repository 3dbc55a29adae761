"""Near-duplicate detection with bottom-k MinHash sketches.

One hash function maps each shingle of SHINGLE words to 64 bits. Documents with equal sets form a class with one
representative. A class's sketch retains the RETAINED least hashes of its set, which is all of a shorter one. Of the
least values of two sets' union those in both sets are in both sketches, so a pair over the threshold has a least
overlap of its sketches: exactly known where sets are whole, else ERRORS standard deviations below the mean (see
least_overlap). The longer the sketch, the nearer that bound lies to the mean, and the fewer values must be listed.
Inverted lists of the retained values generate the overlaps: a class is listed under as many of its retained values as
a pair with the least overlap must share one of, rare ones first. Rarity comes from a histogram of fixed size over all
values, so passages and templates that many documents share come last. Two classes of a list are a candidate pair when
their sizes and the value's places leave room for the least overlap. The union of the K least values of both then
estimates a pair's similarity; a pair that comes through is verified by exact Jaccard similarity of the full sets, from the
sketches alone where they are whole sets.

A list of n classes isn't expanded to n^2 pairs: first every class meets its list's leader (the class with the least
place, such as the original of many copies), which ties large groups into components; then, in lists that hold more
than one component, pairs between different components are tried. Pairs inside a component can't change the result.
Lists of frequent values are dealt in SALTS parts with a leader each, and the leaders meet theirs.

A pair at the very threshold is lost by the estimate with a chance (binomial tail of K values) of 4.3e-9 at 85 percent
and 9.8e-10 at 80 (ERRORS = 6.5), by the lists with one of 1e-10 (RETAINED values), in model, and never where sets
are whole; verification stays exact. Texts are read again where sets are needed, of the documents that a bitmap of fixed size
names, so sets of documents without candidates are never moved.

Defined results: null or wordless text has an empty set and is linked with nothing; fewer words than SHINGLE make
one shingle; rows that share a doc_id are one node; a null doc_id is linked with nothing, its component is null;
repeated rows fall into one class; an empty table gives no rows; other columns are not read. Texts are used whole; a
very long one in pieces of AT_ONCE bytes that overlap by SHINGLE - 1 words.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import bitmap, mapped_rows, materialize, text_batches

SHINGLE, RETAINED, K, ERRORS = 5, 1024, 128, 6.5
#: Links need 100 * intersection >= percent * union; a query's or stage's contract names its own, this is op1's.
PERCENT = 85
BUCKET_BITS, BUCKET_PAGE = 18, 4096
#: Values in a bucket of the histogram, beyond four times the mean, from which its lists are dealt in parts.
HOT_VALUES, SALTS = 200_000, 64
AT_ONCE = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_SPACE_BYTE, _WORD_BYTES = re.compile(rb"[ \t-\r]"), re.compile(rb"[^ \t-\r]+")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def _hashed(raw: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The shingle hashes and the word hashes of each text of raw, in order."""
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    power, inverse = _power_tables(len(data))
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    hashed = np.zeros(max(0, len(word) - SHINGLE + 1), dtype=np.uint64)
    for i in range(SHINGLE):
        hashed += word[i : i + len(hashed)] * _MUL[i]
    hashed = mix(hashed).view(np.int64)
    bounds = np.searchsorted(starts, edges).tolist()
    own = list(zip(bounds[:-1], bounds[1:]))
    return [hashed[a : max(a, b - SHINGLE + 1)] for a, b in own], [word[a:b] for a, b in own]


def _words_back(raw: bytes, at: int) -> int:
    """Where the SHINGLE - 1 words before place `at` begin."""
    look = 4096
    while True:
        low = max(0, at - look)
        starts = [m.start() for m in _WORD_BYTES.finditer(raw, low, at)]
        if low == 0 or len(starts) >= SHINGLE:  # the first may be cut
            return starts[1 - SHINGLE :][0] if starts else at
        look *= 8


def _pieces(raw: bytes) -> list[bytes]:
    """A long text in pieces that end between words and begin SHINGLE - 1 words back."""
    out, at, back = [], 0, 0
    while space := _SPACE_BYTE.search(raw, at + AT_ONCE):
        at = space.start()
        out.append(raw[back:at])
        back = _words_back(raw, at)
    return [*out, raw[back:]]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (signed 64 bits) of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    long = {i for i, r in enumerate(raw) if len(r) > 2 * AT_ONCE}
    sets, words = _hashed([b"" if i in long else r for i, r in enumerate(raw)])
    out = []
    for i, (found, word) in enumerate(zip(sets, words)):
        if i in long:
            parts = [_hashed([p]) for p in _pieces(raw[i])]
            found, word = np.unique(np.concatenate([np.unique(s[0]) for s, _ in parts])), parts[-1][1][0]
        if len(found):
            out.append(np.unique(found))
        elif len(word):
            few = (word * _MUL[: len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))
            out.append(mix(mix(np.array([few]))).view(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def least_overlap(n: int, percent: int, k: int | None = None) -> int:
    """How many of its k (RETAINED) least values a set of n values shares at least with those of any set over the threshold.

    A partner of a set of up to percent / 100 * k values has k at most, so both are whole and the number is exact.
    """
    t, k = percent / 100, k or RETAINED
    if 100 * n <= percent * k:
        return -(-percent * n // 100)
    return math.ceil(t * k - ERRORS * math.sqrt(k * t * (1 - t)))


def listed(n: int, percent: int) -> int:
    """Under how many of its retained values, rare ones first, a class is listed: a pair must share one of them."""
    return min(n, RETAINED) - least_overlap(n, percent) + 1


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


SET, COUNT = 0, 1


def digests(docs: DataFrame) -> DataFrame:
    """Of each row (kind SET): doc_id, n, and h1, h2, a 128-bit digest of its set; of each task (kind COUNT) its values by bucket."""
    names = ["kind", "doc_id", "n", "h1", "h2"]

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for ids, texts in text_batches(batches, AT_ONCE):
            sets = shingle_sets(texts)
            total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total)) if sets else 0
            unsigned = [s.view(np.uint64) for s in sets]
            h1 = [int(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) for u in unsigned]
            h2 = [int((mix(u + np.uint64(0x1234567)) * np.uint64(_BASE)).sum(dtype=np.uint64).view(np.int64)) for u in unsigned]
            yield pa.RecordBatch.from_arrays([pa.array([SET] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names)
        at = np.flatnonzero(total)
        none = np.zeros(len(at), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), COUNT, dtype=np.int32)), pa.array(at), pa.array(total[at]), pa.array(none), pa.array(none)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, h1 long, h2 long")


def value_counts(signed: DataFrame) -> np.ndarray:
    """How many values fall into each of 2^BUCKET_BITS buckets: a table of fixed size.

    The driver gets it as pages of bytes, as a row object for each bucket would cost it many times the table.
    """

    def pages(batches):
        found = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        at, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for p in np.unique(at // BUCKET_PAGE):
            page, own = np.zeros(BUCKET_PAGE, dtype=np.int64), at // BUCKET_PAGE == p
            page[at[own] % BUCKET_PAGE] = n[own]
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int64()), pa.array([page.tobytes()], pa.binary())], ["page", "counts"])

    sums = signed.filter(F.col("kind") == COUNT).groupBy("doc_id").agg(F.sum("n").alias("n"))
    out = np.zeros(((1 << BUCKET_BITS) // BUCKET_PAGE, BUCKET_PAGE), dtype=np.int64)
    for page, counts in sums.repartition(F.expr(f"doc_id div {BUCKET_PAGE}")).mapInArrow(pages, "page long, counts binary").collect():
        out[page] = np.frombuffer(counts, dtype=np.int64)
    return out.reshape(-1)


def postings(docs: DataFrame, named: bytes, counts: np.ndarray, percent: int) -> DataFrame:
    """(value, salt, id, n, place): each document that the bitmap names under the first of its retained values, by rarity."""
    sent = docs.sparkSession.sparkContext.broadcast((named, counts))
    hot = HOT_VALUES + 4 * int(counts.mean())

    def run(batches):
        bits, rarity = np.frombuffer(sent.value[0], dtype=np.uint8), sent.value[1]
        for ids, texts in text_batches(mapped_rows(batches, bits), AT_ONCE):
            parts = []
            for key, values in zip(ids, shingle_sets(texts)):
                n = len(values)
                if n:
                    sketch = values[:RETAINED]
                    rank = rarity[_bucket(sketch)]
                    order = np.lexsort((sketch, rank))[: listed(n, percent)]
                    salt = np.where(rank[order] > hot, 1 + key % SALTS, 0)
                    parts.append((sketch[order], salt, np.full(len(order), key), np.full(len(order), n), np.arange(len(order))))
            if parts:
                value, salt, key, n, place = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(salt.astype(np.int32)), pa.array(key), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], ["value", "salt", "id", "n", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, "value long, salt int, id long, n int, place int")


def sets(docs: DataFrame, named: bytes, most: int | None = None) -> DataFrame:
    """(id, n, values) of the documents that the bitmap names: the set's size and its `most` least values, or all."""
    sent = docs.sparkSession.sparkContext.broadcast(named)

    def run(batches):
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        for ids, texts in text_batches(mapped_rows(batches, bits), AT_ONCE):
            found = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([s[:most] for s in found], pa.list_(pa.int64()))], ["id", "n", "values"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n int, values array<long>")


def _feasible(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sizes and places of a shared value leave room for the threshold: the first shared place has the others behind it."""
    whole = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    least = F.when(100 * F.least(na, nb) <= percent * RETAINED, whole).otherwise(least_overlap(2 * RETAINED, percent))
    room = F.least(F.least(na, F.lit(RETAINED)) - pa_, F.least(nb, F.lit(RETAINED)) - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (room >= least)


def _ends(pairs: DataFrame) -> bytes:
    return bitmap(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))


def _with_sets(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs with n and values of both ends as na, va, nb, vb."""
    side = lambda x: found.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"v{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), a materialized table, those whose full sets reach the threshold."""
    both = _with_sets(pairs, sets(docs, _ends(pairs), K))
    both = both.withColumn("common", F.array_intersect("va", "vb")).withColumn("union", F.slice(F.array_sort(F.array_union("va", "vb")), 1, K))
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    exact = lambda inter: 100 * inter >= percent * (F.col("na") + F.col("nb") - inter)
    near = F.size(F.array_intersect("common", "union")) >= least_overlap(2 * K, percent, K)
    judged = materialize(both.filter(F.when(whole, exact(F.size("common"))).otherwise(near)).select("a", "b", whole.alias("sure")), "estimated")
    open_ = judged.filter("not sure").select("a", "b")
    checked = _with_sets(open_, sets(docs, _ends(open_))).filter(exact(F.size(F.array_intersect("va", "vb")))).select("a", "b")
    return judged.filter("sure").select("a", "b").union(checked).distinct()


def lists(listed: DataFrame) -> DataFrame:
    """Postings of values that more than one class retains, each with its list's leader (lead, lead_n, lead_place)."""
    dealt = listed.repartition("value", "salt")
    lead = dealt.groupBy("value", "salt").agg(F.min(F.struct("place", "id", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1 or salt > 0")
    return dealt.join(lead.select("value", "salt", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.place").alias("lead_place")), ["value", "salt"])


def _pairs(rows: DataFrame, x: tuple[str, str, str], y: tuple[str, str, str], percent: int) -> DataFrame:
    """Feasible pairs (a, b), a < b, of the columns x and y (id, n, place)."""
    ok = (F.col(x[0]) != F.col(y[0])) & _feasible(F.col(x[1]), F.col(x[2]), F.col(y[1]), F.col(y[2]), percent)
    return rows.filter(ok).select(F.least(x[0], y[0]).alias("a"), F.greatest(x[0], y[0]).alias("b")).distinct()


def link(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests of all rows, classes (h1, h2, id), components (id, component) of linked classes)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(digests(docs), "digests")
    rows = signed.filter(F.col("kind") == SET).drop("kind")
    classes = materialize(rows.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("id")), "classes")
    # a document that the bitmap names by chance is one more node with its class's set, and is linked with it
    shared = materialize(lists(postings(docs, bitmap(classes.select("id")), value_counts(signed), percent)), "lists")
    own, lead = ("id", "n", "place"), ("lead", "lead_n", "lead_place")
    salted = shared.filter("salt > 0").select("value", *lead).distinct()
    top = salted.groupBy("value").agg(F.min(F.struct("lead_place", "lead", "lead_n")).alias("top")).select("value", F.col("top.lead").alias("top"), F.col("top.lead_n").alias("top_n"), F.col("top.lead_place").alias("top_place"))
    tried = materialize(_pairs(shared, own, lead, percent).union(_pairs(salted.join(top, "value"), lead, ("top", "top_n", "top_place"), percent)).distinct(), "leader-pairs")
    links = materialize(verified(tried, docs, percent), "leader-links")
    tied = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    owned = shared.select("value", *own).join(tied, "id", "left").withColumn("component", F.coalesce("component", "id")).repartition("value")
    several = owned.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("value")
    split = materialize(owned.join(several, "value"), "split-lists")
    other = split.select("value", *[F.col(c).alias(f"{c}2") for c in (*own, "component")])
    feasible = (F.col("id") < F.col("id2")) & (F.col("component") != F.col("component2")) & _feasible(F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), percent)
    crossing = split.join(other, "value").filter(feasible).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    more = verified(materialize(crossing.join(tried, ["a", "b"], "left_anti"), "crossing-pairs"), docs, percent)
    return rows, classes, components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    rows, classes, tied = link(docs, percent)
    # rows without words have no class; each goes its own way in the join
    rows = rows.withColumn("h1", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.xxhash64("doc_id")))
    named = rows.join(classes, ["h1", "h2"], "left").withColumn("id", F.when(F.col("n") > 0, F.col("id")))
    out = named.join(tied, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns as they are, that are the least doc_id of their component."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    return docs.alias("kept").join(gone.alias("gone"), F.col("kept.doc_id") == F.col("gone.doc_id"), "left_anti")
