"""Removal of repeated passages by sorting suffixes at sampled positions.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller doc_id, or before in the
same document). Sorting every suffix of the corpus would move LENGTH bytes for each byte of text. Suffixes are
therefore sampled by content: every window of LENGTH bytes has an anchor, the GRAM bytes in it with the least hash (the
first of equal ones), so equal windows have equal anchors at equal places, and neighbouring windows mostly share
theirs. A run is the windows in a row that share one anchor; it stands for all their suffixes.

1. Runs are sorted as suffixes: by the token at their anchor (64 bits of its GRAM bytes), then by the token of their
   whole bytes, then by place. Sampled splitters range-partition them by all of that, so one passage in a third of all
   documents spreads over many buckets. Each bucket is sorted by itself (Spark's sort, which spills) and read as a
   stream: of equal neighbours all but the first go. Equal suffixes on both sides of a boundary are found by comparing
   the last suffix of a bucket with the first of the next.
2. Anchors with several different runs, as at the ends of a repeated passage, need their windows compared. The bytes of
   those runs are range-partitioned by the anchor's leading bytes with sampled splitters; in each bucket the windows'
   suffixes are sorted by multikey quicksort over tokens of 8 bytes, and of equal ones all but the first go.
3. Such an anchor with over HOT_RUNS runs, more than one task should hold, is split: its windows go one by one through
   the sort of step 1, each with two tokens of 64 bits of its own bytes. The number counts runs of one anchor, so it
   doesn't depend on the size of the corpus.
4. Removed spans are joined to their documents.

Whether an anchor belongs to step 2 or 3 is told to the tasks by bitmaps of fixed size; a run that they name by chance
is compared in vain and changes nothing. Results are exact but for collisions of 114 bits (runs) and 128 (windows).

Defined results: null text has no bytes; texts under LENGTH bytes stay whole; rows that share a doc_id count as one
place, so neither is earlier; rows with null doc_id stay whole and don't count; repeated rows under another id go
whole; an empty table gives no rows; other columns are not read. Texts are used whole, in pieces of AT_ONCE bytes
that overlap by LENGTH - 1, so work space doesn't grow with a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import _BASE, _power_tables, mix
from .shared import bitmap, give_back, in_bitmap, materialize, text_batches

LENGTH, GRAM = 100, 24
AT_ONCE = 1 << 19
#: Runs of one anchor up to which a task holds their bytes (some 30 MB).
HOT_RUNS = 200_000
#: Windows sorted at once in a bucket.
WINDOWS_AT_ONCE = 1 << 18

_rng = np.random.default_rng(20240301)
_BYTES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
#: Places of the tokens in the order that they are compared: equal anchors lie inside, so both ends come first.
_DEPTHS = np.array(sorted({min(i * 8, LENGTH - 8) for i in range(-(-LENGTH // 8))}, key=lambda p: min(p, LENGTH - 8 - p)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` values in a row the place of the least, the first of equal ones (van Herk's blocks)."""
    n, windows = len(values), len(values) - width + 1
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    place = np.arange(padded.size).reshape(padded.shape)
    ahead = np.minimum.accumulate(padded, axis=1)
    fresh = np.concatenate([np.ones((len(padded), 1), dtype=bool), ahead[:, 1:] < ahead[:, :-1]], axis=1)
    ahead_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    turned = padded[:, ::-1]
    behind = np.minimum.accumulate(turned, axis=1)
    behind_at = np.minimum.accumulate(np.where(turned == behind, place[:, ::-1], padded.size), axis=1)[:, ::-1].ravel()
    ahead, behind = ahead.ravel(), behind[:, ::-1].ravel()
    z = slice(width - 1, width - 1 + windows)
    return np.where(behind[:windows] <= ahead[z], behind_at[:windows], ahead_at[z])


class Slice:
    """The runs of pieces of documents, side by side: doc (its index), start, n (windows), off (place of the anchor), anchor."""

    def __init__(self, raw: list[bytes], base: list[int] | None = None):
        """base: where each piece starts in its document."""
        self.raw = raw
        self.edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(self.data)
        self.doc = self.start = self.n = self.off = np.zeros(0, dtype=np.int64)
        self.anchor = np.zeros(0, dtype=np.uint64)
        if n < LENGTH:
            return
        self.power, self.inverse = _power_tables(n + 1)
        self._sums: dict[int, np.ndarray] = {}
        sums = self.sums(0)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        windows = n - LENGTH + 1
        at = _least(grams, LENGTH - GRAM + 1)
        sizes = np.diff(self.edges)
        left = np.repeat(self.edges[1:], sizes)[:windows] - np.arange(windows)
        valid = left >= LENGTH
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (left[1:] > left[:-1])
        first = np.flatnonzero(fresh)
        if not len(first):
            return
        stop = np.flatnonzero(valid & np.concatenate([fresh[1:] | ~valid[1:], [True]])) + 1
        place = at[first]
        self.doc = np.searchsorted(self.edges, first, side="right") - 1
        self.first, self.n, self.off = first, stop - first, place - first
        self.start = first - self.edges[self.doc] + (np.array(base, dtype=np.int64)[self.doc] if base else 0)
        self.anchor = grams[place]

    def sums(self, table: int) -> np.ndarray:
        """Running sums of the bytes' values at their powers, made when they are first asked for."""
        if table not in self._sums:
            n = len(self.data)
            self._sums[table] = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTES[table][self.data] * self.power[:n], dtype=np.uint64, out=self._sums[table][1:])
        return self._sums[table]

    def hash(self, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = self.sums(table)
        return mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * np.uint64(_BASE))

    def digest(self, at=slice(None)) -> np.ndarray:
        """Digests of whole runs, with the place of their anchor."""
        first, n = self.first[at], self.n[at]
        return mix(self.hash(1, first, first + n - 1 + LENGTH) + (n * 128 + self.off[at]).astype(np.uint64))


def _slices(batches):
    """(doc ids, Slice) of texts in pieces; work space is that of some AT_ONCE bytes, however long a text is."""
    for ids, texts in text_batches(batches, AT_ONCE):
        held, size = [], 0
        for i, t in zip(ids, texts):
            data = (t or "").encode() if i is not None else b""
            for a in range(0, max(0, len(data) - LENGTH + 1), AT_ONCE):
                held.append((i, a, data[a : a + AT_ONCE + LENGTH - 1]))
                size += len(held[-1][2])
                if size > AT_ONCE:
                    yield np.array([x[0] for x in held], dtype=np.int64), Slice([x[2] for x in held], [x[1] for x in held])
                    held, size = [], 0
        if held:
            yield np.array([x[0] for x in held], dtype=np.int64), Slice([x[2] for x in held], [x[1] for x in held])


def _later(order: np.ndarray, same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In `order` (by key, doc, start), where same[i] says that i has i-1's key: (whether first of its key, whether after the first)."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, s = doc[order], start[order]
    return ~same, (d > d[head]) | (s > s[head])


_RUNS = "kind int, key long, digest long, doc long, start int"
_RUN_NAMES = ["kind", "key", "digest", "doc", "start"]
#: Windows that go (key: their number), suffixes to be sorted, anchors with different runs, anchors with over HOT_RUNS runs.
GONE, SUFFIX, SEVERAL, HOT, EDGE = 0, 1, 2, 3, 4


def _rows(kind, key, digest, doc, start):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32))], _RUN_NAMES)


def _gone(number, doc, start):
    return _rows(GONE, number.astype(np.uint64), np.zeros(len(number), np.uint64), doc, start)


def _first_of_slice(key, digest, doc, start):
    """(rows that stay, rows that go) of one slice's suffixes."""
    order = np.lexsort((start, doc, digest, key))
    k, d = key[order], digest[order]
    first, later = _later(order, np.concatenate([[False], (k[1:] == k[:-1]) & (d[1:] == d[:-1])]), doc, start)
    return order[first | ~later], order[later]


def runs(docs: DataFrame) -> DataFrame:
    """Runs as suffixes (SUFFIX; digest: 50 bits, then n and off in 7 bits each), and windows that their slice already shows to go (GONE)."""

    def run(batches):
        for ids, s in _slices(batches):
            if not len(s.anchor):
                continue
            doc = ids[s.doc]
            digest = s.digest() & ~np.uint64((1 << 14) - 1) | (s.n * 128 + s.off).astype(np.uint64)
            keep, gone = _first_of_slice(s.anchor, digest, doc, s.start)
            if len(gone):
                yield _gone(s.n[gone], doc[gone], s.start[gone])
            yield _rows(SUFFIX, s.anchor[keep], digest[keep], doc[keep], s.start[keep])

    return docs.select("doc_id", "text").mapInArrow(run, _RUNS)


_EDGES = f"{_RUNS}, part int, first struct<key:long,digest:long,doc:long,start:int,n:long>, last struct<key:long,digest:long,doc:long,start:int,n:long>"
_EDGE = pa.struct([("key", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int64())])


def _read_sorted(batches, windows: bool, hot: int):
    """One bucket in order, as a stream: what goes, anchors with different runs, and the bucket's edges.

    The carried state is the last key (k, its runs so far n, whether they differ) and the first place of the last digest.
    """
    none = lambda m: [pa.nulls(m, pa.int32()), pa.nulls(m, _EDGE), pa.nulls(m, _EDGE)]
    plain = lambda b: pa.RecordBatch.from_arrays([*b.columns, *none(b.num_rows)], [*_RUN_NAMES, "part", "first", "last"])
    keys = lambda kind, k: plain(_rows(kind, k, np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)))
    first = last = None  # key, digest, doc, start, runs of the key; of last also whether they differ
    for b in batches:
        kind = b.column(0).to_numpy(zero_copy_only=False)
        if (kind == GONE).any():
            yield plain(b.filter(pa.array(kind == GONE)))
            b = b.filter(pa.array(kind != GONE))
        if not b.num_rows:
            continue
        k, d, doc, start = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        carried = last is not None
        if carried:
            k, d, doc, start = (np.concatenate([[x], y]) for x, y in zip(last, (k, d, doc, start)))
        same_key = np.concatenate([[False], k[1:] == k[:-1]])
        same = same_key & np.concatenate([[False], d[1:] == d[:-1]])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
        later = (doc > doc[head]) | (start > start[head])
        if later.any():
            yield plain(_gone(np.ones(int(later.sum()), np.int64) if windows else d[later] >> 7 & 127, doc[later], start[later]))
        edge = np.flatnonzero(~same_key)
        sizes = np.diff(np.append(edge, len(k)))
        differ = np.add.reduceat((same_key & ~same).astype(np.int64), edge) > 0
        if carried:
            sizes[0] += last[4] - 1
            differ[0] |= last[5]
        if not windows:
            if differ.any():
                yield keys(SEVERAL, k[edge[differ]])
            if len(edge) > 1 and (sizes[:-1] > hot).any():
                yield keys(HOT, k[edge[:-1][sizes[:-1] > hot]])
        if first is None:
            first = [int(k[0]), int(d[0]), int(doc[0]), int(start[0]), 0]
        if first[0] == k[0]:
            first[4] = int(sizes[0])
        h = head[-1]
        last = [int(k[-1]), int(d[-1]), int(doc[h]), int(start[h]), int(sizes[-1]), bool(differ[-1])]
    if first is not None:
        if not windows and last[4] > hot:
            yield keys(HOT, np.array([last[0]], dtype=np.int64))
        ends = [pa.array([dict(zip(("key", "digest", "doc", "start", "n"), x))], _EDGE) for x in (first[:5], last[:5])]
        at = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([EDGE], pa.int32()), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())], at, *ends], [*_RUN_NAMES, "part", "first", "last"])


def across(edges: list, windows: bool, hot: int) -> list[tuple]:
    """What the boundaries of buckets show, as rows of _RUNS: the last suffix of a bucket against the first of the next.

    edges: a row a bucket (part, first, last), in order. Of equal suffixes on both sides the second bucket's first goes,
    unless it is at the same place; runs of an anchor on both sides are counted together.
    """
    out, before = [], None
    for _, first, last in edges:
        whole = first.key == last.key
        n, place = last.n, (last.doc, last.start)
        if before is not None and before["key"] == first.key:
            if before["digest"] == first.digest:
                if before["place"] < (first.doc, first.start):
                    out.append((GONE, 1 if windows else first.digest >> 7 & 127, 0, first.doc, first.start))
                if whole and last.digest == first.digest:
                    place = before["place"]
            elif not windows:
                out.append((SEVERAL, first.key, 0, 0, 0))
            if not windows and before["n"] + first.n > hot:
                out.append((HOT, first.key, 0, 0, 0))
            if whole:
                n += before["n"]
        before = {"key": last.key, "digest": last.digest, "place": place, "n": n}
    return out


def ordered(rows: DataFrame, windows: bool = False, hot: int | None = None) -> DataFrame:
    """Suffixes sorted: those that go (GONE), and of runs the anchors that have different ones (SEVERAL) or too many (HOT)."""
    hot = HOT_RUNS if hot is None else hot
    order = ["kind", "key", "digest", "doc", "start"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(lambda b: _read_sorted(b, windows, hot), _EDGES), "ordered")
    edges = found.filter(F.col("kind") == EDGE).select("part", "first", "last").orderBy("part").collect()  # two rows' keys a bucket
    more = found.sparkSession.createDataFrame(across(edges, windows, hot), _RUNS)
    return found.filter(F.col("kind") != EDGE).select(*_RUN_NAMES).unionByName(more)


_STRETCH = "kind int, lead long, anchor long, n int, off int, doc long, start int, bytes binary"
STRETCH, WINDOW, KNOWN = 0, 1, 2


def stretches(docs: DataFrame, several: bytes, hot: bytes) -> DataFrame:
    """Of the runs whose anchor has different ones: their bytes (STRETCH), or of hot anchors their windows.

    A WINDOW has its two tokens in lead and anchor. Of equal runs or windows in a slice the first is given; the others
    are known to go (KNOWN, n: windows).
    """
    sent = docs.sparkSession.sparkContext.broadcast((several, hot))
    names = [c.split()[0] for c in _STRETCH.split(", ")]

    def rows(kind, lead, anchor, n, off, doc, start, data=None):
        size = len(anchor)
        many = lambda x, t: pa.array(np.full(size, x, dtype=t) if np.isscalar(x) else x.astype(t))
        return pa.RecordBatch.from_arrays([many(kind, np.int32), pa.array(lead, pa.int64()), pa.array(anchor.view(np.int64)), many(n, np.int32), many(off, np.int32), pa.array(doc), many(start, np.int32), pa.array(data, pa.binary()) if data is not None else pa.nulls(size, pa.binary())], names)

    def run(batches):
        bits, common = (np.frombuffer(x, dtype=np.uint8) for x in sent.value)
        any_hot = common.any()
        for ids, s in _slices(batches):
            pick = np.flatnonzero(in_bitmap(bits, s.anchor)) if len(s.anchor) else []
            if not len(pick):
                continue
            is_hot = in_bitmap(common, s.anchor[pick]) if any_hot else np.zeros(len(pick), dtype=bool)
            if is_hot.any():
                h = pick[is_hot]
                which = np.repeat(h, s.n[h])
                step = np.arange(len(which)) - np.repeat(np.cumsum(s.n[h]) - s.n[h], s.n[h])
                at = s.first[which] + step
                k1, k2, doc, start = s.hash(0, at, at + LENGTH), s.hash(1, at, at + LENGTH), ids[s.doc[which]], s.start[which] + step
                keep, gone = _first_of_slice(k1, k2, doc, start)
                yield rows(WINDOW, k1[keep].view(np.int64), k2[keep], 1, 0, doc[keep], start[keep])
                if len(gone):
                    yield rows(KNOWN, np.zeros(len(gone), np.int64), k2[gone], 1, 0, doc[gone], start[gone])
            pick = pick[~is_hot]
            if not len(pick):
                continue
            doc, digest = ids[s.doc[pick]], s.digest(pick)
            keep = pick[_first_of_slice(s.anchor[pick], digest, doc, s.start[pick])[0]]
            whole = s.data.tobytes()
            begin = s.first[keep]
            end = begin + s.n[keep] - 1 + LENGTH
            lead = [int.from_bytes(whole[p : p + 8], "big", signed=True) for p in (begin + s.off[keep]).tolist()]
            yield rows(STRETCH, lead, s.anchor[keep], s.n[keep], s.off[keep], ids[s.doc[keep]], s.start[keep], [whole[p:q] for p, q in zip(begin.tolist(), end.tolist())])

    return docs.select("doc_id", "text").mapInArrow(run, _STRETCH)


def multikey_quicksort(token, group: np.ndarray, depths: int) -> np.ndarray:
    """Labels that are equal where, within a group (equal, adjacent numbers), all `depths` tokens are equal.

    token(rows, depth) gives tokens. All groups are parted at once: each by a pivot, its middle row's token, into less,
    equal and greater; equal rows go one token deeper, and a part of one row is done.
    """
    n = len(group)
    label, rows, part = np.arange(n), np.arange(n), group
    depth = np.zeros(n, dtype=np.int64)
    while len(rows):
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        size = np.diff(edge)
        lone = np.repeat(size == 1, size)
        full = np.repeat(depth[edge[:-1]] >= depths, size)
        if full.any():
            label[rows[full & ~lone]] = np.repeat(rows[edge[:-1]], size)[full & ~lone]
        stay = ~(lone | full)
        if not stay.all():
            rows, part, depth = rows[stay], part[stay], depth[stay]
            continue
        mine = token(rows, depth)
        pivot = np.repeat(mine[edge[:-1] + size // 2], size)
        side = (mine > pivot).astype(np.int64) - (mine < pivot) + 1
        to = np.repeat(np.arange(len(size)), size) * 3 + side
        order = np.argsort(to, kind="stable")
        rows, part, depth = rows[order], to[order], (depth + (side == 1))[order]
    return label


def compared(found: DataFrame) -> DataFrame:
    """The windows of stretches() that equal an earlier one (GONE)."""

    def work(parts):
        lead, anchor, n, off, doc, start, data = (np.concatenate([p[i] for p in parts]) if i < 6 else sum((p[6] for p in parts), []) for i in range(7))
        joined = np.frombuffer(b"".join(data) + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
        words = np.zeros(len(joined) - 7, dtype=np.uint64)
        for i in range(8):
            words = words << np.uint64(8) | joined[i : i + len(words)]
        base = np.concatenate([[0], np.cumsum([len(x) for x in data])[:-1]])
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        place = off[which] - step
        order = np.lexsort((place, anchor[which]))
        which, step, place = which[order], step[order], place[order]
        at = base[which] + step
        a = anchor[which]
        group = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (place[1:] != place[:-1])]))
        label = multikey_quicksort(lambda rows, depth: words[at[rows] + _DEPTHS[depth]], group, len(_DEPTHS))
        d, s = doc[which], start[which] + step
        o = np.lexsort((s, d, label))
        _, later = _later(o, np.concatenate([[False], label[o][1:] == label[o][:-1]]), d, s)
        gone = o[later]
        gone = gone[np.lexsort((s[gone], d[gone]))]
        gd, gs = d[gone], s[gone]
        head = np.flatnonzero(np.concatenate([[True], (gd[1:] != gd[:-1]) | (gs[1:] > gs[:-1] + 1)])) if len(gone) else np.zeros(0, dtype=np.int64)
        if len(head):
            last = np.concatenate([head[1:], [len(gone)]]) - 1
            yield _gone(gs[last] - gs[head] + 1, gd[head], gs[head])

    def run(batches):
        """Rows come sorted by anchor; they are worked in pieces that end between anchors."""
        held, size = [], 0
        for b in batches:
            c = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(c[1])) + 1, [b.num_rows]])
            data = b.column(6).to_pylist()
            windows = np.concatenate([[0], np.cumsum(c[2])])
            i = 0
            while i < len(cuts) - 1:
                a = cuts[i]
                if held and size > WINDOWS_AT_ONCE and held[-1][1][-1] != c[1][a]:
                    yield from work(held)
                    held, size = [], 0
                j = max(i + 1, int(np.searchsorted(windows[cuts], windows[a] + WINDOWS_AT_ONCE, side="right")) - 1)
                z = cuts[j]
                held.append((*(x[a:z] for x in c), data[a:z]))
                size += int(windows[z] - windows[a])
                i = j
        if held:
            yield from work(held)
        give_back()

    return found.repartitionByRange("lead", "anchor").sortWithinPartitions("anchor").mapInArrow(run, _RUNS)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, way): byte spans [first, last) that go; they may overlap.

    way: 'runs' (equal runs, by the sort of step 1), 'windows' (compared by multikey quicksort) or 'hot' (step 3).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sorted_runs = ordered(runs(docs))
    of = lambda kind: sorted_runs.filter(F.col("kind") == kind).select("key")
    # a table, since range partitioning reads its input twice
    found = materialize(stretches(docs, bitmap(of(SEVERAL)), bitmap(of(HOT))), "stretches")
    more = compared(found.filter(F.col("kind") == STRETCH).drop("kind"))
    known = found.filter(F.col("kind") == KNOWN).select(F.lit(GONE).alias("kind"), F.col("n").cast("long").alias("key"), F.lit(0).cast("long").alias("digest"), "doc", "start")
    tokens = found.filter(F.col("kind") == WINDOW).select(F.lit(SUFFIX).alias("kind"), F.col("lead").alias("key"), F.col("anchor").alias("digest"), "doc", "start")
    ways = [("runs", sorted_runs), ("windows", more)]
    if not tokens.isEmpty():
        ways += [("hot", known.unionByName(ordered(tokens, windows=True)))]
    out = None
    for way, rows in ways:
        own = rows.filter(F.col("kind") == GONE).select(F.col("doc").alias("doc_id"), F.col("start").alias("first"), (F.col("start") + F.col("key").cast("int") - 1 + LENGTH).alias("last"), F.lit(way).alias("way"))
        out = own if out is None else out.unionByName(own)
    return out


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 of every row of docs."""
    own = spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("gone"))

    def run(batches):
        for b in batches:
            out = []
            for key, text, gone in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode()
                cut = merged([(g["first"], g["last"]) for g in gone or []])
                kept = b"".join(data[a:z] for (_, a), (z, _) in zip([(0, 0), *cut], [*cut, (len(data), 0)]))
                out.append((key, len(data), len(data) - len(kept), len(cut), kept, hashlib.sha256(kept).hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id", "left")
    return rows.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
