"""Byte-level BPE encoding and decoding.

Pieces (the matches of the tokenizer's pattern) are merged in length-bucketed, padded numpy matrices: in every
round each row merges its leftmost pair of least rank, the pair's rank coming from a hash table of (left id, right
id), and the rows are compacted by one. Rows leave when no pair is left. A piece longer than LONG_PIECE bytes takes
the same merges in the same order from a heap over a linked list, since rounds over a padded row would cost the
square of its length.

Defined results: null text counts as empty (no tokens, no bytes); every other text is encoded whole; lone matches
of any length are handled; rows are independent, so repeated rows give repeated results; columns of the input other
than the two that are named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

#: Bytes of a piece up to which it is merged in matrices.
LONG_PIECE = 128
#: Pieces kept per worker between batches; the cache is emptied when it is full.
CACHE_PIECES = 150_000
#: Code points of a text from which its matches are worked in blocks, and matches of a block.
LONG_TEXT, BLOCK_PIECES = 1 << 20, 100_000
NONE = np.iinfo(np.uint32).max


class Ranks:
    """A tiktoken rank file with its pair table."""

    def __init__(self, lines: list[bytes]):
        self.by_token = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.by_id = {r: t for t, r in self.by_token.items()}
        self.byte_ids = np.array([self.by_token[bytes([b])] for b in range(256)], dtype=np.uint32)
        pairs = {}
        for token, rank in self.by_token.items():
            for i in range(1, len(token)):
                left, right = self.by_token.get(token[:i]), self.by_token.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self._build(np.fromiter(pairs, dtype=np.uint64), np.fromiter(pairs.values(), dtype=np.uint32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: every round places the keys that find their slot free, the others step on."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, np.iinfo(np.uint64).max), np.full(size, NONE)
        slot, left, self.probes = self._slot(keys).astype(np.int64), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.ranks[slot[left]] == NONE]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.ranks[slot[won]] = ranks[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) % size

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, NONE where they don't merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys).astype(np.int64)
        out = np.full(keys.shape, NONE)
        for _ in range(self.probes):
            hit = self.keys[slot] == keys
            out[hit] = self.ranks[slot[hit]]
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((n, width), NONE)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rows, out = np.arange(n), [None] * n
        ranks = np.full((n, max(1, width - 1)), NONE)
        if width > 1:
            real = ids[:, 1:] != NONE
            ranks[real] = self.lookup(ids[:, :-1][real], ids[:, 1:][real])
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                for r in np.flatnonzero(over):
                    out[rows[r]] = ids[r, : lengths[r]].copy()
                keep = ~over
                rows, ids, ranks, lengths, at, best = rows[keep], ids[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            source = np.arange(ids.shape[1] - 1)[None, :]
            source = source + (source > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)  # compaction: the right half of the pair goes
            ids[k, at] = best
            lengths = lengths - 1
            width = ids.shape[1]
            if width == 1:
                ranks = np.full((len(rows), 1), NONE)
                continue
            source = np.arange(width - 1)[None, :]
            ranks = np.take_along_axis(ranks, source + (source >= at[:, None]), axis=1)
            for column in (at - 1, at):
                ok = (column >= 0) & (column + 1 < lengths)
                r, c = k[ok], column[ok]
                ranks[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
            tail = at >= lengths - 1
            inside = tail & (at < width - 1)
            ranks[k[inside], at[inside]] = NONE
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges from a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = j2 = after[j]
            if j2 < n:
                before[j2] = i
                if (r := pairs.get(rank << 32 | ids[j2])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[j2]))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], dtype=np.uint32)

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct pieces; length buckets keep the padding small."""
        out, buckets = {}, {}
        for p in pieces:
            if (whole := self.by_token.get(p)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                out[p] = self.merge_long(p).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(p)
        for bucket in buckets.values():
            for i in range(0, len(bucket), 8192):
                part = bucket[i : i + 8192]
                for p, ids in zip(part, self.merge_matrix(part)):
                    out[p] = ids.astype("<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def _ranks(lines: bytes) -> Ranks:
    return Ranks(lines.splitlines())


class Codec:
    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks, self.pattern, self.cache = _ranks(rank_lines), regex.compile(pattern), {}
        self.token = [self.ranks.by_id.get(i, b"") for i in range(max(self.ranks.by_id) + 1)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a very long text goes in blocks of its matches."""
        if any(len(t) > LONG_TEXT for t in texts):
            return [self._encode_long(t) if len(t) > LONG_TEXT else self.encode_batch([t])[0] for t in texts]
        return self._encode([self.pattern.findall(t) for t in texts])

    def _encode_long(self, text: str) -> bytes:
        found, out = self.pattern.finditer(text), []
        while block := [m[0] for m in islice(found, BLOCK_PIECES)]:
            out += self._encode([block])
        return b"".join(out)

    def _encode(self, split: list[list[str]]) -> list[bytes]:
        fresh = set().union(*split) - self.cache.keys() if split else set()
        if len(self.cache) + len(fresh) > CACHE_PIECES:
            self.cache.clear()
            fresh = set().union(*split)
        # two lone surrogates can't occur: Arrow strings are valid UTF-8
        raw = {p: p.encode() for p in fresh}
        ids = self.ranks.encode_pieces(list(raw.values()))
        self.cache.update((p, ids[b]) for p, b in raw.items())
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, rank_lines: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary): the token ids of every text as little-endian unsigned 32-bit integers."""

    def run(batches):
        codec = Codec(rank_lines, pattern)
        for ids, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codec.encode_batch([t or "" for t in texts]), pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_lines: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary): the bytes that the ids stand for; null ids give no bytes."""

    def run(batches):
        codec = Codec(rank_lines, ".")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_lines: bytes, pattern: str) -> DataFrame:
    """Encode and decode in one pass; the digests per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        codec = Codec(rank_lines, pattern)
        for ids, texts in text_batches(batches):
            coded = codec.encode_batch([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(codec.decode(c)).hexdigest() for c in coded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
