"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for every bit a binary classifier over hashed byte n-grams (orders ORDERS, in
DIM buckets) says how far a text speaks for one half of the languages against the other. A classifier's weights are
smoothed log odds of the n-gram's share in both halves, from counts over all training rows, so nothing is sampled.
Decoding sums exp(-bit * margin) over a codeword's bits; the codeword of least loss wins, and a small lead over the
second marks the row as ambiguous.

Defined results: null or letterless text gives 'und' with score 0.0; without any labelled row every text is 'und';
null lang or null id rows are never trained on; repeated rows get equal answers; other columns are not read. The
model's size is DIM x bits, whatever the input; texts are read whole, in slices, so memory doesn't grow with them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, text_batches

ORDERS = (1, 2, 3, 4)
DIM = 1 << 15
#: Bytes per slice of one batch's concatenated text.
SLICE = 1 << 19
#: How steep a margin (mean log odds per n-gram) enters the loss.
STEEP = 4.0
#: A share of the two best codewords' loss over which a row is ambiguous.
AMBIGUOUS = 0.45
#: A letter is a sign of Unicode category L: not a fraction, a circled digit or a Roman numeral sign.
HAS_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: str) -> bytes:
    """Lower-cased UTF-8 in which every ASCII byte that isn't a letter is a space."""
    return b" " + text.lower().encode().translate(_FOLD) + b" "


def grams(data: np.ndarray):
    """For each order the bucket of the n-gram at each byte (of the last n-1 bytes none)."""
    h = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)) if n > 1 else data + np.uint32(1)
        if n in ORDERS:
            yield ((h ^ np.uint32(n * 0x1E3779B1)) * np.uint32(0x85EBCA6B)) >> np.uint32(17)


def slices(data: bytes):
    """Overlapping slices, so that long texts never need more than SLICE bytes of work space; each n-gram comes once."""
    for at in range(0, len(data), SLICE):
        yield np.frombuffer(data[at : at + SLICE + max(ORDERS) - 1], dtype=np.uint8).astype(np.uint32), min(SLICE, len(data) - at)


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for langs, texts in text_batches(batches):
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts):
                of.setdefault(lang, []).append(fold(text))
            for lang, parts in of.items():
                total = totals.setdefault(lang, np.zeros(DIM, dtype=np.int64))
                for data, own in slices(b"".join(parts)):
                    for g in grams(data):
                        total += np.bincount(g[:own], minlength=DIM)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def code_matrix(n: int) -> np.ndarray:
    """Codewords in rows: all splits for up to 7 languages, else 12 log2(n) random columns of the best of 64 draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        others = np.array([c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]).T
        return np.vstack([np.ones(others.shape[1]), others])
    rng, bits, best = np.random.default_rng(0), 12 * math.ceil(math.log2(n)), None
    for _ in range(64):
        m = rng.choice((1.0, -1.0), size=(n, bits))
        near = max((m[i] @ m[j] for i in range(n) for j in range(i)), default=0)
        if best is None or near < best[0]:
            best = (near, m)
    return best[1]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: n-grams by language and bucket."""
        self.langs = langs
        self.code = code_matrix(len(langs))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * DIM)
        weights = [np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) if (c < 0).any() else np.zeros(DIM) for c in self.code.T]
        self.weights = np.clip(np.array(weights).T, -6, 6).astype(np.float32)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for data, own in slices(fold(text)):
            for g in grams(data):
                if len(g) > DIM // 4:
                    total += np.bincount(g[:own], minlength=DIM) @ self.weights
                else:
                    total += self.weights[g[:own]].sum(axis=0)
                n += min(own, len(g))
        return total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (1 less the best codeword's share of the two least losses), ambiguous."""
        if not self.langs or not text or not HAS_LETTER.search(text):
            return "und", 0.0, True
        loss = np.exp(np.clip(-self.code * self.margins(text) * STEEP, -50, 50)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0, False
        share = loss[order[0]] / (loss[order[0]] + loss[order[1]])
        return self.langs[order[0]], float(1 - share), bool(share > AMBIGUOUS)


def fit(docs: DataFrame) -> Model:
    """From text and lang of the rows that aren't held out. The driver gets at most languages x DIM counts."""
    counted = gram_counts(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))).toPandas()
    langs = sorted(set(counted["lang"]))
    matrix = np.zeros((len(langs), DIM))
    matrix[[langs.index(x) for x in counted["lang"]], counted["bucket"].to_numpy(dtype=int)] = counted["n"]
    return Model(langs, matrix)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for ids, texts in text_batches(batches):
            found = [m.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found])], ["doc_id", "lang_pred", "score", "ambiguous"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is identified, all columns as they are but lang, which becomes the prediction.

    Rows that get 'und' go: with any labelled row these are the texts that are null or have no letter, so the model
    decides which language a row has, not whether it stays; ambiguous texts and those in languages without labelled
    rows stay with the nearest codeword's language. Without a column lang of strings none is written.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    named = dict(docs.dtypes).get("lang") == "string"

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            found = [sent.value.predict(texts[i].as_py())[0] for i in range(len(texts))]
            if named:
                at = b.schema.get_field_index("lang")
                b = pa.RecordBatch.from_arrays([pa.array(found, b.schema.field(i).type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)
            yield b.filter(pa.array([x != "und" for x in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
