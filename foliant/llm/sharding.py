"""Sharding by Hilbert order; DataFrame functions alone.

Metadata dimensions are quantised to BITS bits each: the text's size (logarithmic), language, source and document id.
A row's cell gets its index on the Hilbert curve, rows follow the curve, and runs of equal counts become shards, so
a shard's file covers a compact box of every dimension, and a reader that filters by one of them skips the others'
files. Within a cell rows are ordered by the text's checksum, so equal texts of one cell lie together; equal texts
with other ids, languages or sources may lie in other cells, and then in other shards. The law is `rows`.

Ranks need no global sort: rows are counted by cell (2^(BITS x dimensions) at most), cells' counts are summed along
the curve, and rows are numbered within their cell. A cell of over CELL_ROWS rows is divided by ranges of the checksum
into parts of its own, as many as it takes; parts are summed within their cell and cells along the curve, so neither
sum sees all parts. Rows of one checksum stay in one part unless they alone are over CELL_ROWS: then that checksum is
divided by a hash of the id.

Defined results: null text has no bytes and checksum 0; null dimensions are quantised to 0; repeated rows take
places of their own; an empty table gives no rows; other columns are not read. With fewer rows than shards the first
shards get one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small

BITS = 4
CELL_ROWS = 50_000
#: Rows of a written file.
FILE_ROWS = 1_000_000


def quantised(docs: DataFrame) -> dict[str, Column]:
    """Each dimension's value in 0 .. 2^BITS - 1."""
    top = (1 << BITS) - 1
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = max(1, (high or 0) - (low or 0))
    return {
        "q_lang": F.coalesce(F.crc32(F.col("lang").cast("binary")) % (top + 1), F.lit(0)),
        "q_source": F.coalesce(F.crc32(F.col("source").cast("binary")) % (top + 1), F.lit(0)),
        "q_size": F.least(F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1) * 0.75), F.lit(top)),
        "q_id": F.coalesce(F.floor((F.col("doc_id") - (low or 0)) / span * top), F.lit(0)),
    }


def hilbert(axes: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a cell with these coordinates (J. Skilling, 2004), as a long."""
    n = len(axes)
    put = lambda x, at, value: F.transform(x, lambda v, j: F.when(j == at, value).otherwise(v))
    start = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x, step):
        p, q, i = step["q"] - 1, step["q"], step["i"]
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        return F.when(own.bitwiseAND(q) != 0, put(x, F.lit(0), first.bitwiseXOR(p))).otherwise(put(put(x, i, own.bitwiseXOR(swap)), F.lit(0), F.when(i == 0, first).otherwise(first.bitwiseXOR(swap))))

    x = F.aggregate(steps, start, undo)
    x = F.aggregate(F.array(*[F.lit(i) for i in range(1, n)]), x, lambda y, i: put(y, i, F.get(y, i).bitwiseXOR(F.get(y, i - 1)))) if n > 1 else x
    last = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    with_flip = F.transform(F.array(x), lambda y: F.transform(y, lambda v: v.bitwiseXOR(F.aggregate(last, F.lit(0).cast("long"), lambda t, q: F.when(F.get(y, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)))))
    places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.get(F.transform(with_flip, lambda y: F.aggregate(places, F.lit(0).cast("long"), lambda h, s: h * 2 + F.when(F.get(y, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))), F.lit(0))


def _placed(docs: DataFrame, shards: int, keep: list[str]) -> DataFrame:
    """_row (a struct of the columns `keep`), _size, _crc, _shard, _slot and _curve of every row."""
    dims = quantised(docs)
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("doc_id").alias("_id"), size.alias("_size"), crc.alias("_crc"), *[c.cast("int").alias(f"_{k}") for k, c in dims.items()])
    cell = [f"_{k}" for k in dims]
    ids = F.xxhash64("_id", "_crc", "_size")

    # parts of a cell: ranges of the checksum's high bits, as many as its rows ask for
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_cell_n"))
    many = materialize(cells.withColumn("_parts", F.ceil(F.col("_cell_n") / CELL_ROWS).cast("long")).drop("_cell_n"), "cells")
    rows = rows.join(F.broadcast(many), cell)  # 2^(BITS x dimensions) rows at most
    rows = rows.withColumn("_part", F.expr("(_crc * _parts) div 4294967296"))
    # checksums that alone are too many for a part
    crowded = rows.filter("_parts > 1").groupBy(*cell, "_part", "_crc").agg(F.count("*").alias("_n")).filter(F.col("_n") > CELL_ROWS)
    salts = small(materialize(crowded.select(*cell, "_crc", F.ceil(F.col("_n") / CELL_ROWS).cast("long").alias("_salts")), "crowded-checksums"))
    rows = rows.join(salts, [*cell, "_crc"], "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(1 + F.pmod(ids, F.col("_salts"))))
    # a part with a crowded checksum: rows before it, its salts, rows after it
    part = [*cell, "_part", "_salt", "_group"]
    rows = rows.withColumn("_group", F.when(F.col("_salt") > 0, F.col("_crc")).otherwise(F.lit(-1).cast("long")))

    counted = materialize(rows.groupBy(*part).agg(F.count("*").alias("_n")), "cell-parts")
    inside = Window.partitionBy(*cell).orderBy("_part", "_group", "_salt")
    parts = counted.withColumn("_in_cell", F.sum("_n").over(inside) - F.col("_n"))
    along = Window.orderBy("_curve")
    summed = counted.groupBy(*cell).agg(F.sum("_n").alias("_cell_n")).withColumn("_curve", hilbert([F.col(k) for k in cell]))
    starts = summed.select(*cell, "_curve", (F.sum("_cell_n").over(along) - F.col("_cell_n")).alias("_before"), F.sum("_cell_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    starts = parts.join(F.broadcast(starts), cell).select(*part, "_curve", "_total", (F.col("_before") + F.col("_in_cell")).alias("_before"))
    own = Window.partitionBy(*part).orderBy("_crc", "_id", "_size")
    ranked = rows.withColumn("_own", F.row_number().over(own)).join(starts, part).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    ranked = ranked.withColumn("_low", F.expr(f"_total div {shards}")).withColumn("_extra", F.col("_total") % shards).withColumn("_edge", F.col("_extra") * (F.col("_low") + 1))
    head = F.col("_rank") < F.col("_edge")
    shard = F.when(head, F.expr("_rank div (_low + 1)")).otherwise(F.col("_extra") + F.expr("(_rank - _edge) div greatest(_low, 1)"))
    slot = F.when(head, F.expr("_rank % (_low + 1)")).otherwise(F.expr("(_rank - _edge) % greatest(_low, 1)"))
    return ranked.withColumn("_shard", shard.cast("int")).withColumn("_slot", slot.cast("long"))


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve of every row."""
    named = {"_size": "size", "_crc": "text_crc32", "_shard": "shard", "_slot": "slot", "_curve": "curve"}
    rows = _placed(docs, shards, ["doc_id"]).select("_row.doc_id", *[F.col(a).alias(b) for a, b in named.items()])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write(docs: DataFrame, path: str, shards: int = 16, file_rows: int = FILE_ROWS) -> None:
    """docs as Parquet below path, in folders shard=K; a file holds up to file_rows rows that follow the curve.

    Every row is placed by itself, so repeated rows keep places of their own. Columns of docs stay as they are; one
    that is named shard would clash with the folders and is an error.
    """
    placed = _placed(docs, shards, docs.columns)
    rows = placed.withColumn("_file", F.expr(f"_slot div {file_rows}")).repartitionByRange("_shard", "_file").sortWithinPartitions("_shard", "_slot")
    rows.select("_row.*", F.col("_shard").alias("shard")).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
