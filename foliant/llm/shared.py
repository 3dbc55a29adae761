"""Places and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where the setting is absent and the master is local, as in tests, a temporary folder is made once and removed at
    exit. On a cluster a folder of the driver's machine would lose what executors write, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="foliant-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables in the shared folder, once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch between Spark and Python: with long texts, Spark's 10,000 would hold gigabytes.
BATCH_ROWS = 1_000


def bounded(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any file system works; see bounded()."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def give_back() -> None:
    """Unused memory of the allocators goes back to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_batches(batches, most: int = 1 << 21):
    """Arrow batches of (doc_id, text) as pairs of lists, in slices that end with the text that passes `most` bytes."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        start, size = 0, 0
        for i in range(len(ids)):
            size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if size > most:
                yield ids[start : i + 1], texts.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
        if start < len(ids):
            yield ids[start:], texts.slice(start).to_pylist()
        del ids, texts, batch
    give_back()


#: Bytes of a table up to which it is broadcast; its rows and strings are counted first.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """A materialized table, marked for broadcast where its size allows it: 32 bytes a column and the strings' bytes."""
    strings = [F.octet_length(F.col(f.name).cast("string")) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    wide = sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(32 * len(df.columns)))
    size = df.agg(F.sum(wide.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Bits of the maps that tell tasks which ids or digests matter (as a power of two): 8 MB, and up to 128 MB where many
#: values would fill a smaller one. A fuller map names more by chance, which costs work and changes no result.
MAP_BITS, MOST_MAP_BITS = 26, 30
#: Bits of a page of a map.
_PAGE = 15


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    """Each 64-bit value's bit in a map of 2^bits."""
    x = values.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(values: DataFrame) -> bytes:
    """A map of the values of a frame's only column (long), which is counted first. It may name others by chance, but misses none.

    Bits are made distinct before and after a shuffle and gathered by page, so no task sees more than all bits.
    """
    size = min(MOST_MAP_BITS, max(MAP_BITS, (8 * values.count()).bit_length()))

    def bits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size)))], ["bit"])

    def pages(batches):
        found = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        for own in np.split(at, np.flatnonzero(np.diff(at >> _PAGE)) + 1) if len(at) else []:
            page = np.zeros(1 << _PAGE, dtype=np.uint8)
            page[own & (1 << _PAGE) - 1] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(own[0] >> _PAGE)], pa.int64()), pa.array([np.packbits(page).tobytes()], pa.binary())], ["page", "bits"])

    out = np.zeros((1 << size - _PAGE, 1 << _PAGE - 3), dtype=np.uint8)
    by_page = values.mapInArrow(bits, "bit long").distinct().repartition(F.expr(f"bit div {1 << _PAGE}")).mapInArrow(pages, "page long, bits binary")
    for page, own in by_page.collect():  # 2^15 rows of 4 kB at most
        out[page] |= np.frombuffer(own, dtype=np.uint8)
    return out.tobytes()


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """bits: the map as unsigned bytes."""
    at = _places(values, (8 * len(bits)).bit_length() - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def mapped_rows(batches, bits: np.ndarray):
    """Arrow batches of (id, text) without the rows whose id is null or not in the map."""
    for b in batches:
        ids = b.column(0)
        keep = in_bitmap(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
        if keep.any():
            yield b.filter(pa.array(keep))
