"""The driver's contract, sources and the stream."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliant.operators import consolidate
from foliant.plans import queries as plans
from foliant.sources import sinks, uploads
from foliant.streaming import revisions
from tests.helpers import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, sf).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_without_oracle(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_uploads(spark, tmp_path):
    for name in ("invoice.pdf", "form.PNG", "readme.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = {r["source_file"]: r["source_kind"] for r in uploads.folder(spark, str(tmp_path)).collect()}
    assert found == {"invoice.pdf": "pdf", "form.PNG": "image"}
    kinds = spark.createDataFrame([("x", "application/pdf"), ("y.bin", "image/webp"), ("z", None)], "n string, m string").select(uploads.upload_kind(F.col("n"), F.col("m"))).collect()
    assert [r[0] for r in kinds] == ["pdf", "image", None]
    jobs = spark.createDataFrame([("a", "h", 300), ("b", "h", 300), ("c", "h", 200)], "job_id string, hash string, dpi int").withColumn("fingerprint", uploads.fingerprint(F.col("hash"), F.col("dpi")))
    assert {r["job_id"]: r["cached"] for r in uploads.once(jobs).collect()} == {"a": False, "b": True, "c": False}


def test_sinks(spark, tmp_path):
    files = sinks.table_files(tables(spark, (1, [["a", 'b"c'], ["1", "2,3"]])))
    assert files.first()["csv"] == 'a,"b""c"\r\n1,"2,3"\r\n'
    sinks.write_json(files, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert "<h2>page_001_table_01</h2>" in sinks.tables_index(tables(spark, (1, [["a"], ["b"]]))).first()["html"]


def test_revision_stream(spark, tmp_path):
    log = tmp_path / "in"
    log.mkdir()
    (log / "a.json").write_text('{"doc_id":1,"field_id":"f","batch_id":1,"ord":1,"old_value":"x","new_value":" y ","saved_at":"2026-01-01T00:00:00Z"}\n')
    (log / "b.json").write_text('{"doc_id":1,"field_id":"f","batch_id":2,"ord":1,"old_value":"y","new_value":"z","saved_at":"2026-01-01T00:05:00Z"}\n{"doc_id":1,"field_id":""}\n')
    query = revisions.append(revisions.read(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 2
    live = revisions.latest_stream(revisions.read(spark, str(log))).writeStream.outputMode("update").format("memory").queryName("live").start()
    live.processAllAvailable()
    live.stop()
    assert [r["new_value"] for r in spark.table("live").collect()][-1] == "z"


def write(con, path, **tables):
    """Parquet files of the tables' SQL, also as views."""
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{path}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet'")


def same(spark, con, path, name):
    """The query's rows, once they are those of its SQL."""
    want = con.execute(plans.ORACLES[name]).df()
    got = plans.QUERIES[name](spark, str(path)).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(tuple, d.astype(object).to_numpy().tolist()))
    assert rows(got) == rows(want)
    return rows(got)


def test_invoice_boundaries(spark, tmp_path):
    """A sum at half a cent; a difference that only rounding brings within the tolerance; no total and no items."""
    con, day = duckdb.connect(), "timestamp '1996-01-01' AS d"
    orders = "(1, 219105.995), (2, 100.0), (3, 100.0), (4, NULL), (5, 7.0)"
    items = "(1, 219105.995), (2, 98.996), (3, 99.0), (4, 1.0)"
    write(
        con, tmp_path, orders=f"SELECT o::BIGINT AS o_orderkey, t::DOUBLE AS o_totalprice, {day} FROM (VALUES {orders}) x(o, t)",
        lineitem=f"SELECT o::BIGINT AS l_orderkey, 7::BIGINT AS l_partkey, 1 AS l_linenumber, a::DOUBLE AS l_extendedprice, 0::DOUBLE AS l_discount, 0::DOUBLE AS l_tax FROM (VALUES {items}) x(o, a)",
    )
    assert [(r[0], r[3], r[4]) for r in same(spark, con, tmp_path, "invoice_reconciliation")] == [(1, 219106, "matched"), (2, 99, "mismatch"), (3, 99, "matched"), (4, 1, "mismatch"), (5, 0, "not_available")]


def test_invoice_order(spark):
    """An order's amounts add up to the same in any order: these six to 219105.995, as doubles also to a neighbour of it."""
    amounts = [4199.12084, 98849.363184, 36301.965696, 2646.75528, 32823.6594, 44285.1306]
    orders = list(itertools.permutations(amounts))[::7]
    items = spark.createDataFrame([(i, j, f"part {x}", None, None, x) for i, p in enumerate(orders) for j, x in enumerate(p)], "doc_id long, ord int, description string, quantity double, unit_price double, amount double").coalesce(1)
    totals = spark.createDataFrame([(i, 0.0, 1.0) for i in range(len(orders))], "doc_id long, tax double, total double")
    assert {r["raw_sum"] for r in consolidate.reconcile_items(items, totals).collect()} == {219105.995}


def test_line_confidence_half_cent(spark, tmp_path):
    """200 words whose mean is 49.995."""
    con = duckdb.connect()
    write(con, tmp_path, documents="SELECT 116771::BIGINT AS doc_id, repeat('w ', 200) AS text")
    assert [(r[3], r[4]) for r in same(spark, con, tmp_path, "line_confidence")] == [(50, 200)]


def test_review_half_cent(spark, tmp_path):
    """A second line with 200 known confidences whose mean is 49.995."""
    con = duckdb.connect()
    write(con, tmp_path, documents="SELECT 15::BIGINT AS doc_id, 'a' || chr(10) || repeat('w ', 223) || 'w' AS text")
    assert 50 in [r[7] for r in same(spark, con, tmp_path, "review_regions")]
