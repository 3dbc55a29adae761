"""Near duplicates, repeats, sharding, personal data, decontamination and the pipeline against brute force."""

import collections
import hashlib
import ipaddress
import math
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import duckdb
import pyarrow.parquet as pq
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from foliant.llm import decontaminate, graph, minhash, pii, queries, repeats, shared, sharding

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def _components(texts: dict) -> dict:
    """Brute force: all pairs of sets."""
    sets = {}
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def _near_copies(n, words, change):
    base = [f"w{i}" for i in range(words)]
    for i in range(n):
        own = list(base)
        for j in range(i % change):
            own[(i * 37 + j * 101) % words] = f"x{i}_{j}"
        yield " ".join(own)


def test_near_duplicates_brute_force(spark, monkeypatch):
    texts = {i: t for i, t in enumerate(_near_copies(60, 150, 9))}
    texts |= {100 + i: t for i, t in enumerate(_near_copies(30, 600, 40))}
    texts |= {200: None, 201: "", 202: " \n ", 203: "one two", 204: "ONE two", 205: "one  two three", 206: "a b c d e", 207: "A B C D E", 208: "é É é É é", 209: "É É É É É"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("_gone", F.lit(2))
    want = _components(texts)
    for hot, retained in ((minhash.HOT_VALUES, 1024), (-1000, 1024), (-1000, 300)):
        monkeypatch.setattr(minhash, "HOT_VALUES", hot)
        monkeypatch.setattr(minhash, "RETAINED", retained)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
        assert got == want
    monkeypatch.undo()
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, (_, c) in want.items() if c == k}


def test_near_duplicates_long_texts(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bb", "x" * 300, "é" * 40, "tail"]) for _ in range(n)) for n in (1, 3, 4, 5, 9, 400)] + ["\t" * 9000, "w" * 9000, ("w" * 5000 + " ") * 3, None, ""]
    whole = minhash.shingle_sets(texts)
    for piece in (50, 333, 4000):
        monkeypatch.setattr(minhash, "AT_ONCE", piece)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, minhash.shingle_sets(texts)))


def test_variants_of_one_template(spark):
    """Ten thousand texts that share a template but are no near copies, with some near copies among them."""
    template = [f"t{i}" for i in range(30)]
    texts = {}
    for i in range(10_000):
        own = [f"v{i}w{j}" for j in range(40)]
        texts[i] = " ".join(own[:20] + template + own[20:])
    for i in range(0, 400, 2):
        words = texts[i].split()
        texts[i + 1] = " ".join([*words[:-1], f"other{i}"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i - 1 if i < 400 and i % 2 else i for i in texts}


def test_estimate_keeps_pairs_at_the_threshold():
    for t in (0.80, 0.85):
        least = minhash.least_overlap(10_000, round(100 * t), minhash.K)
        assert least == math.ceil(t * minhash.K - minhash.ERRORS * math.sqrt(minhash.K * t * (1 - t)))
        assert sum(math.comb(minhash.K, i) * t**i * (1 - t) ** (minhash.K - i) for i in range(least)) < 1e-8


def test_near_copies_stage_brute_force(spark):
    texts = {}
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(60 + 40 * g)]
        texts[2 * g] = " ".join(words)
        texts[2 * g + 1] = " ".join(words[: len(words) - (len(words) - 4) * (12 + g) // 100])
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in texts.items())}
    like = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(12)]
    assert sum(0.8 <= x < 0.85 for x in like) >= 3 and any(x < 0.8 for x in like)
    docs = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda df: {r.doc_id for r in df.collect()}
    want = lambda least: {2 * g for g in range(12)} | {2 * g + 1 for g in range(12) if like[g] < least}
    assert kept(corpus_pipeline.drop_near_copies(spark, docs, "")) == want(0.8)
    assert kept(minhash.keep_first(docs)) == want(0.85)


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now"), (2, "other words are here now")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100}


def test_bitmaps_and_shared_folder(spark, monkeypatch, tmp_path):
    for bits in (15, 17):  # the second is too small at first and grows
        monkeypatch.setattr(shared, "MAP_BITS", bits)
        monkeypatch.setattr(shared, "MOST_MAP_BITS", 19)
        got = np.frombuffer(shared.bitmap(spark.range(0, 30_000, 3)), dtype=np.uint8)
        named = shared.in_bitmap(got, np.arange(30_000, dtype=np.int64))
        assert len(got) * 8 == 1 << 17 and named[::3].all() and named.mean() < 0.45
    assert not np.frombuffer(shared.bitmap(spark.range(0)), dtype=np.uint8).any()
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert shared.materialize(spark.range(5), "t").count() == 5 and list(tmp_path.rglob("*.parquet"))
    shared.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_no_machine_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared.shared_dir(session)


def _without_repeats(rows):
    seen, out = {}, {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            first = seen.setdefault(data[s : s + 100], (key, s))
            if first < (key, s):
                gone[s : s + 100] = b"\1" * 100
        out[key] = (len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_repeats_brute_force(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120").collect()]
    passage = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(150))
    rows += [(1000 + i, f"{'é' * i} start {i} {passage}{passage[: 40 + i]} end {i * i}") for i in range(25)]
    rows += [(5000, "a" * 500), (5001, "ab" * 200), (5002, None), (5003, ""), (5004, "x" * 99), (5005, "x" * 100), (5006, "x" * 100), (None, "a" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    want = _without_repeats(rows)
    for hot, piece in ((repeats.HOT_RUNS, repeats.AT_ONCE), (3, 1000), (repeats.HOT_RUNS, 150)):
        monkeypatch.setattr(repeats, "HOT_RUNS", hot)
        monkeypatch.setattr(repeats, "AT_ONCE", piece)
        got = repeats.remove(docs).filter("doc_id is not null").collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
        ways = {r.way for r in repeats.spans(docs).select("way").distinct().collect()}
        assert ways == ({"runs", "windows", "hot"} if hot == 3 else {"runs", "windows"})
    assert repeats.remove(docs).count() == len(rows) and repeats.remove(docs.limit(0)).count() == 0


def test_repeats_across_boundaries(spark):
    """One passage in all documents: its equal suffixes lie in many buckets, and only the first place stays."""
    passage = "".join(chr(97 + (i * i * 11 + 3 * i) % 26) for i in range(260))
    rows = [(i, f"{passage} {i}") for i in range(300)] + [(7, f"{passage} 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.n_removed for r in repeats.remove(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = _without_repeats(list(dict(rows).items()))
    assert got == {k: v[1] for k, v in want.items()}


def test_bucket_edges():
    """The last suffix of a bucket against the first of the next, over whole buckets of one suffix."""
    end = lambda key, digest, doc, n: SimpleNamespace(key=key, digest=digest, doc=doc, start=0, n=n)
    edges = [(0, end(1, 5 << 7, 1, 1), end(2, 6 << 7, 3, 4)), (1, end(2, 6 << 7, 3, 9), end(2, 6 << 7, 3, 9)), (2, end(2, 6 << 7, 4, 2), end(2, 7 << 7, 1, 2)), (5, end(2, 8 << 7, 1, 1), end(9, 8, 1, 1))]
    assert repeats.across(edges, False, 10) == [(repeats.HOT, 2, 0, 0, 0), (repeats.GONE, 6, 0, 4, 0), (repeats.HOT, 2, 0, 0, 0), (repeats.SEVERAL, 2, 0, 0, 0), (repeats.HOT, 2, 0, 0, 0)]
    assert repeats.across([], False, 10) == [] and [x[0] for x in repeats.across(edges, True, 1)] == [repeats.GONE]


@given(st.lists(st.integers(0, 5), min_size=4, max_size=40), st.integers(1, 4))
def test_least_places(values, width):
    x = np.array(values, dtype=np.uint64)
    assert repeats._least(x, width).tolist() == [i + values[i : i + width].index(min(values[i : i + width])) for i in range(len(values) - width + 1)]


def _skilling(axes, bits=4):
    """The Hilbert index of a cell, in plain code."""
    x, n = list(axes), len(axes)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & q - 1
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] & 1 << b:
            t ^= (1 << b) - 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def _curve(doc, low, span):
    size = len((doc.text or "").encode()) + 1
    q = [zlib.crc32(v.encode()) % 16 if v is not None else 0 for v in (doc.lang, doc.source)]
    return _skilling([*q, min(15, math.floor(math.log2(size) * 0.75)), math.floor((doc.doc_id - low) / span * 15) if doc.doc_id is not None else 0])


def test_sharding(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("part", F.lit("clash"))
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None, "x")], docs.schema)).unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(30)).drop("id"))
    rows = docs.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    curve = {r.doc_id: _curve(r, min(ids), max(ids) - min(ids)) for r in rows}
    for most in (sharding.CELL_ROWS, 2):
        monkeypatch.setattr(sharding, "CELL_ROWS", most)
        got = sharding.assign(docs).toPandas()
        sizes = got.groupby("shard").size()
        assert len(got) == docs.count() and set(sizes.index) == set(range(16)) and sizes.max() - sizes.min() <= 1
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
        ids_ = got.doc_id.astype(object).where(got.doc_id.notna(), None)
        assert [curve[d] for d in ids_] == got.curve.tolist()  # brute force
        along = got.sort_values(["shard", "slot"])
        assert along.curve.is_monotonic_increasing
        runs = along.groupby("curve").text_crc32.apply(lambda c: (c != c.shift()).sum() == c.nunique())
        assert runs.all()  # equal texts of a cell lie together
    text = {r.doc_id: r.text or "" for r in rows}
    assert all(zlib.crc32(text[d].encode()) == c and len(text[d].encode()) + 1 == s for d, c, s in zip(ids_, got.text_crc32, got["size"]))
    assert sharding.assign(docs.limit(0)).count() == 0 and sorted(r.shard for r in sharding.assign(docs.limit(3)).collect()) == [0, 1, 2]


def test_sharding_writes_and_prunes(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_row", F.lit("clash")).withColumn("_size", F.lit(0))
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1))
    sharding.write(docs, str(tmp_path / "out"), 16, file_rows=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: collections.Counter(map(tuple, df.select(docs.columns).collect()))
    assert key(back) == key(docs)
    sizes = sorted(r["count"] for r in back.groupBy("shard").count().collect())
    assert len(sizes) == 16 and sizes[-1] - sizes[0] <= 1
    files = list((tmp_path / "out").rglob("*.parquet"))
    bounds = [[(s.min, s.max) for s in (pq.ParquetFile(f).metadata.row_group(0).column(i).statistics for i in (0, 2))] for f in files]
    assert len(files) >= 16 and all(pq.ParquetFile(f).metadata.num_rows <= 8 for f in files)
    ids = [r.doc_id for r in docs.collect()]
    low, high = min(ids), min(ids) + (max(ids) - min(ids)) // 8
    # a range of ids, or a language, leaves most files unread by their statistics
    assert sum(a <= high and b >= low for (a, b), _ in bounds) <= len(files) / 2
    assert sum(a <= "de" <= b for _, (a, b) in bounds) <= len(files) / 2


def test_hilbert_steps(spark):
    cells = spark.range(1 << 9).select(*[F.expr(f"(id div {1 << 3 * i}) % 8").alias(f"a{i}") for i in range(3)])
    rows = sorted((r[3], r[:3]) for r in map(tuple, cells.select("a0", "a1", "a2", sharding.hilbert([F.col(f"a{i}") for i in range(3)], 3)).collect()))
    assert [h for h, _ in rows] == list(range(512)) and all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for (_, a), (_, b) in zip(rows, rows[1:]))


KEY = "a secret of these tests"
PRIVATE = {
    "email": "john.smith@mail.com", "phone": "+1 (017) 555-7713", "card": "4929348385146306", "ip": "97.51.17.173", "ssn": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00",
    "secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962", "person": "Johnson", "cyrillic": "Петров",
}


def test_surrogates(spark):
    texts = [f"Write to {PRIVATE['email']} or JOHN.SMITH@MAIL.COM.", f"Call {PRIVATE['phone']}, (017) 555-7713; card {PRIVATE['card']}, 4929-3483-8514-6306.", f"from {PRIVATE['ip']}. ssn {PRIVATE['ssn']}", f'token = "{PRIVATE["secret"]}"', "Mr. James Johnson met Mrs Mary Johnson, Dr Иван Петров", PRIVATE["iban"], None, "", "clean text, version 1.2.3 of 2024-01-02, sum 12.50"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("_done", F.lit(1)).withColumn("row", F.lit(2)).withColumn("later", F.lit(3))
    out = pii.replace(docs, KEY)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == [*docs.columns, "_n_entities"]
    assert not any(v in (t or "") for v in PRIVATE.values() for t in got.values())
    assert [got[i] for i in (6, 7, 8)] == texts[6:]
    first, second = re.search(r"to (\S+@\S+) or (\S+@\S+)\.$", got[0]).groups()
    assert first.upper() == second and re.fullmatch(r"[a-z]{4}\.[a-z]{5}@[a-z0-9]+\.example\.org", first.replace(first[10:].split("@")[0], "", 1) if first.index("@") > 10 else first)
    phone, bare, card, spaced = re.search(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}), (\(\d{3}\) \d{3}-\d{4}); card (4\d{15}), (4\d{3}-\d{4}-\d{4}-\d{4})\.$", got[1]).groups()
    assert phone == "+1 " + bare and spaced.replace("-", "") == card
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    assert luhn(card) == luhn(PRIVATE["card"])
    names = re.fullmatch(r"Mr\. (\S+n) (\S+) met Mrs (\S+la) (\S+), Dr (\S+) (\S+)", got[4]).groups()
    assert names[1] == names[3] and re.fullmatch("[А-Я][а-я]+", names[5])
    assert re.search(r'token = "[0-9a-f]{40}"$', got[3]) and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[5])
    assert {r.doc_id: r.text for r in pii.replace(docs, KEY).collect()} == got and pii.replace(docs, "other key").filter("doc_id = 0").first().text != got[0]
    assert pii.replace(docs.limit(0), KEY).count() == 0


def test_long_secrets_and_short_addresses(spark):
    rng = random.Random(3)
    sign = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bodies = [sign(word + "_-", 1000), sign("0123456789abcdef", 1000), sign("0123456789ABCDEF", 129), "sk-" + sign(word, 400), "sk-" + sign(word + "_-", 400) + "x", sign(word, 300_000)]
    texts = [f'token = "{bodies[0]}" end', f"key {bodies[1]} end", f"key {bodies[2]} end", f"key {bodies[3]} end", f"key {bodies[4]} end", f'secret: "{bodies[5]}" end']
    v6 = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8::", "2001:DB8:0:0:1::1", "fd00::", "1:2:3:4:5:6:7:8", "::ffff:192.0.2.128", "64:ff9b::192.0.2.33", "2001:db8::192.0.2.7"]
    texts += [f"from {a}, port" for a in v6] + ["2001:db8::1 2001:0DB8:0:0:0:0:0:1 2001:db8:0::1"]
    clean = ["x[::2] y[1::2] std::add face::add at 12:30:45, a::b", "12:34:56:78::90 is ::1", "2001:db8:1:2:3:4:5:6::7"]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = [r.text for r in pii.replace(docs, KEY).orderBy("doc_id").collect()]
    for body, text, new in zip(bodies, texts, got):
        assert len(new) == len(text) and new != text and new.endswith(("end",))
        old = {body[i : i + 12] for i in range(len(body) - 11)}
        assert not any(new[i : i + 12] in old for i in range(len(new) - 11))
    for a, new in zip(v6, got[len(bodies) :]):
        assert re.fullmatch(r"from fd[0-9a-f]{2}(:[0-9a-f]{4}){7}, port", new), (a, new)
    assert len(set(got[len(texts) - 1].split())) == 1 and got[len(texts) :] == clean


def test_surrogates_stay_distinct(spark, monkeypatch):
    texts = [(i, f"Mr. S{chr(97 + i % 26)}{chr(97 + i // 26)}x called +1 (017) 555-{i:04d} from 10.0.{i // 256}.{i % 256}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few = {k: v[:2] * 8 for k, v in pii.SYLLABLES.items()}
    few["latin"] = ["ba", "ce", "di", "fo"] * 4  # 4^5 names for 400 entities: many collide
    monkeypatch.setattr(pii, "SYLLABLES", few)
    for most in (pii.LATER_MAP, 3):
        monkeypatch.setattr(pii, "LATER_MAP", most)
        got = [r.text for r in pii.replace(docs, KEY).collect()]
        parts = [re.fullmatch(r"Mr\. (\S+) called (\+1 \(\d{3}\) \d{3}-\d{4}) from (\S+)", t).groups() for t in got]
        assert [len(set(x)) for x in zip(*parts)] == [400, 400, 400]


SPELLINGS = [  # one entity a line, in several spellings; all are distinct
    ("phone", ["+44 1234 567890", "+441234567890", "+44-1234-567890", "+44.1234.567890"]), ("phone", ["+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "+1 017 555 7713"]),
    ("phone", ["06 12 34 56 78", "06.12.34.56.78"]), ("phone", ["030 1234567"]), ("phone", ["+351 21 123 4567", "+351211234567"]), ("card", ["4929348385146306", "4929-3483-8514-6306", "4929 3483 8514 6306"]),
    ("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]), ("iban", ["GB29 NWBK 6016 1331 9268 19"]), ("ip", ["10.0.0.1"]), ("ip", ["10.0.0.2"]), ("ip", ["172.16.9.9"]), ("ip", ["192.168.7.1"]), ("ip", ["8.8.4.4"]), ("ip", ["127.0.0.9"]),
    ("ip", ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1"]), ("email", ["a.b@c.org", "A.B@C.ORG"]), ("email", ["a.c@c.org"]), ("ssn", ["123-45-6789"]), ("birth", ["born on 12.03.1980", "dob: 1980-03-12", "née le 12/03/1980"]), ("birth", ["born 13.03.1980"]),
    ("person", ["Dr. Alex", "Mr. Alex", "Herr Alex", "Prof. Dr. Alex"]), ("person", ["Alexander Petersen", "Mr. Alexander Petersen", "Dr Alexander Petersen", "Sir Alexander Petersen"]), ("person", ["Mrs. Doe", "Frau Doe"]),
]


def _canonical(text):
    """Signs that count, in lower case, without what only tells the type."""
    text = re.sub(r"^(?:Prof\. Dr\.|Dr\.?|Mr\.|Mrs\.|Herr|Frau|Sir|born on|born|dob:|née le) ", "", text)
    if re.fullmatch(r"[0-9a-fA-F:]*:[0-9a-fA-F:]*", text):
        return str(ipaddress.ip_address(text))
    if m := re.fullmatch(r"(\d\d)[./](\d\d)[./](\d{4})", text):
        return "".join(m.groups()[::-1])
    return text.lower() if "@" in text else re.sub(r"^1(?=\d{10}$)", "", re.sub(r"[^A-Za-z0-9]", "", text).lower()) if text[:2] != "10" and text.count(".") != 3 else text


def test_surrogates_by_entity(spark):
    """Against a table of entities: spellings agree, entities differ, formats and classes stay."""
    rows = [(i * 10 + j, f"see {s}, then", s) for i, (_, own) in enumerate(SPELLINGS) for j, s in enumerate(own)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text[4:-6] for r in pii.replace(docs, KEY).collect()}
    seen = {}
    for i, (kind, own) in enumerate(SPELLINGS):
        new = [got[i * 10 + j] for j in range(len(own))]
        forms = {_canonical(x) for x in new}
        assert len(forms) == 1 and not forms & {_canonical(x) for x in own}, (own, new)
        assert seen.setdefault((kind, *forms), i) == i
        shape = lambda x: re.sub(r"\d", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", x)))
        if kind in ("phone", "card", "ssn", "birth"):
            assert [shape(x) for x in new] == [shape(x) for x in own]
        for old, x in zip(own, new):
            if kind == "iban":
                flat = x.replace(" ", "")
                assert x[:2] == old[:2] and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
            if kind == "ip":
                a, b = ipaddress.ip_address(old), ipaddress.ip_address(x)
                assert a.version == b.version and (a.version == 6 or (a.is_private, a.is_loopback, a.is_global) == (b.is_private, b.is_loopback, b.is_global)), (old, x)
            if kind == "phone" and old[0] in "+0":
                assert x[: 3 if old.startswith("+44") else 4 if old.startswith("+351") else 1] == old[: 3 if old.startswith("+44") else 4 if old.startswith("+351") else 1] or old.startswith("017")
    assert got[0][:3] == "+44"
    noun = spark.createDataFrame([(1, "Herr Müller Auto fahren"), (2, "on 12.03.1980 at 12:30, 1 200 000 times")], "doc_id long, text string")
    assert [re.fullmatch(r"Herr \S+ Auto fahren|on 12.03.1980 at 12:30, 1 200 000 times", r.text) is not None for r in pii.replace(noun, KEY).collect()] == [True, True]
    with pytest.raises(ValueError):
        pii.replace(docs, "")


@pytest.mark.parametrize("most", [shared.BROADCAST_BYTES, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old if most else "-1")
    try:
        _decontamination(spark)
        if not most:
            _windows_brute_force(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _windows_brute_force(spark):
    """Few words, so that windows overlap, repeat and share terms."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    docs, tests = [(i, text(rng.randrange(60))) for i in range(40)], [(i, text(rng.randrange(1, 9))) for i in range(12)]
    want = {}
    for d, t in docs:
        w, hit, own = t.split(), set(), set()
        for i, x in tests:
            v = x.split()
            n = min(3, len(v))
            for s in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        own.add(i)
        if hit:
            want[d] = (len(hit), len(own))
    found = decontaminate.hit_counts(decontaminate.phrase_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string"), 3))
    assert {r.doc_id: (r.n_hit, r.n_items) for r in found.collect()} == want


def _decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"x {item} y"), (2, item[:50]), (3, f"{item.upper()}!! {item}"), (4, "a short one"), (5, None), (6, ""), (None, item), (7, "Zwei"), (7, "Zwei")]
    tests = [(10, item), (11, "short one"), (12, None), (13, ""), (14, "ZWEI"), (2, item)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("hit_id", F.lit(1)), spark.createDataFrame(tests, "item_id long, text string")
    got = collections.defaultdict(list)
    for r in decontaminate.contamination(df, bench).collect():
        got[r.doc_id].append((r.n_words, r.n_hit, r.n_items, r.contaminated))
    assert dict(got) == {1: [(14, 12, 2, True)], 2: [(8, 0, 0, False)] if len(item[:50].split()) == 8 else [(9, 0, 0, False)], 3: [(24, 24, 2, True)], 4: [(3, 2, 1, True)], 5: [(0, 0, 0, False)], 6: [(0, 0, 0, False)], None: [(12, 12, 2, True)], 7: [(1, 1, 1, True)] * 2}
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {2, 5, 6} and decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").isEmpty() and decontaminate.contamination(df.limit(0), bench).count() == 0
    near = decontaminate.proximity_matches(spark.createDataFrame([(1, "kappa filler zeta filler alpha mu"), (2, "kappa zeta")], "doc_id long, text string"), spark.createDataFrame([(1, "alpha zeta kappa mu")], "item_id long, text string"), terms=4, within=8)
    assert [(r.doc_id, r["first"], r["last"]) for r in near.collect()] == [(1, 0, 5)]


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries_materialize(stage(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.count())
    assert names[0] == "language_id" and seen == sorted(seen, reverse=True) and seen[1] > seen[2] > seen[3] == seen[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(last) == rows(entry.queries()["pipeline"](spark, sf))


def queries_materialize(df, name):
    from foliant.llm.shared import materialize

    return materialize(df, f"test-{name}")


def test_value_counts_in_little_memory(spark):
    """All buckets of the histogram reach the driver in less than 16 MB of Python's memory; the table has 2."""
    n = 1 << minhash.BUCKET_BITS
    signed = spark.range(2 * n).selectExpr("1 AS kind", f"id % {n} AS doc_id", "id AS n")
    tracemalloc.start()
    counts = minhash.value_counts(signed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [2 * i + n for i in range(n)]
    assert minhash.value_counts(signed.filter("doc_id = 7 or kind = 0"))[[6, 7]].tolist() == [0, 14 + n]
    assert minhash.value_counts(signed.limit(0)).sum() == 0
    assert peak < 16 << 20, peak
