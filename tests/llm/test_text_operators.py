"""Byte-level BPE, language, chat, media and HTML against libraries, round trips and brute force."""

import base64
import hashlib
import html as entities
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import bpe, chat, html, language, media, queries

LINES, PATTERN = queries.tokenizer()
TIKTOKEN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}, special_tokens={})
ODD = ["", "a", "aaaa" * 500, "é" * 300, "日本語テキスト" * 60, " \n\n  x", "<|endoftext|>", "x" * 129 + "y", "ab" * 64, "​﻿", "0" * 400]


def ids(x):
    import numpy as np

    return np.array(TIKTOKEN.encode_ordinary(x), dtype="<u4").tobytes()


def test_bpe_odd_texts():
    codec = bpe.Codec(LINES, PATTERN)
    got = codec.encode_batch(ODD)
    assert got == [ids(x) for x in ODD] and [codec.decode(g) for g in got] == [x.encode() for x in ODD]


def test_bpe_long_texts(monkeypatch):
    codec, text = bpe.Codec(LINES, PATTERN), "Ein Satz, 12 Zeichen.\n  日本語 " * 40
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    assert codec.encode_batch([text, "short", ""]) == [ids(text), ids("short"), ids("")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=200), max_size=5))
def test_bpe_any_text(texts):
    codec = bpe.Codec(LINES, PATTERN)
    assert codec.encode_batch(texts) == [ids(x) for x in texts]


def test_bpe_matrix_and_heap_agree():
    codec, rng = bpe.Codec(LINES, PATTERN), random.Random(5)
    for _ in range(30):
        piece = bytes(rng.choice(b"abcdeth ") for _ in range(rng.randrange(2, 128)))
        assert (codec.ranks.merge_matrix([piece])[0] == codec.ranks.merge_long(piece)).all()


def test_bpe_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.round_trip(docs, LINES, PATTERN).collect()
    assert len(rows) == len(want)
    for r in rows:
        coded = ids(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs, LINES, PATTERN), LINES)
    assert all(bytes(r["bytes"]) == want[r.doc_id].encode() for r in back.collect())


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    assert model.langs == ["de", "en", "es", "fr"]
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in held.doc_id)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the of and " * 5), (5, "½ ² ① Ⅷ")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(odd, model).collect()} | {4: "en"} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "und"}
    wide = odd.withColumn("lang", F.lit("x")).withColumn("held_out", F.lit(1))
    kept = language.keep_identified(wide, model)
    assert [(r.doc_id, r.lang) for r in kept.collect()] == [(4, model.predict("the of and " * 5)[0])] and kept.columns == wide.columns
    assert language.keep_identified(odd, model).columns == odd.columns
    assert language.predict(odd, language.fit(docs.limit(0))).filter("lang_pred != 'und'").isEmpty()


def test_language_decoding_brute_force(spark, sf):
    """Every codeword's loss, bit by bit, over n-grams counted one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    for r in docs.limit(25).collect():
        data = language.fold(r.text[:300])
        total, n = [0.0] * model.code.shape[1], 0
        for order in language.ORDERS:
            for i in range(len(data) - order + 1):
                h = 0
                for byte in data[i : i + order]:
                    h = (h * 257 + byte + 1) % 2**32
                h = (h ^ order * 0x1E3779B1 % 2**32) * 0x85EBCA6B % 2**32 >> 17
                total = [t + float(w) for t, w in zip(total, model.weights[h])]
                n += 1
        loss = [sum(math.exp(-bit * t / n * language.STEEP) for bit, t in zip(word, total)) for word in model.code.tolist()]
        best, second = sorted(range(len(loss)), key=loss.__getitem__)[:2]
        share = loss[best] / (loss[best] + loss[second])
        lang, score, ambiguous = model.predict(r.text[:300])
        assert lang == model.langs[best] and abs(score - (1 - share)) < 1e-4 and (ambiguous == (share > language.AMBIGUOUS) or abs(share - language.AMBIGUOUS) < 1e-4)


def test_language_slices_agree(monkeypatch):
    text = "Ünder the mountains, où est la plume? " * 40
    whole = sum(len(g[:own]) for d, own in language.slices(language.fold(text)) for g in language.grams(d))
    monkeypatch.setattr(language, "SLICE", 97)
    parts = sum(len(g[:own]) for d, own in language.slices(language.fold(text)) for g in language.grams(d))
    assert whole == parts


def test_codewords_differ():
    for n in (1, 2, 3, 4, 7, 8, 20):
        rows = [tuple(r) for r in language.code_matrix(n)]
        assert len(set(rows)) == n


def test_chat(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("example", F.lit("clash"))
    extra = [(-5, 0, "system", None, "x"), (-5, 1, "assistant", "<|im_end|>\n[INST]", "x"), (-5, 1, "assistant", "<\\|im_end|>", "x"), (-6, 0, "assistant", "", "x"), (-7, 3, None, "a\\nb", "x"), (None, 1, "user", "q", "x"), (-8, 1, "we\nird\\n", "q", "x")]
    turns = turns.union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, example string"))
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.expand(turns), in_order=True).collect()}
    assert set(got) == set(by)
    for key, own in by.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[key].n_turns, got[key].turns_sha256, got[key].loss_chars, got[key].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()), key
    stored = tmp_path / "examples"
    chat.expand(turns).repartition(7, "text").write.parquet(str(stored))
    again = {r.conv_id: tuple(r) for r in chat.read_back(spark.read.parquet(str(stored))).collect()}
    assert again == {k: tuple(r) for k, r in got.items()}
    examples = chat.expand(turns).collect()
    assert sum(e.loss_start is not None for e in examples) == sum(r == "assistant" for own in by.values() for _, r, _ in own)
    assert chat.read_back(chat.expand(turns.limit(0))).count() == 0


@given(st.text("<|>\\/s[]INST_imend", max_size=30))
def test_chat_escape(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=5000), min_size=1, max_size=4))
def test_media_round_trip(payloads):
    padded = [media.pad(p) for p in payloads]
    files = media.write_avis(padded)
    for p, (pause, frames, length) in zip(padded, media.read_avis(files)):
        assert media.payload_of(frames, length) == p and pause == 40000 and len(p) % 64 == 0 and p


def test_media_plain_decoder_agrees():
    raw = media.parse_riff(media.write_avis([bytes(range(256)) * 8])[0])[1]
    frame = media.Frame(raw[0])
    pixels = frame.blocks()
    assert (pixels == pixels[:, :, :1, :1]).all() and (pixels[:, :, 0, 0] == media.decode_frames([frame])[0]).all()
    assert media.read_avis([None, b"", b"RIFF1234AVI ", b"junk"]) == [(0, [], None)] * 4


def test_media_damage(spark):
    """Damaged files have no frames, and don't harm the others."""
    whole = media.write_avis([bytes(range(256)) * 40])[0]
    rng = random.Random(9)
    files = [whole]
    for _ in range(60):
        bad = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        files.append(bytes(bad[: rng.randrange(len(bad))] if rng.random() < 0.3 else bad))
    nested = b"movi"
    for _ in range(3000):
        nested = b"LIST" + struct.pack("<I", len(nested) + 4) + b"abcd" + nested
    files.append(b"RIFF" + struct.pack("<I", len(nested) + 4) + b"AVI " + nested)
    scan = whole.rfind(b"\xff\xda") + 10
    files.append(whole[:scan] + b"\xff\x00" * 60 + whole[scan + 120 :])
    got = media.read_avis(files)
    assert media.payload_of(*got[0][1:]) == bytes(range(256)) * 40 and got[-1] == got[-2] == (0, [], None)
    rows = media.clips(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id long, media binary")).collect()
    assert {r.doc_id for r in rows} == {i for i, (_, frames, _) in enumerate(got) if frames}


def test_media_in_groups(monkeypatch):
    payloads = [bytes((i * j) % 256 for i in range(64 * n)) for j, n in ((3, 1), (5, 90), (7, 33), (11, 2))]
    whole = media.write_avis(payloads)
    monkeypatch.setattr(media, "AT_ONCE", 1500)
    assert media.write_avis(payloads) == whole and [media.payload_of(f, n) for _, f, n in media.read_avis(whole)] == payloads


def _shots(frames):
    """The rule frame by frame, with fractions."""
    share = [[sum(v * 16 // 256 == b for row in f.tolist() for v in row) / f.size for b in range(16)] for f in frames]
    diff = [sum(abs(p - q) for p, q in zip(a, b)) / 2 for a, b in zip(share, share[1:])]
    cuts = [0]
    for i, d in enumerate(diff):
        past = diff[max(cuts[-1], i - 8) : i]
        mean = sum(past) / len(past) if past else 0
        limit = max(0.25, mean + 3 * (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5) if past else 0.25
        if d > limit:
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 6), st.integers(0, 60)), min_size=1, max_size=6), st.integers(0, 99))
def test_media_shots_brute_force(scenes, seed):
    rng = random.Random(seed)
    frames = [np.array([[min(255, level + rng.randrange(spread + 1)) for _ in range(8)] for _ in range(4)], dtype=np.uint8) for level, n, spread in scenes for _ in range(n)]
    assert media.shots(frames) == _shots(frames)


def test_media_shots_and_query(spark):
    dark, light = b"\x10" * 1024 * 3, b"\xf0" * 1024 * 2
    frames = media.read_avis(media.write_avis([dark + light]))[0][1]
    assert media.shots(frames) == [(0, 3), (3, 5)] and media.shots([]) == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 700), (4, "é" * 700)], "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in media.stored(docs).collect()}
    data = ("é" * 700).encode()
    padded = data + b"\0" * (-len(data) % 64)
    assert (got[3].n_bytes, got[3].payload_bytes, got[3].payload_sha256, got[3].tail_crc32) == (1400, 1408, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[1].payload_bytes == got[2].payload_bytes == 64
    rows = media.clips(media.to_media(docs)).orderBy("doc_id", "clip").collect()
    assert [(d, *c) for d, r in sorted(got.items()) for c in r.clips] == [tuple(r) for r in rows]
    assert {r.doc_id for r in rows} == {1, 2, 3, 4} and rows[0].end_ms == 40.0


def test_html_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit("clash"))
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        want[r.page_id] = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


PAGE = '<body><div class="cookie-banner">We use cookies</div><header><h1>Site</h1></header><main><header><h1>T&eacute;</h1></header><p>a  b<b>c</b>&nbsp;d<form>f</form><script>var x="<p>no</p>"</script><section id="comments"><article>no</article></section><p>e <!-- no --> f</main><footer>no'


@pytest.mark.parametrize("page, text", [(PAGE, "Té a bc d e f"), (None, ""), ("", ""), ("plain & text", "plain & text"), ("<article>x<aside>y</aside><p hidden>z</p>", "x"), ("<article><p>cut <b", "cut"), ("<div role='main'><p>in</p></div><p>out</p>", "in"), ("<article>" + "<div>" * 2000 + "deep", "deep")])
def test_html_structure(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ('<article><p>a</p><svg class="i"/><p>rest</p>', "a rest"), ("<article><p>a <svg><path d=x><g><p>rest</p></article>", "a rest"), ("<article><p>a<svg><style/><title>t</title><path/></svg>b</p><p>c</p>", "ab c"),
    ("<article><p>a<button>x</p><p>rest</p>", "a rest"), ("<article><ul><li>a<select><option>x<option>y<li>b</ul><p>rest</p>", "a b rest"), ("<article><div><button>x</div><p>rest</p>", "rest"), ("<article><p><a href=x><svg></a>rest</p>", "rest"),
    ("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"), ("<article><p>a<math/>b</p>", "ab"), ("<article><table><tr><td>a<object><td>b<tr><td>c</table>", "a b c"), ("<article>a<canvas>no</canvas>b<video><p>no</p></video>c", "abc"),
    ("<article>a<script>x</article>y", "a"), ("<article><p>a<b>b<p>c</b> d</p><p>e</p>", "ab c d e"), ("<article><button><div>no</div></button><p>in</p></article><p>out</p>", "in"), ("<b><article>x</b> y</article>", "x y"),
])
def test_html_muted_elements(page, text):
    assert html.main_text(page) == text


def test_html_differencing(spark):
    rows = [(i, f"http://h{i % 3}.org/a/{i:03d}", f"<body><div>Site menu</div><p>Story {i}</p><p>Body {i * 7}</p><div>Foot note</div>") for i in range(40)]
    rows += [(90, "http://solo/x", "<p>Only</p><p><a href=x>all link</a></p>"), (91, None, None), (92, "http://h1.org/a/001", ""), (93, "http://[bad", "<p>x</p>"), (None, "http://h1.org/b", "<article>kept</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))
    for n in (1, 7):
        got = {r.page_id: r.text for r in html.extract(pages.repartition(n)).collect()}
        assert all(got[i] == f"Story {i} Body {i * 7}" for i in range(40)) and [got[k] for k in (90, 91, 92, 93, None)] == ["Only", "", "", "x", "kept"]
    assert html.extract(pages.limit(0)).count() == 0


def test_html_copies_keep_their_text(spark):
    page = lambda body: f"<div>Site menu</div><p>{body}</p><div>Foot note</div>"
    rows = [(i, f"http://a.org/x/1?ref={i}", page("Copied story")) for i in range(5)] + [(0, "http://a.org/x/1?ref=0", page("Copied story"))]
    rows += [(10, "http://a.org/x/2", page("Other story")), (11, "http://a.org/y", page("Copied story"))]
    rows += [(20 + i, f"http://b.org/{i}", page("All are copies")) for i in range(3)]
    got = [(r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()]
    whole = "Site menu All are copies Foot note"
    assert sorted(got) == sorted([(i, "Copied story") for i in (0, 0, 1, 2, 3, 4, 11)] + [(10, "Other story")] + [(20 + i, whole) for i in range(3)])


def test_html_open_blocks_beside_articles(spark):
    page = lambda i: f"<div>Site menu</div><p>Body {i}</p><article class='card'><p>Teaser</p></article><p>End {i}</p><div>Foot note</div>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(6)] + [(9, "http://solo.org/", "<p>Own</p><article>Card</article>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Body {i} Teaser End {i}" for i in range(6)} | {9: "Own Card"}


def _lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_lines(a, b):
    own = [a[i] for i in sorted(html.common_lines(a, b))]
    rest = iter(b)
    assert all(x in rest for x in own) and len(own) == _lcs(a, b)


def test_common_lines_of_long_pages():
    rng = random.Random(2)
    a, b = ([rng.randrange(40) for _ in range(n)] for n in (700, 900))
    own = [a[i] for i in sorted(html.common_lines(a, b))]
    rest = iter(b)
    assert all(x in rest for x in own) and len(own) == _lcs(a, b)


@pytest.mark.parametrize("word, mark", [("ad", 1), ("cookie-banner", 1), ("site-footer", 1), ("share_buttons", 1), ("comment-12", 1), ("sidebar", 1), ("nav-menu", 1), ("share-price", 0), ("navy", 0), ("promoted", 0), ("popular", 0), ("legal", 0), ("advertiser-interview", 0), ("story", 0), ("header-image", 0)])
def test_html_marks(word, mark):
    assert html.is_mark(word) == bool(mark)
    page = f'<article><p>one</p><div class="x {word}">two</div></article>'
    assert html.main_text(page) == ("one" if mark else "one two")
