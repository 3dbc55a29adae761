"""Routing, bundles, consolidation, layout, tables, chunks, evidence, charts, review, robustness."""

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import bundles, charts, chunks, consolidate, copilot, evidence, layout, outline, review, robustness, router, words, workbench
from foliant.operators import tables as tables_
from tests.helpers import lines, tables


def routed(spark, text, items=0):
    df = spark.createDataFrame([(1, text, 1, 0, 0, items)], "doc_id long, lines array<string>, page_count int, heading_count int, paragraph_count int, item_table_count int")
    return router.route(df).first()


def test_router_labels(spark):
    assert routed(spark, ["Tax Invoice", "Invoice No: 7", "Total $5.00", "Tax $1.00"], 1)["label"] == "invoice"
    assert routed(spark, ["Sales Receipt", "Latte 4.50", "Bagel 3.20", "Total 7.70"])["label"] == "receipt"
    form = routed(spark, ["Application Form", "Name: A", "Date: B", "Phone: C", "☑ yes"])
    assert form["label"] == "form" and form["downstream"] == "form_to_json"
    assert routed(spark, ["Passport", "Nationality: X", "Date of Birth: 1990-01-01"])["label"] == "id"
    plain = routed(spark, ["nothing here"])
    assert (plain["label"], plain["score_report"], plain["confidence"], plain["downstream"]) == ("report", 1.0, 0.95, "")
    assert routed(spark, [])["label"] == "report"


def test_router_gather(spark):
    got = router.gather(lines(spark, ["b", "a"], ["c"])).first()
    assert got["lines"] == ["b", "a", "c"] and got["page_count"] == 2


def test_bundle_of_invoices(spark):
    rows = [(1, 1, "invoice", 0.9, 1, 3.0), (1, 2, "invoice", 0.9, 1, 3.0), (2, 1, "report", 0.6, 0, 0.5), (2, 2, "report", 0.6, 1, 3.5), (2, 3, "report", 0.6, 1, 3.5), (3, 1, "form", 0.9, 1, 3.0), (3, 2, "report", 0.5, 0, 0.0)]
    pages = spark.createDataFrame(rows, "doc_id long, page_num int, label string, confidence double, hits int, start_score double")
    got = [(r["doc_id"], r["start_page"], r["end_page"], r["label"]) for r in bundles.segments(bundles.split(pages)).orderBy("doc_id", "segment").collect()]
    assert got == [(1, 1, 1, "invoice"), (1, 2, 2, "invoice"), (2, 1, 2, "report"), (2, 3, 3, "report"), (3, 1, 2, "form")]


def test_items_over_pages(spark):
    head = ["Item", "Qty", "Price", "Amount"]
    found = consolidate.items_from_tables(tables(spark, (1, [head, ["USB Cable", "2", "$5.00", "$10.00"], ["Mouse", "1", "$20.00", "$20.00"]]), (2, [head, ["USB Cable", "2", "$5.00", "$10.00"], ["Keyboard", "1", "$30.00", "$30.00"], ["Total", "", "", "$60.00"]])))
    items = found.withColumn("ord", F.row_number().over(__import__("pyspark").sql.Window.orderBy("page_num", "row_index")))
    totals = spark.createDataFrame([(1, 5.5, 65.5), (2, None, 10.0)], "doc_id long, tax double, total double")
    got = {r["doc_id"]: r for r in consolidate.reconcile_items(items, totals).collect()}
    assert (got[1]["item_count"], got[1]["duplicates"], got[1]["item_sum"], got[1]["calculated_total"], got[1]["status"]) == (3, 1, 60.0, 65.5, "matched")
    assert (got[2]["item_count"], got[2]["status"]) == (0, "not_available")
    pairs = consolidate.duplicate_pairs(consolidate.keep_first(items, consolidate.item_key(), ["ord"]), ["ord"]).collect()
    assert [(p["kept_page_num"], p["duplicate_page_num"]) for p in pairs] == [(1, 2)]


def test_bank_statement(spark):
    head = ["Date", "Description", "Debit", "Credit", "Balance"]
    found = consolidate.transactions_from_tables(tables(spark, (1, [head, ["2026-04-01", "Salary", "", "$300.00", "$1,300.00"]]), (2, [head, ["2026-04-01", "Salary", "", "$300.00", "$1,300.00"], ["2026-04-02", "ATM", "$50.00", "", "$1,250.00"]])))
    rows = found.withColumn("ord", F.col("page_num") * 100 + F.col("row_index"))
    stated = consolidate.balances(lines(spark, ["Opening Balance $1,000.00", "Closing Balance $1,250.00"]))
    got = consolidate.reconcile_statements(rows, stated).first()
    assert (got["transaction_count"], got["duplicates"], got["net_change"], got["calculated_closing"], got["status"]) == (2, 1, 250.0, 1250.0, "matched")


def test_layout(spark):
    page = lambda n, body: [("ACME Report", 300, 20, 700, 44), *body, (f"Page {n}", 460, 1340, 540, 1364)]
    one = page(1, [("Quarterly Report", 300, 120, 700, 168), ("1. Overview", 80, 240, 260, 264), ("This is a para-", 80, 300, 400, 324), ("graph of text.", 80, 330, 400, 354), ("- first point", 80, 420, 300, 444), ("- second point", 80, 460, 300, 484)])
    own = lines(spark, one, page(2, [("2. Details", 80, 240, 260, 264)])).withColumn("block_num", F.when(F.col("text").rlike("para|graph"), 90).otherwise(F.col("block_num")))
    assert {(r["zone"], r["margin_key"]) for r in layout.repeated_margins(own).collect()} == {("header", "acme report"), ("footer", "page #")}
    got = [(r["type"], r["level"], r["text"]) for r in layout.classify(layout.segments(own)).orderBy("page_num", "item_ord").collect()]
    assert got == [("heading", 1, "Quarterly Report"), ("heading", 2, "1. Overview"), ("paragraph", None, "This is a paragraph of text."), ("list_item", None, "first point"), ("list_item", None, "second point"), ("heading", 2, "2. Details")]
    text = layout.markdown(layout.classify(layout.segments(own))).first()["markdown"]
    assert text.startswith("# Quarterly Report\n\n## 1. Overview") and "- first point\n- second point" in text


def test_two_columns(spark):
    rows = [("Left one", 60, 200, 400, 224), ("Right one", 560, 200, 900, 224), ("Left two", 60, 300, 400, 324), ("Right two", 560, 300, 900, 324)]
    own = lines(spark, rows).withColumn("block_num", F.when(F.col("left") < 500, 1).otherwise(2))
    got = layout.segments(own).orderBy("item_ord").collect()
    assert [r["text"] for r in got] == ["Left one", "Left two", "Right one", "Right two"] and got[0]["column_count"] == 2


def test_table_from_words(spark):
    grid = [["Name", "Qty", "Price"], ["Apple", "3", "$5"], ["Banana", "8", "$9"]]
    rows = [(1, 1, c, 100 + 300 * j, 100 + 40 * i, 160 + 300 * j, 120 + 40 * i, 1000) for i, r in enumerate(grid) for j, c in enumerate(r)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, text string, left int, top int, right int, bottom int, page_width int")
    got = tables_.detect(df).first()
    assert got["rows"] == grid and got["table_id"] == "page_001_table_01"
    shown = spark.createDataFrame([(grid,)], "rows array<array<string>>").select(tables_.csv(F.col("rows")), tables_.html(F.col("rows")), tables_.markdown(F.col("rows"))).first()
    assert shown[0] == "Name,Qty,Price\r\nApple,3,$5\r\nBanana,8,$9\r\n" and "<th>Name</th>" in shown[1] and shown[2].splitlines()[1] == "| --- | --- | --- |"
    odd = spark.createDataFrame([([["a", "", "b"], ["", "", ""], ["c"]],), ([],)], "rows array<array<string>>").select(tables_.normalized(F.col("rows"))).collect()
    assert [r[0] for r in odd] == [[["a", "b"], ["c", ""]], []]


def test_words_to_lines_and_artifacts(spark):
    cols = "doc_id long, page_num int, word_ord int, text string, confidence double, left int, top int, right int, bottom int, block_num int, par_num int, line_num int, word_num int, source string, angle double"
    rows = [(1, 1, 0, "Hello", 90.0, 10, 10, 60, 30, 1, 1, 1, 1, "primary", 0.0), (1, 1, 1, "world", -1.0, 70, 12, 120, 30, 1, 1, 1, 2, "primary", 0.0), (1, 1, 2, "O", 40.0, 300, 300, 320, 320, 2, 1, 1, 1, "primary", 0.0), (1, 1, 3, "____", 40.0, 10, 400, 200, 410, 3, 1, 1, 1, "primary", 0.0)]
    df = spark.createDataFrame(rows, cols)
    judged = {r["text"]: r["rejected_reason"] for r in words.filter_artifacts(df).collect()}
    assert judged == {"Hello": None, "world": None, "O": "circle_like_graphic", "____": "table_or_shape_line"}
    first = words.lines(df).orderBy("block_num").first()
    assert (first["text"], first["confidence"], first["left"], first["right"]) == ("Hello world", 90.0, 10, 120)
    extra = spark.createDataFrame([(1, 1, 0, "Hello", 99.0, 10, 10, 60, 30, 9, 1, 1, 1, "sparse_fallback", 0.0), (1, 1, 1, "new", 80.0, 500, 10, 560, 30, 9, 1, 1, 2, "sparse_fallback", 0.0)], cols)
    merged = {(r["text"], r["confidence"]) for r in words.merge_passes(df, extra).collect()}
    assert merged == {("Hello", 99.0), ("world", -1.0), ("O", 40.0), ("____", 40.0), ("new", 80.0)}


def test_otsu(spark):
    counts = np.zeros(256, int)
    counts[[20, 25, 200, 210]] = [50, 60, 40, 30]
    df = spark.createDataFrame([(1, i, int(n)) for i, n in enumerate(counts)] + [(2, 0, 0)], "image_id long, bin int, n long")
    got = {r["image_id"]: r["threshold"] for r in words.otsu(df).collect()}
    assert got[1] == 25 and got[2] == 180


def test_chunks(spark):
    rows = [(1, 1, 0, "heading", 1, None, "Annual Report"), (1, 1, 1, "heading", 2, None, "Revenue Overview"), (1, 1, 2, "paragraph", None, None, "Revenue grew. " * 10), (1, 2, 0, "paragraph", None, None, "More text.")]
    items = spark.createDataFrame(rows, "doc_id long, page_num int, item_ord int, type string, level int, ordered boolean, text string")
    heads = {r["page_num"]: r["title_context"] for r in chunks.page_headings(items).collect()}
    assert heads[2] == "Annual Report > Revenue Overview"
    text = chunks.text_chunks(items, 220, 40)
    table = chunks.table_chunks(tables(spark, (2, [["Region", "Revenue", "Growth"], ["East", "5", "1%"]])), chunks.page_headings(items))
    got = chunks.numbered(text, table).orderBy("ord").collect()
    assert got[0]["chunk_id"] == "chunk_0001_text" and got[0]["title_context"] == "Annual Report > Revenue Overview" and got[-1]["chunk_id"].endswith("_table")
    assert "Header: Region, Revenue, Growth" in got[-1]["text"] and got[-1]["page_nums"] == [2]
    assert all(len(p) <= 100 for p in chunks.split_long("word " * 100, 100, 20)) and chunks.split_long("") == []


def test_evidence(spark):
    rows = [(1, 1, "chunk_text", "Contract amount is $120,000.00 in total.", [18], "Agreement"), (1, 2, "chunk_text", "Party A pays monthly.", [2], ""), (2, 1, "chunk_text", "Unrelated", [1], "")]
    found = evidence.units(spark.createDataFrame(rows, "doc_id long, ord int, unit_type string, text string, page_nums array<int>, title_context string"))
    asked = spark.createDataFrame([(1, "What is the total contract amount?"), (2, "zzzz qqqq"), (3, "")], "query_id long, query string")
    got = {r["query_id"]: r for r in evidence.answers(asked, evidence.top_units(asked, found)).collect()}
    assert (got[1]["status"], got[1]["answer"], got[1]["pages"]) == ("ok", "$120,000.00", [18]) or got[1]["pages"][-1] == 18
    assert got[2]["status"] == "insufficient_evidence" and got[3]["status"] == "error"


def test_charts(spark):
    own = tables(spark, (3, [["Region", "Revenue", "Growth"], ["East", "$100.00", "5%"], ["West", "$250.00", "7%"], ["North", "$90.00", "2%"]]))
    found = charts.points(own)
    sums = charts.series(found)
    assert [r["candidate_id"] for r in charts.candidates(own, found).collect()] == ["chart_page_003_table_01"]
    asked = spark.createDataFrame([(1, 1, "Which region has the highest revenue?"), (2, 5, "What is the total?")], "query_id long, doc_id long, query string")
    got = {r["query_id"]: r for r in charts.answer(asked, found, sums, charts.candidates(own, found)).collect()}
    assert "West" in got[1]["answer"] and got[1]["name"] == "Revenue" and got[2]["status"] == "insufficient_evidence"


def test_outline_and_summary(spark):
    toc = spark.createDataFrame([(1, 1, 1, "Service Agreement", 1), (1, 2, 2, "Scope", 1), (1, 3, 1, "Fees", 2)], "doc_id long, ord int, level int, title string, page_num int")
    assert [r["path"] for r in outline.from_contents(toc).orderBy("ord").collect()] == [["Service Agreement"], ["Service Agreement", "Scope"], ["Fees"]]
    pages = spark.createDataFrame([(1, 1, "word " * 300)], "doc_id long, page_num int, text string")
    got = outline.summaries(pages, toc.withColumn("rank", F.col("ord"))).first()
    assert len(got["summary"]) == 520 and got["topics"] == ["Service Agreement", "Scope", "Fees"]


def test_review(spark):
    own = lines(spark, ["Name: Alice", "Signature:", "Phone: 12"])
    found = spark.createDataFrame([(1, "name", "Alice", 1, "Name: Alice", "Alice"), (1, "phone", "12", 1, "Phone: 12", "12")], "doc_id long, field string, value string, page_num int, label string, raw_value string")
    reasons = {r["field"]: r["reason"] for r in review.suspicious_fields(found, own.select("doc_id", "page_num").distinct(), review.anchors(found, own)).collect()}
    assert reasons["phone"] == "field value pattern looks suspicious" and reasons["date"] == "important field is empty or missing" and "name" not in reasons
    boxes = spark.createDataFrame([(1, 1, i, 0, 0, 100, 100, f) for i, f in enumerate(["a", "a", "b"])], "doc_id long, page_num int, ord int, left int, top int, right int, bottom int, field string")
    assert review.dedupe(boxes).count() == 2
    signed = review.signature_regions(own, own.limit(0)).first()
    assert signed["label_text"] == "Signature:" and signed["right"] > 180 and signed["linked"] == 0


def test_workbench(spark):
    form = spark.createDataFrame([(1, "name", "A1ice Chen", 1, None)], "doc_id long, label string, value string, page_num int, confidence double")
    known = workbench.predicted_fields({"form": form, "contract": form.limit(0)})
    log = spark.createDataFrame([(1, "form:form.fields.name", 1, 1, "A1ice Chen", "Alice", ""), (1, "form:form.fields.name", 2, 1, "Alice", "Alice  Chen", None), (1, "", 3, 1, "", "", "")], "doc_id long, field_id string, batch_id long, ord long, old_value string, new_value string, review_status string")
    clean = workbench.sanitize(log)
    assert clean.count() == 2 and workbench.latest(clean).first()["new_value"] == "Alice Chen"
    assert workbench.apply(known, clean).first()["value"] == "Alice Chen"
    items = spark.createDataFrame([(1, "low_confidence_word", 1, f"w{i}", float(i % 80), "", "s") for i in range(200)], "doc_id long, type string, page_num int, text string, confidence double, field_path string, source string")
    got = workbench.queue(items)
    assert got.count() == 120 and got.orderBy("ord").first()["confidence"] == 1.0


def test_robustness(spark):
    grey = bytes(range(0, 240, 2)) * 40
    pages = spark.createDataFrame([(1, n, 40, 120, bytearray(grey)) for n in (1, 4, 9, 12)], "doc_id long, page_num int, height int, width int, grey binary")
    seen = robustness.visual_metrics(robustness.degraded_pages(pages))
    assert seen.count() == 21 and {r["page_num"] for r in seen.select("page_num").distinct().collect()} == {1, 4, 9}  # the first three, whatever their numbers
    seen = seen.filter("page_num = 1")
    flat = np.full((400, 600), 255, dtype=np.uint8)
    assert all(robustness.degrade(flat, v).min() >= 250 for v in ("skew", "curved", "blur"))  # what comes in from outside is white
    page = flat.copy()
    page[100:110, 60:540] = 0
    rows = lambda v: np.flatnonzero((robustness.degrade(page, v) < 128).any(axis=1))
    assert (len(rows("blur")), len(rows("shadow"))) == (10, 10) and np.ptp(rows("skew")) > 25
    assert np.ptp(rows("curved")) > 12
    base = seen.filter("variant = 'baseline'").select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("contrast", "edge", "brightness")])
    risks = spark.range(1).select(F.inline(robustness.variants()))
    own = seen.join(risks, "variant").join(base, "doc_id").select("doc_id", "variant", *robustness.vocab.LAYERS, *[f"b_{c}" for c in ("contrast", "edge", "brightness")], *[F.col(c).alias(f"d_{c}") for c in ("contrast", "edge", "brightness")])
    out = robustness.report(robustness.proxy_scores(own))
    assert out.count() == 24 and out.filter("is_weakest").count() == 6 and out.filter("score < 0 or score > 1").isEmpty()


def test_copilot(spark):
    """A mixed bundle whose stages all ran, with something to review; then without the last two."""
    full = {c: 1 for c in copilot.COUNTS} | {"doc_id": 1, "label": "invoice", "confidence": 0.9, "summary": "Invoice of Acme", "total": 27.5, "tax": 2.5, "effective_date": "2026-05-01", "end_date": None, "detected_bundle": True, "most_fragile_layer": "ocr"}
    kind = ", ".join(f"{k} {'long' if k == 'doc_id' else 'boolean' if k == 'detected_bundle' else 'double' if k in ('confidence', 'total', 'tax') else 'int' if k in copilot.COUNTS else 'string'}" for k in full)
    rows = [full, full | {"doc_id": 2, "variant_count": None}, full | {"doc_id": 3, "signature_count": 0, "handwriting_count": None, "suspicious_count": 0, "low_confidence_words": 0, "segment_count": None}]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    found = copilot.stages(docs)
    got = {r["doc_id"]: r for r in copilot.readiness(found).collect()}
    assert found.count() == 24 and [got[i]["readiness"] for i in (1, 2, 3)] == ["ready_with_review", "partial", "ready"]
    assert got[1]["review_stages"] == ["human_review"] and got[2]["pending_stages"] == ["robustness"] and (got[1]["score"], got[3]["score"]) == (1.0, 0.875)
    assert copilot.markdown(docs, found).filter("doc_id = 1").first()["markdown"].startswith("# Invoice 1")
    asked = docs.select(copilot.questions()).first()[0]
    assert "总金额是多少？" in asked and len(asked) == 8
    facts = spark.createDataFrame([(1, "form", "name", "A", 1), (1, "form", "name", "Z", 0), (1, "receipt_invoice", "items", "x", 0), (1, "contract", "end_date", " ", 0)], "doc_id long, part string, label string, value string, ord int")
    assert copilot.key_facts(facts).first()["facts"] == {"form.name": "A"}


def test_text_functions(spark):
    rows = [("　a  b　", None), ("STRASSE ß", None), ("$1,234.50 and CNY 5", None), ("2026年4月28日", None), ("13/45/2026", None)]
    got = spark.createDataFrame(rows, "t string, x string").select(T.normalize(F.col("t")), T.canonical(F.col("t")), T.money_values(F.col("t")), T.iso_date(F.col("t")), T.normalize(F.col("x"))).collect()
    assert got[0][0] == "a b" and got[1][1] == "strasse ss" and got[2][2] == [1234.5, 5.0] and got[3][3] == "2026-04-28" and got[4][3] is None and got[0][4] == ""
    rounds = spark.createDataFrame([(2.675,), (1.005,), (-0.125,)], "x double").select(T.rounded(F.col("x"), 2)).collect()
    assert [r[0] for r in rounds] == [round(2.675, 2), round(1.005, 2), round(-0.125, 2)]


def test_folds_of_nothing_and_null_keys(spark):
    from foliant.functions.folds import fold_groups

    rows = spark.createDataFrame([(None, 2), (None, 1), (1, 5), (2, 4), (2, 3)], "k long, v int")
    got = fold_groups(rows.repartition(5), ["k"], ["v"], lambda g: [(g[0]["k"], [r["v"] for r in g])], "k long, vs array<int>")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, [5]), (2, [3, 4]), (None, [1, 2])], key=str)
    assert fold_groups(rows.limit(0), ["k"], ["v"], lambda g: [], "k long").count() == 0
    empty = lines(spark, ["x"]).limit(0)
    assert layout.classify(layout.segments(empty)).count() == 0 and layout.analyze(empty)[1].count() == 0


def test_bundle_pages_from_their_text(spark):
    rows = [(1, 1, ["Tax Invoice", "Invoice No: 7", "Total $5.00", "Tax $1.00"], 0, 0, 1), (1, 2, ["plain words"], 0, 0, 0), (1, 3, ["Application Form", "Name: A", "Date: B", "Phone: C"], 0, 0, 0)]
    pages = spark.createDataFrame(rows, "doc_id long, page_num int, lines array<string>, heading_count int, paragraph_count int, item_table_count int")
    found = bundles.classify(pages)
    got = {r["page_num"]: r for r in found.collect()}
    assert [got[i]["label"] for i in (1, 2, 3)] == ["invoice", "report", "form"] and got[1]["hits"] > 0 and got[2]["hits"] == 0 and got[3]["start_score"] >= 4.0
    parts = [(r["start_page"], r["end_page"], r["label"]) for r in bundles.segments(bundles.split(found)).orderBy("segment").collect()]
    assert parts == [(1, 2, "report"), (3, 3, "form")]  # one page each: the surer label


def test_long_texts_split_where_the_rule_says():
    """Against the rule written out: the last separator in the later part of a window, else the window's end."""
    import random

    rng = random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choice("ab.;。") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 40)))
        want, at = [], 0
        while at < len(text):
            window = text[at : at + 100]
            end = at + len(window)
            if end < len(text):
                best = max(i for i, c in [(-1, "")] + [(i, c) for i, c in enumerate(window) if c in "。.；; "])
                end = at + best + 1 if best > 45 else end
            want += [text[at:end].strip()]
            if end >= len(text):
                break
            at = max(end - 20, at + 1)
        assert chunks.split_long(text, 100, 20) == [w for w in want if w]


def test_column_bands_touch_and_merge(spark):
    """Cells of one column at shifting places are one band; far ones are two."""
    cell = lambda x0, x1: {"left": x0, "right": x1, "text": "t"}
    rows = [{"cells": [cell(100, 160), cell(400, 460)]}, {"cells": [cell(120, 190), cell(430, 500)]}, {"cells": [cell(185, 230), cell(480, 520)]}]
    assert [(b["left"], b["right"]) for b in tables_._columns(rows, 20.0)] == [(100, 230), (400, 520)]
    assert tables_._columns([], 20.0) == []
