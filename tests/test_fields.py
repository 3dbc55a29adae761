"""Forms, receipts, contracts and questions about fields."""

from foliant.operators import fields, forms, receipts
from foliant.sources import adapters
from tests.helpers import lines, tables


def test_inline_form(spark):
    text = ["Full Name: Alice Chen", "Registration Date: 2026/04/28", "Address: 88 West Lake Road, Hangzhou", "Phone: 138-0013-8000 / 13800138000", "E-mail: alice@example.com", "ID Number: 330102199001011234", "Gender: Female", "☑ Newsletter ☐ SMS"]
    row = forms.wide(forms.extract(lines(spark, text))).first()
    assert (row["name"], row["date"], row["address"]) == ("Alice Chen", "2026-04-28", "88 West Lake Road, Hangzhou")
    assert (row["phone"], row["email"], row["id_number"], row["gender"], row["field_count"]) == ("13800138000", "alice@example.com", "330102199001011234", "female", 7)
    boxes = {(r["label"], r["checked"]) for r in forms.checkboxes(lines(spark, text)).collect()}
    assert boxes == {("Newsletter", True), ("SMS", False)}


def test_spatial_form(spark):
    rows = [("姓名", 80, 100, 130, 124), ("Alice Chen", 300, 100, 420, 124), ("Address", 80, 200, 160, 224), ("Room 301, Building A", 90, 240, 320, 264), ("88 West Lake Road", 92, 272, 300, 296), ("☑ Male ☐ Female", 80, 500, 300, 524)]
    found = {r["field"]: (r["value"], r["source"]) for r in forms.extract(lines(spark, rows)).collect()}
    assert found == {"name": ("Alice Chen", "right_neighbor"), "address": ("Room 301, Building A 88 West Lake Road", "below_neighbor"), "gender": ("male", "checkbox")}


def test_receipt_lines(spark):
    own = lines(spark, ["Blue Cafe", "Date: 04/28/2026", "Latte $4.50", "Bagel $3.20", "Tax $0.70", "Total $8.40", "Thank you"])
    row = receipts.extract(own).first()
    assert (row["vendor"], row["date"], row["tax"], row["total"], row["currency"]) == ("Blue Cafe", "2026-04-28", 0.7, 8.4, "USD")
    assert [(r["description"], r["amount"]) for r in receipts.line_items(own).orderBy("line_ord").collect()] == [("Latte", 4.5), ("Bagel", 3.2)]


def test_best_item_table(spark):
    found = receipts.best_tables(tables(spark, (1, [["a", "b"], ["1", "2"]]), (1, [["Item", "Qty", "Price", "Amount"], ["USB Cable", "2", "$5.00", "$10.00"]]))).collect()
    assert [r["table_id"] for r in found] == ["page_001_table_02"]


def test_contract(spark):
    text = ["Consulting Service Agreement", "Contract No: CTA-2026-001", "Party A: Acme Corporation", "Party B: Bright Future LLC", "Signing Date: 2026/04/20", "Effective Date: 2026-05-01", "End Date: 2027-04-30", "Contract Amount: $120,000.00"]
    row = fields.contracts(lines(spark, text)).first()
    assert row["is_contract"]
    got = [row[c] for c in ("contract_title", "contract_number", "party_a", "party_b", "signing_date", "effective_date", "end_date", "total_amount")]
    assert got == ["Consulting Service Agreement", "CTA-2026-001", "Acme Corporation", "Bright Future LLC", "2026-04-20", "2026-05-01", "2027-04-30", "$120,000.00"]
    plain = fields.contracts(lines(spark, ["A walk in the park", "on a sunny day"])).first()
    assert not plain["is_contract"] and plain["party_a"] == ""


def test_questions(spark):
    own = lines(spark, ["Store Ltd", "Start Date: 2026-05-01", "End Date: 2027-04-30", "Total: $27.50"])
    asked = spark.createDataFrame([(1, 1, "总金额是多少"), (2, 1, "合同起始日是哪天"), (3, 1, ""), (4, 9, "total amount")], "query_id long, doc_id long, query string")
    got = {r["query_id"]: (r["status"], r["answer"]) for r in fields.answer(asked, fields.index(fields.line_candidates(own))).collect()}
    assert got == {1: ("ok", "$27.50"), 2: ("ok", "2026-05-01"), 3: ("invalid_query", ""), 4: ("no_answer", "")}


def test_candidates_of_other_sources(spark):
    own = lines(spark, ["Full Name: Bo Li", "Invoice No: INV-0042", "Grand Total $12.00"])
    every = fields.index(fields.line_candidates(own), fields.form_candidates(forms.extract(own)), fields.receipt_candidates(receipts.extract(own)))
    top = {r["field_key"]: (r["value"], r["source"]) for r in every.orderBy("ord", ascending=False).collect()}
    assert top["name"] == ("Bo Li", "form_result") and top["total_amount"][1] == "receipt_invoice_result"


def test_customer_forms(spark, sf):
    found = forms.extract(adapters.customer_lines(adapters.table(spark, sf, "customer")))
    assert found.filter("field = 'email' and value != concat('c', doc_id, '@example.com')").isEmpty()
