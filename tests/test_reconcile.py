"""Expected values of the reconciliation operators."""

import random

import pytest
from pyspark.sql import functions as F

from docrecon.functions import fuzzy, norm
from docrecon.operators import corpus, decisions, link, stages
from docrecon.settings import Settings
from docrecon.sources import runs, text, workbook

ROOT = "/tree"
FOLDER = "/tree/FY 22-23/Payments/Kotak/Sep-2022/24-Sep-2022/Apex Business Consultants Pvt Ltd/"
INVOICE = "TAX INVOICE\nApex Business Consultants Private Limited\nGSTIN: 27AAACA1234B1Z5\nInvoice No: APEX/22-23/003\nInvoice Date: 06-Sept-2022\nHSN/SAC 9983\nTaxable Value\nRs. 1,99,866.89\nTotal Invoice Value Rs. 2,35,842.93\nBill To:\nHarbour Foods\nGSTIN 29AAACH9876K1ZQ"


def process(spark, rows):
    return stages.process(spark.createDataFrame(rows, "path string, text string"), Settings(root=ROOT))


def codes(row):
    return [f["code"] for f in row["flags"]]


def test_standard_invoice(spark):
    row = process(spark, [(FOLDER + "Invoice_APEX-22-23-003.pdf", INVOICE)]).first()
    assert (row["doc_type"], row["invoice_id"], row["invoice_no_content"]) == ("invoice", "APEX-22-23-003", "APEX/22-23/003")
    assert (row["vendor_gstin"], row["bill_to_gstin"], row["bill_to_name"]) == ("27AAACA1234B1Z5", "29AAACH9876K1ZQ", "Harbour Foods")
    assert (row["invoice_date"], row["taxable_value"], row["total_value"], row["confidence"], codes(row)) == ("2022-09-06", 199866.89, 235842.93, 1.0, [])
    assert (row["fy"], row["bank"], row["company"]) == ("FY 22-23", "Kotak", "Apex Business Consultants Pvt Ltd")


def test_types_and_mismatched_names(spark):
    rows = process(spark, [
        (FOLDER + "Invoice_1.pdf", "PURCHASE / EXPENSE APPROVAL\nInvoice No: X1"), (FOLDER + "Approval_2.pdf", INVOICE), (FOLDER + "Invoice_3.pdf", ""), (FOLDER + "note.pdf", "hello"), (FOLDER + "r.pdf", "GSTR-2A"),
        ("/tree/FY 22-23/Payments/Other/x.pdf", INVOICE),
    ]).orderBy("path").collect()
    by = {r["filename"]: r for r in rows}
    assert {k: r["doc_type"] for k, r in by.items()} == {"Invoice_1.pdf": "approval", "Approval_2.pdf": "invoice", "Invoice_3.pdf": "unknown", "note.pdf": "other", "r.pdf": "gstr2a"}
    assert "filename_content_mismatch" in codes(by["Invoice_1.pdf"]) and "filename_content_mismatch" in codes(by["Approval_2.pdf"])
    assert "no_text" in codes(by["Invoice_3.pdf"]) and by["note.pdf"]["confidence"] == 0.0


@pytest.mark.parametrize("kind, gone", [("ocr", "Taxable Value\nRs. 1,99,866.89\n"), ("text", "GSTIN")])
def test_confidence_just_below_the_threshold(spark, kind, gone):
    body = INVOICE.replace("Taxable Value\nRs. 1,99,866.89\n", "") if gone != "GSTIN" else INVOICE.replace("Taxable Value\nRs. 1,99,866.89\n", "").replace("27AAACA1234B1Z5", "").replace("29AAACH9876K1ZQ", "")
    df = spark.createDataFrame([(FOLDER + "APEX-22-23-003.pdf", body, kind)], "path string, text string, source string")
    row = stages.process(df, Settings(root=ROOT)).first()
    assert row["confidence"] == 0.8 and codes(row) == ["low_confidence"]


def test_number_pattern_has_no_end_of_word(spark):
    row = process(spark, [(FOLDER + "APEX-1.pdf", INVOICE.replace("TAX INVOICE\n", "TAX INVOICE\nNova Traders\n"))]).first()
    assert row["invoice_no_content"] == "va" and "id_mismatch" in codes(row)


def test_id_that_ends_at_the_marker(spark):
    row = process(spark, [(FOLDER + "a.pdf", INVOICE.replace("27AAACA1234B1Z5", "27AAACA1234B1Z5Bill To"))]).first()
    assert row["vendor_gstin"] == "29AAACH9876K1ZQ"


def test_vendor_layout(spark):
    body = "TAX INVOICE\nZephyr Logistics\nGSTIN: 27AAACA1234B1Z5\nBill No: ZL/9\nDated: 05/09/2022\nTaxable: INR 1,00,000.00\nAmount Payable: ₹ 1,18,000.00"
    row = process(spark, [(FOLDER + "ZL-9.pdf", body)]).first()
    assert (row["invoice_no_content"], row["invoice_date"], row["taxable_value"], row["total_value"], row["layouts"]) == ("ZL/9", "2022-09-05", 100000.0, 118000.0, ["zephyr-logistics"])


def test_similarities(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc 1", k=rng.randrange(0, n))), "".join(rng.choices("abc 1", k=rng.randrange(0, n)))) for n in (6, 20, 80) for _ in range(15)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.lcs(F.col("a"), F.col("b")).alias("n"))
    assert all(r["n"] == plain(r["a"], r["b"]) for r in df.collect())
    one = lambda f, a, b: round(spark.range(1).select(f(F.lit(a), F.lit(b)).alias("x")).first()["x"], 1)
    assert (one(fuzzy.ratio, "apx", "apex"), one(fuzzy.ratio, "busines", "business"), one(fuzzy.ratio, "003", "004")) == (85.7, 93.3, 66.7)
    assert one(fuzzy.partial_ratio, "consul", "consultants") == 100.0 and one(fuzzy.token_set_ratio, "apex traders", "traders apex north") == 100.0


def test_normalisers(spark):
    row = spark.range(1).select(norm.company_name(F.lit("Apex & Sons (India) Pvt. Ltd.")).alias("a"), norm.file_token(F.lit(" A/B C?_ ")).alias("b"), norm.money(F.lit("1,23,456.78")).alias("c"), norm.day_first(F.lit("6-Sept-22")).alias("d"), norm.day_first(F.lit("31-Feb-2022")).alias("e"), norm.supplier_key(F.lit("  Ab   C ")).alias("f")).first()
    assert tuple(row) == ("apex and sons", "A-B-C", 123456.78, "2022-09-06", None, "ab c")


ROWS = "row int, gstin string, invoice_no string, invoice_date string, supplier string, value string, existing_ref string"
DOCS = "doc_id string, doc_type string, invoice_id string, invoice_no_content string, vendor_gstin string, confidence double"
G1, G2 = "27AAACA1234B1Z5", "29AAACH9876K1ZQ"


def plan_of(spark, rows, docs, **more):
    made = spark.createDataFrame([(r, g, n, "", s, "", "") for r, g, n, s in rows], ROWS)
    return {r["row"]: r for r in link.match(made, spark.createDataFrame(docs, DOCS), **more).collect()}


def test_matching(spark):
    docs = [("a", "invoice", "INV-1", None, G1, 0.9), ("b", "invoice", "junk", "INV/2", G1, 0.9), ("c", "invoice", "INV-3", None, G1, 0.5), ("d", "invoice", "INV-3", None, G1, 0.5), ("e", "invoice", "INV-4", None, G1, 0.9), ("f", "invoice", "INV-4", None, G2, 0.9), ("g", "other", "INV-5", None, G1, 0.9)]
    rows = [(2, G1.lower(), "inv/1", "S"), (3, G1, "INV 2", "S"), (4, G1, "INV3", "S"), (5, "", "INV4", "Lost Ltd"), (6, G1, "INV5", "Lost Ltd"), (7, G2, "INV1", "S"), (8, G1, "", "S")]
    plan = plan_of(spark, rows, docs)
    assert {r: (p["status"], p["doc_id"]) for r, p in plan.items()} == {2: ("matched", "a"), 3: ("matched", "b"), 4: ("matched", "d"), 5: ("ambiguous", None), 6: ("not_found", None), 7: ("matched", "a"), 8: ("not_found", None)}
    assert plan[4]["candidates"] == ["c", "d"] and plan[5]["candidates"] == ["e", "f"]
    manual = spark.createDataFrame([(5, "e"), (6, "g")], link.MANUAL)
    missing, skipped = spark.createDataFrame([(8,)], "row int"), spark.createDataFrame([(" lost  LTD",)], "supplier string")
    plan = plan_of(spark, rows, docs, manual=manual, missing=missing, skipped=skipped)
    assert {r: plan[r]["status"] for r in (5, 6, 8)} == {5: "matched", 6: "skipped", 8: "manual_not_found"}


def test_decisions(spark):
    log = spark.createDataFrame([(1, "bind", "2", "x"), (2, "bind", "2", None), (3, "skip", " A  b", None), (4, "skip", "a B", "off"), (5, "reject", "x", None), (6, "promote", "x", None)], decisions.SCHEMA)
    now = decisions.latest(log)
    assert decisions.manual_links(now).count() == 0 and decisions.skipped_suppliers(now).count() == 0
    docs = process(spark, [(FOLDER + "note.pdf", "hello")]).withColumn("doc_id", F.lit("x"))
    assert decisions.overlay(docs, now).select("doc_type", "reviewed").first() == ("invoice", True)


def test_corpus_passes(spark):
    other = FOLDER.replace("Apex Business Consultants Pvt Ltd", "Harbour Foods")
    docs = process(spark, [(FOLDER + "Invoice_1.pdf", INVOICE), (FOLDER + "Invoice_2.pdf", INVOICE), (other + "Invoice_1.pdf", INVOICE)])
    by = {r["path"]: codes(r) for r in corpus.corpus_passes(docs).collect()}
    assert "vendor_folder_variant" in by[other + "Invoice_1.pdf"] and "duplicate_id" in by[FOLDER + "Invoice_1.pdf"] and "duplicate_id" not in by[FOLDER + "Invoice_2.pdf"]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    head = ["GSTIN of Supplier", "Supplier Trade/Legal Name", "Invoice Number", "Invoice Date", "Total Invoice Value", "Invoice Ref"]
    workbook.write_xlsx(path, {"x": [["y"]], workbook.SHEET: [head, [G1, "Apex & Co", "INV/1", "2022-09-06", 12.5, "SKIPPED"], ["", "", "", "", "", ""], [G2, "B", "2", "", "", "kept.pdf"]]})
    got = [tuple(r) for r in workbook.read_return(spark, path).orderBy("row").collect()]
    assert got == [(2, G1, "INV/1", "2022-09-06", "Apex & Co", "12.5", ""), (4, G2, "2", "", "B", "", "kept.pdf")]


def test_runs_and_ledger(spark, tmp_path):
    run = runs.new_run(str(tmp_path), "/tree", "FY 22-23")
    assert runs.find_resumable(str(tmp_path), "/tree", "FY 22-23") is None
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "source_key string, seq long, v string").write.parquet(run + "/ledger")
    assert runs.find_resumable(str(tmp_path), "/tree", "FY 22-23") == run and runs.describe(spark, run)["done"] == 2
    last = {r["source_key"]: (r["v"], r["position"]) for r in runs.last_write(spark.read.parquet(run + "/ledger")).collect()}
    assert last == {"a": ("y", 1), "b": ("z", 2)}
    runs.write_meta(run, complete=True)
    assert runs.find_resumable(str(tmp_path), "/tree", "FY 22-23") is None and runs.read_meta(run)["root"] == "/tree"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from docrecon.streaming import ingest

    tree = tmp_path / "tree/FY 22-23/Payments/Kotak/Sep-2022/24-Sep-2022/Apex"
    tree.mkdir(parents=True)
    (tree / "Invoice_1.pdf").write_text(INVOICE)
    (tree / "bad.PDF").write_bytes(b"\xff")
    run = runs.new_run(str(tmp_path / "out"), str(tmp_path / "tree"))
    settings = Settings(root=str(tmp_path / "tree"))
    read = lambda content, page: (content.decode(), "text")
    assert ingest.scan(spark, run, str(tmp_path / "tree"), read, settings)
    (tree / "Invoice_2.pdf").write_text(INVOICE)
    assert ingest.scan(spark, run, str(tmp_path / "tree"), read, settings)
    ledger = spark.read.parquet(run + "/ledger")
    assert ledger.count() == 3 and ledger.filter("error IS NOT NULL").count() == 1


def test_otsu():
    assert text.otsu_threshold([10] * 50 + [200] * 50) in range(10, 200)
