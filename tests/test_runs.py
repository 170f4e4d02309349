"""Pages, providers, run state, control of a scan, workbooks and the command line."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from docrecon import __main__ as cli
from docrecon import api
from docrecon.operators import decisions, link, stages, views
from docrecon.settings import Settings
from docrecon.sources import lease, pages, runs, text, tree, workbook
from docrecon.streaming import control, ingest

BODY = "TAX INVOICE\nApex Traders\nGSTIN: 27AAACA1234B1Z5\nInvoice No: INV/{n}\nInvoice Date: 06-Sep-2022\nTaxable Value Rs. 100.00\nTotal Invoice Value Rs. 118.00\n"
DAY = "FY 22-23/Payments/Kotak/Sep-2022/24-Sep-2022/Apex Traders"


def read(content, page):  # for the command line, by name
    return content.decode(), "text"


def reader():
    return lambda content, page: (content.decode(), "text")


def make_tree(tmp_path, n=3):
    folder = tmp_path / "tree" / DAY
    folder.mkdir(parents=True)
    for k in range(n):
        (folder / f"Invoice_INV-{k}.pdf").write_text(BODY.format(n=k))
    return str(tmp_path / "tree"), folder


def test_pages_are_counted_and_exploded(spark):
    two = b"%PDF-1.4 1 0 obj <</Type /Pages /Kids [2 0 R] /Count 2>> 2 0 obj <</Type/Page>> 3 0 obj <</Type/Page>>"
    assert pages.count_pages(two) == 2 and pages.count_pages(b"junk") is None and pages.count_pages(b"%PDF-1 <</Type /Page>>") == 1
    files = spark.createDataFrame([("/a.pdf", "a.pdf", bytearray(two)), ("/b.pdf", "b.pdf", bytearray(b"x"))], "path string, filename string, content binary")
    got = {r["source_key"]: r["page_index"] for r in pages.walk_pages(files).collect()}
    assert got == {"local:/a.pdf#page=0": 0, "local:/a.pdf#page=1": 1, "local:/b.pdf": None}
    assert [r["page_index"] for r in pages.walk_pages(files, Settings(explode_pages=False)).collect()] == [None, None]


def test_layers_of_text(spark):
    long = "a page with more than twenty characters"
    native = lambda content: [long, "  thin  "]
    cheap, careful = (lambda c, k: ("cheap", 50.0)), (lambda c, k: ("careful", 54.0))
    run = pages.layered(native, pages.escalating(cheap, careful))
    assert run(b"", None) == (long + "\ncareful", "ocr", [("low_ocr_confidence", "1 page(s) OCR'd below the confidence floor")])
    assert run(b"", 0) == (long, "text", []) and run(b"", 2)[1] == "none" and run(b"", 2)[2][0][0] == "page_out_of_range"
    assert pages.layered(native)(b"", 1) == ("thin", "text", [])

    def bad(content, page):
        raise ValueError("no good")

    files = spark.createDataFrame([(f"/t/{DAY}/a.pdf", "a.pdf", bytearray(b"1"), 2)], "path string, filename string, content binary, page_index int")
    flags = lambda provider: [(x["code"], x["message"], x["severity"]) for x in stages.process(text.with_text(files, provider), Settings(root="/t")).first()["flags"]]
    assert flags(run) == [("page_out_of_range", "page 3 of 2 (source file changed since discovery?)", "warn"), ("no_text", "no extractable text even after OCR", "warn")]
    assert flags(bad) == [("stage_error", "extract failed: no good", "error")]


def test_walk_lists_what_the_file_source_hides(spark, tmp_path):
    root, folder = make_tree(tmp_path, 1)
    (folder / "_draft.PDF").write_text("x")
    (folder / ".hid.pdf").write_text("x")
    (folder / "notes.txt").write_text("x")
    other = tmp_path / "tree/deep/FY 21-22"
    other.mkdir(parents=True)
    (other / "old.pdf").write_text("x")
    names = lambda s: {r["filename"] for r in tree.walk(spark, root, s).collect()}
    assert names(Settings()) == {"Invoice_INV-0.pdf", "_draft.PDF", ".hid.pdf", "old.pdf"}
    assert names(Settings(fy_scope="fy 22-23")) == {"Invoice_INV-0.pdf", "_draft.PDF", ".hid.pdf"}
    assert tree.walk(spark, str(tmp_path / "none")).count() == 0


def test_run_state(spark, tmp_path):
    run = runs.new_run(str(tmp_path), "/tree")
    one, two = spark.range(1).withColumn("source_key", F.lit("a")), spark.range(2).withColumn("source_key", F.lit("b"))
    assert api.load(spark, run) is None and api.load_plan(spark, run) is None
    for df in (one, two, one):
        api.save(df, run)
        assert api.load(spark, run).count() == df.count()
    assert len([p for p in (tmp_path / run).iterdir() if p.name.startswith("snapshot-")]) == 2
    with lease.Lease(run, "export"):
        with pytest.raises(lease.Busy):
            api.decide(spark, run, "approve", "a")
        with pytest.raises(lease.Busy), lease.Lease(run, "scan"):
            pass
    assert api.decide(spark, run, "confirm", "a", json.dumps({"total_value": "12x", "taxable_value": "1,000.5"})) == ["total_value"]
    numbers = []

    def edit():
        with lease.edited(run, "n") as number:
            numbers.append(number)

    threads = [threading.Thread(target=edit) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(numbers) == list(range(1, 9))
    book = tmp_path / "r.xlsx"
    book.write_bytes(b"x")
    kept = runs.keep_workbook(run, str(book))
    book.unlink()
    assert runs.find_workbook(run) == kept
    runs.write_meta(run, gstr_path="/moved/r.xlsx")
    assert runs.find_workbook(run) == kept


def test_linked_workbook(spark, tmp_path):
    root, _ = make_tree(tmp_path)
    run, settings = runs.new_run(str(tmp_path / "out"), root), Settings(root=root)
    ingest.scan(spark, run, root, reader(), settings)
    docs = api.load(spark, run)
    book = str(tmp_path / "ret.xlsx")
    head = ["GSTIN of Supplier", "Trade Name", "Invoice Number", "Invoice Date", "Invoice Value"]
    rows = [["27AAACA1234B1Z5", "Apex", f"INV/{k}", "", ""] for k in (0, 1, 9)] + [["27AAACA1234B1Z5", "Apex", "INV/0", "", ""]]
    workbook.write_xlsx(book, {workbook.SHEET: [head, *rows], "Other": [["kept", 1]]})
    (tmp_path / "tree" / DAY / "Invoice_INV-1.pdf").unlink()  # its copy fails
    out, plan = api.link_workbook(spark, run, book, docs, decisions.latest(spark.createDataFrame([], decisions.SCHEMA)))
    sheet = {n: c for n, c in workbook.read_sheet(out)}
    assert sheet[1][5] == "Invoice Ref" and [sheet[r][5] for r in (2, 3, 4, 5)] == ["27AAACA1234B1Z5__INV-0.pdf", "COPY FAILED", "NOT FOUND", "27AAACA1234B1Z5__INV-0-dup.pdf"]
    report = [list(c.values()) for _, c in workbook.read_sheet(out, workbook.REPORT_SHEET)]
    assert ["matched", "2"] in report and ["copy_failed", "1"] in report and ["source_template", "ret.xlsx"] in report and [link.SECTIONS["not_found"]] in report
    assert list(workbook.read_sheet(out, "Other")) == [(1, {0: "kept", 1: "1"})]
    assert sorted(p.name for p in (tmp_path / run / "linked").iterdir() if not p.name.endswith(".part")) == ["27AAACA1234B1Z5__INV-0-dup.pdf", "27AAACA1234B1Z5__INV-0.pdf"]
    assert api.load_plan(spark, run).count() == 4 and link.unmatched_by_supplier(plan).collect() == [("Apex", 1)]
    again = str(tmp_path / "again.xlsx")
    workbook.fill_workbook(out, again, workbook.SHEET, "Invoice Ref", {2: "x"}, {})
    assert dict(workbook.read_sheet(again))[2][5] == "x" and max(dict(workbook.read_sheet(again))[1]) == 5


def test_views_and_flagged_copies(spark, tmp_path):
    root, folder = make_tree(tmp_path)
    (folder / "note.pdf").write_text("Meeting notes")
    run = runs.new_run(str(tmp_path / "out"), root)
    ingest.scan(spark, run, root, reader(), Settings(root=root))
    docs = api.load(spark, run)
    low = docs.withColumn("flags", F.when(F.col("filename") == "note.pdf", F.expr("array(named_struct('code', 'x', 'message', 'y', 'severity', 'warn'))")).otherwise(F.array().cast(stages.FLAG.join(["array<", ">"]))))
    out = api.copy_flagged(low, str(tmp_path / "review"))
    assert [r["filename"] for r in out.filter("review_pdf_path IS NOT NULL").collect()] == ["note.pdf"] and len(list((tmp_path / "review").iterdir())) == 1
    (folder / "note.pdf").unlink()
    failed = api.copy_flagged(low, str(tmp_path / "review2")).filter("size(events) > 0").collect()
    assert [e["action"] for r in failed for e in r["events"]] == ["copy_failed"]
    assert views.tallies(low).first().asDict() == {"pdfs": 4, "invoices": 3, "approvals": 0, "ocr": 0, "flagged": 1, "errors": 0}
    assert len(views.hits(docs).columns) == 16 and views.by_id(docs, views.hits(docs).first()["id"]).count() == 1
    assert [r["filename"] for r in views.by_path(docs).collect()] == [f"Invoice_INV-{k}.pdf" for k in range(3)] + ["note.pdf"]
    events = views.stage_events(docs).filter("filename = 'note.pdf'").first()["events"]
    assert [e["action"] for e in events] == ["extracted", "classified"]
    made, metrics = views.timed(docs.select("path", "filename", "text", "source"), Settings(root=root))
    assert made.count() == 4 and [(r["stage"], r["docs"], r["errors"]) for r in metrics.collect()] == [(s.__name__, 4, 0) for s in stages.STAGES]


def test_stage_events_stay_in_the_ledger(spark, tmp_path):
    root, _ = make_tree(tmp_path, 1)
    run = runs.new_run(str(tmp_path / "out"), root)
    ingest.scan(spark, run, root, reader(), Settings(root=root))
    docs = api.load(spark, run)
    kept = [r["events"] for r in ingest.ledger(spark, run).collect()]
    assert "events" not in docs.columns and [r["events"] for r in views.stage_events(docs).collect()] == kept
    api.save(docs, run)  # a snapshot and the ledger have the same columns
    assert api.load(spark, run).columns == docs.columns


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root, _ = make_tree(tmp_path, 1)
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    out = ["--out", str(tmp_path / "out")]
    cli.main([*out, "scan", "--root", root, "--provider", "tests.test_runs:read", "--quiet"])
    cli.main([*out, "years", "--root", root])
    cli.main([*out, "runs"])
    cli.main([*out, "export"])
    said = capsys.readouterr().out
    assert " complete" in said and "FY 22-23" in said and "export" in said
    with pytest.raises(SystemExit, match="FY 22-23"):
        cli.main([*out, "scan", "--root", root, "--fy", "FY 23-24", "--provider", "tests.test_runs:read", "--quiet"])
    cli.main([*out, "gate", "stop"])
    assert control.Gate(runs.latest_run(str(tmp_path / "out")) + "/gate").state == "stopped"
