"""Search from the stored index against search of the documents themselves."""

from docrecon.operators import finder, index

DOC = "doc_id string, rel_parts array<string>, company string, month string, date_folder string, fy string, invoice_id string, invoice_no_content string, vendor_name_pdf string, vendor_gstin string, doc_type string, hidden boolean"


def doc(i, name, kind="invoice", hidden=False):
    return (f"d{i:03d}", ["FY 22-23", name, f"Invoice_{i}.pdf"], name, None, None, "FY 22-23", f"INV-{i:04d}", None, name, None, kind, hidden)


def test_the_index_answers_as_the_documents_do(spark, tmp_path):
    names = ["Apex Traders", "Apex Consultants", "Blue Ridge Stores", "Delta", "Apx Trader"]
    first = [doc(i, names[i % 5], "invoice" if i % 4 else "other", i % 9 == 0) for i in range(60)]
    later = [doc(7, "Omega Harbour"), *(doc(i, names[i % 3]) for i in range(60, 80))]  # one document was edited
    path, make = str(tmp_path / "index"), lambda rows: spark.createDataFrame(rows, DOC)
    index.add(make(first), path)
    for _ in range(2):  # a batch that is written again replaces itself
        index.add(make(later), path, 1)
    docs = make([r for r in first if r[0] != "d007"] + later)
    everything = {"invoices_only": True, "include_hidden": True, "limit": None}
    for query, options in (("apex consultnts 0012", everything), ("omega", {}), ("zzzz", {}), ("?", {})):
        assert index.search(docs, path, query, **options).collect() == finder.search(docs, query, **options).collect()
    assert index.vocabulary(spark, path).filter("token = 'omega'").first()["docs"] == 1


def test_files_read_do_not_grow_with_the_documents(spark, tmp_path):
    read = []
    for n in (40, 400):
        path = str(tmp_path / str(n))
        index.add(spark.createDataFrame([doc(i, f"Company{i}") for i in range(n)] + [doc(n, "Apex")], DOC), path)
        tokens = index.answering(spark, path, ["apex"])
        posts = index.postings_of(spark, path, tokens)
        files = [f for f in posts.inputFiles() if "/postings/" in f]
        read.append((len(files), [tuple(r) for r in posts.collect()] == [("apex", f"d{n:03d}")]))
    assert read == [(1, True), (1, True)]
