"""Pages of the kept listing against pages of all documents in order."""

from docrecon.operators import finder, paging

DOC = "doc_id string, rel_parts array<string>, text string, hidden boolean"


def test_pages_are_those_of_the_whole_order(spark, tmp_path):
    docs = [(f"d{i:03d}", ["FY 22-23", "apex" if i % 3 else "APEX", f"f{i % 40}.pdf"], "odd words" if i % 2 else "even", i % 10 == 7) for i in range(230)]
    path, table = str(tmp_path / "listing"), spark.createDataFrame(docs, DOC).repartition(3)
    paging.write_listing(table, path, rows=30)
    order = sorted((r for r in docs if not r[3]), key=lambda r: ("/".join(r[1]).lower(), r[0]))
    for query, page, size in (("", 1, 50), ("", 4, 50), ("", 99, 50), ("", 6, 35), ("odd apex", 2, 45), ("zzz", 3, 10), ("", 2, 0)):
        want = [r[0] for r in order if all(w in ("/".join(r[1]) + " " + r[2]).lower() for w in query.split())]
        rows, told = paging.page_of_listing(spark, path, query, page, size)
        at, n = told["page"], max(1, size)
        assert told == {"total": len(want), "page": min(page, max(1, -(-len(want) // n))), "pages": -(-len(want) // n), "page_size": n}
        assert rows.columns == table.columns and [r["doc_id"] for r in rows.collect()] == want[(at - 1) * n : at * n]
    assert told == finder.flat(table, "", 2, 0)[1]


def test_a_page_reads_its_own_ranges(spark, tmp_path):
    path = str(tmp_path / "listing")
    paging.write_listing(spark.createDataFrame([(f"d{i:03d}", [f"{i:03d}.pdf"], "", False) for i in range(200)], DOC), path, rows=20)
    rows, _ = paging.page_of_listing(spark, path, page=20, page_size=10)
    read = {f.split("list_range=")[1].split("/")[0] for f in rows.inputFiles()}
    assert len(read) <= 2 and [r["doc_id"] for r in rows.collect()] == [f"d{i:03d}" for i in range(190, 200)]
    paging.write_listing(spark.createDataFrame([], DOC), path + "-empty")
    assert paging.page_of_listing(spark, path + "-empty")[1]["total"] == 0
