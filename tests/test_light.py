"""Queries and searches that leave out what they don't need."""

from pyspark.sql import functions as F

from docrecon.operators import finder
from docrecon.plans import queries
from docrecon.sources import shared


def test_listings_need_no_parsed_fields(spark, monkeypatch):
    path = "/root/testdata/sf0.001"
    shared.forget()
    names = ("classify_docs", "doc_types", "browse_level", "browse_prefix", "browse_files", "browse_deep")
    light = {n: sorted(map(repr, queries.QUERIES[n](spark, path).collect())) for n in names}
    assert not shared.is_kept(spark, f"processed {path}")
    queries.processed(spark, path)
    assert light == {n: sorted(map(repr, queries.QUERIES[n](spark, path).collect())) for n in names}


def test_letters_in_common_bound_the_subsequence(spark):
    tokens = spark.createDataFrame([(f"{k:07d}",) for k in range(0, 4_000_000, 3001)] + [("apex",), ("consultants",), ("apxe",), ("sult",)], "token string")
    for word in ("0000123", "consultnts", "apex"):
        both = tokens.select(finder._letters_of(word, F.col("token")).alias("most"), finder.lcs(F.lit(word), F.col("token")).alias("n"))
        assert both.filter("most < n").count() == 0
    found = {(r["pos"], r["token"]) for r in finder.token_scores(["consultnts", "apex"], tokens).collect()}
    assert {(0, "consultants"), (1, "apex"), (1, "apxe")} <= found and len(found) < 6
