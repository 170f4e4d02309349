"""Suggestions of invoices and folders against comparing all with all."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docrecon.functions.fuzzy import name_score_of
from docrecon.functions.norm import company_name
from docrecon.operators import finder, link, nearest
from docrecon.plans import queries
from docrecon.sources import shared


def common(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b):
            new.append(row[j] + 1 if ch == other else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def tenth(x):
    return math.floor(x * 10 + 0.5)


def plain_suggestions(rows, docs, limit=5):
    key, tax = (lambda s: re.sub("[^a-z0-9]", "", (s or "").lower())), (lambda s: re.sub("[^A-Z0-9]", "", (s or "").upper()))
    out = set()
    for row, gstin, number in rows:
        n, scored = key(number), []
        for doc, kind, first, second, g in docs:
            if kind != "invoice" or not (first or second or g):
                continue
            ratios = [200.0 * common(n, key(c)) / max(len(n) + len(key(c)), 1) if key(c) else 0.0 for c in (first, second)]
            s = tenth(0.75 * max(ratios) + (25.0 if tax(gstin) and tax(gstin) == tax(g) else 0.0))
            if s > 0:
                scored.append((-s, doc))
        out |= {(row, k + 1, doc, -s / 10) for k, (s, doc) in enumerate(sorted(scored)[:limit])}
    return out


def made(rng, n):
    odd = ["", None, "7", "a", "99", "see the attached mail of May 2022", "inv/0000001"]
    number = lambda: rng.choice(odd) if rng.random() < 0.1 else f"{rng.choice(['INV-', 'inv/', 'ZL', 'LOST ', ''])}{rng.randrange(400):0{rng.choice([3, 5, 7])}d}"
    tax = lambda: rng.choice(["", None, "G1", "G1", "G1", *(f"g{k}" for k in range(2, 20))])
    return number, tax


@pytest.mark.parametrize("group", [12, 10_000])
def test_suggestions_are_those_of_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(nearest, "GROUP", group)
    monkeypatch.setattr(nearest, "CHUNK", 7)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    rng = random.Random(group)
    number, tax = made(rng, 0)
    docs = [(f"d{i:03d}", rng.choice(["invoice"] * 5 + ["approval"]), number(), number(), tax()) for i in range(260)]
    docs += [(f"e{i:03d}", "invoice", "INV-0000123", "INV-0000123", "G1") for i in range(20)] + [("f1", "invoice", None, None, None)]
    rows = [(i, tax(), number()) for i in range(40)] + [(98, "G1", "INV-0000124"), (99, "", "INV-0000123")]
    docs_df = spark.createDataFrame(docs, "doc_id string, doc_type string, invoice_id string, invoice_no_content string, vendor_gstin string").repartition(3)
    rows_df = spark.createDataFrame(rows, "row int, gstin string, invoice_no string")
    assert {tuple(r) for r in link.suggest_bulk(rows_df, docs_df).collect()} == plain_suggestions(rows, docs)
    if group == 12:
        assert link.suggest_bulk(rows_df.limit(0), docs_df).count() == 0 and link.suggest_bulk(rows_df, docs_df.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [0, 2_000])
def test_suggestions_by_sets_and_by_blocks_agree(spark, monkeypatch, whole):
    for name, value in (("GROUP", 0), ("CHUNK", 7), ("PAIRS", 50), ("WHOLE", whole), ("ASKED", 9), ("HELD", 40), ("FIRST", 3)):
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(3)
    number, tax = made(rng, 0)
    docs = [(f"d{i:03d}", "invoice", number(), number(), tax()) for i in range(150)]
    rows = [(i, tax(), number()) for i in range(40)]
    docs_df = spark.createDataFrame(docs, "doc_id string, doc_type string, invoice_id string, invoice_no_content string, vendor_gstin string").repartition(3)
    rows_df = spark.createDataFrame(rows, "row int, gstin string, invoice_no string")
    assert {tuple(r) for r in link.suggest_bulk(rows_df, docs_df).collect()} == plain_suggestions(rows, docs)


def test_few_pairs_of_a_block_are_worked_out():
    """All letters are counted, but only pairs that may be among the best are scored."""
    rng = random.Random(4)
    held = sorted({f"inv{rng.randrange(10**7):07d}" for _ in range(4000)})
    asked = [{"n": f"inv{rng.randrange(10**7):07d}", "more": 0.0, "least": 1} for _ in range(50)]
    a = pa.array(asked, pa.struct([("n", pa.string()), ("more", pa.float64()), ("least", pa.int64())]))
    h = pa.array([{"number": x, "first": f"d{i}"} for i, x in enumerate(held)], pa.struct([("number", pa.string()), ("first", pa.string())]))
    scored = []
    i, j, best, _ = nearest._best_of_block(a, h, 10, lambda *x: scored.append(len(x[2])) or nearest.number_scores(*x), 0.75)
    assert sum(scored) < len(asked) * len(held) / 2
    every = nearest.number_scores([x["n"] for x in asked], held, *(c.ravel() for c in np.mgrid[: len(asked), : len(held)]), np.zeros(len(asked) * len(held))).reshape(len(asked), -1)
    assert [sorted(best[i == k], reverse=True) for k in range(len(asked))] == [sorted(row, reverse=True)[:10] for row in every.tolist()]


def test_sets_of_letters_tell_repeats_apart(spark):
    df = spark.createDataFrame([("abcab",), ("",), ("7",)], "n string").select(nearest.tokens(F.col("n")).alias("t"))
    assert [r["t"] for r in df.collect()][::2] == [["a0", "a1", "b0", "b1", "c0"], ["70"]]


@pytest.mark.parametrize("words, group", [(2, 0), (6, 10_000)])
def test_folders_are_those_of_all_pairs(spark, monkeypatch, words, group):
    monkeypatch.setattr(finder, "WORDS", words)
    monkeypatch.setattr(nearest, "GROUP", group)
    rng = random.Random(words)
    parts = ["blue", "bleu", "ridge", "traders", "trader", "ab", "axb", "b", "apex", "stores", "17", "71", "Pvt Ltd", "& Sons", "(old)", "of the north east hills"]
    name = lambda: " ".join(rng.choices(parts, k=rng.choice([1, 1, 2, 3, 4])))
    suppliers, folders = sorted({name() for _ in range(60)}) + ["", "llp"], sorted({name() for _ in range(90)} | {"Apex", "APEX", "apex."})
    a, b = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((suppliers, "supplier"), (folders, "name")))
    keys = {r["s"]: r["k"] for r in spark.createDataFrame([(x,) for x in {*suppliers, *folders}], "s string").select("s", company_name(F.col("s")).alias("k")).collect()}
    want = {}
    for s in suppliers:
        scored = [(-tenth(x) / 10, f.lower(), f) for f in folders if keys[s] and keys[f] and round(x := name_score_of(keys[s], keys[f]), 9) >= 70]
        want[s] = [(s, k + 1, f, -x) for k, (x, _, f) in enumerate(sorted(scored))]
    got = lambda limit: {tuple(r) for r in finder.folder_scores(a, b, limit).collect()}
    assert got(3) == {x for v in want.values() for x in v[:3]}
    if words == 2:
        assert got(None) == {x for v in want.values() for x in v}
        assert finder.folder_scores(a.limit(0), b).count() == 0 and finder.folder_scores(a, b.limit(0)).count() == 0


def test_queries_go_to_the_tasks_that_hold_a_block(spark, monkeypatch):
    """Every block's bytes are few and its work is much, so tasks aren't merged."""
    for name, value in (("ASKED", 9), ("HELD", 40)):
        monkeypatch.setattr(nearest, name, value)
    asked = spark.range(30).select(F.lit("").alias("scope"), F.format_string("inv%05d", F.col("id") * 7).alias("n"), F.lit(0.0).alias("more"), F.lit(1).cast("long").alias("least"))
    held = spark.range(120).select(F.lit("").alias("scope"), F.format_string("inv%05d", F.col("id") * 3).alias("number"), F.format_string("d%05d", "id").alias("first"), F.lit(120).cast("long").alias("count"))
    found = nearest._all_pairs(shared.snapshot(asked, "asked"), shared.snapshot(held, "held"), 5, nearest.number_scores, 0.75)
    assert found.rdd.getNumPartitions() == 4
    assert found.select("n").distinct().count() == 30


def test_suggestions_wait_for_what_matching_compares(spark):
    path = "/root/testdata/sf0.001"
    shared.forget()
    alone = sorted(map(repr, queries.suggest_topk(spark, path).collect()))
    assert not shared.is_kept(spark, f"processed {path}")
    queries.processed(spark, path)
    assert alone and alone == sorted(map(repr, queries.suggest_topk(spark, path).collect()))
