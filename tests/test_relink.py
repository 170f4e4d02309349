"""Matching again after edits against matching everything."""

import random

import pytest
from pyspark.sql import functions as F

from docrecon.operators import decisions, link, relink
from docrecon.sources import runs

DOC = "doc_id string, doc_type string, invoice_id string, invoice_no_content string, vendor_gstin string, confidence double, reviewed boolean, hidden boolean, flags array<string>"
ROW = "row int, gstin string, invoice_no string, invoice_date string, supplier string, value string, existing_ref string"


@pytest.fixture
def tables(spark):
    rng = random.Random(4)
    number, tax = (lambda: rng.choice(["", "inv1", *(f"INV-{k}" for k in range(25))])), (lambda: rng.choice(["", "G1", "g2", "G3"]))
    docs = [(f"d{i:02d}", rng.choice(["invoice", "invoice", "other"]), number(), number(), tax(), rng.random(), False, False, []) for i in range(60)]
    rows = [(i, tax(), number(), "", rng.choice(["Apex", " APEX", "Blue"]), "", "") for i in range(2, 70)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(rows, ROW)


def plan_rows(plan):
    return sorted(map(str, plan.select("row", "status", "doc_id", "candidates", "copies", "manual", "supplier").collect()))


def test_edits_give_the_plan_of_a_full_match(spark, tmp_path, tables):
    docs, rows = tables
    run, rng = runs.new_run(str(tmp_path), "/tree"), random.Random(8)
    log = [(1, "bind", "3", "d01"), (2, "missing", "5", "on")]
    state = lambda: decisions.latest(spark.createDataFrame(log, decisions.SCHEMA))
    full = lambda now: link.match(rows, decisions.overlay(docs, now), decisions.manual_links(now), decisions.skipped_suppliers(now), decisions.missing_rows(now))
    now = state()
    assert plan_rows(relink.link_all(spark, run, rows, docs, now, 8)) == plan_rows(full(now))
    edits = [
        lambda: ("reject", f"d{rng.randrange(60):02d}", None), lambda: ("promote", f"d{rng.randrange(60):02d}", None), lambda: ("confirm", f"d{rng.randrange(60):02d}", '{"invoice_no_content": "INV-7", "vendor_gstin": "G9"}'),
        lambda: ("bind", str(rng.randrange(2, 70)), f"d{rng.randrange(60):02d}"), lambda: ("missing", str(rng.randrange(2, 70)), rng.choice(["on", "off"])), lambda: ("skip", rng.choice(["apex", "Blue"]), rng.choice(["on", "off"]))]
    for step in range(2):
        was = now
        log += [(10 * step + 10 + k, *edits[k]()) for k in range(6) if step or k in (0, 2)]
        now = state()
        assert plan_rows(relink.relink_decisions(spark, run, docs, was, now)) == plan_rows(full(now)) == plan_rows(relink.current(spark, run))
    assert relink.clean(run) > 0 and plan_rows(relink.current(spark, run)) == plan_rows(full(now))


def test_an_edit_reads_the_buckets_of_its_keys(spark, tmp_path, tables, monkeypatch):
    docs, rows = tables
    run, none = runs.new_run(str(tmp_path), "/tree"), decisions.latest(spark.createDataFrame([], decisions.SCHEMA))
    relink.link_all(spark, run, rows, docs, none, 64)
    before, read = runs.read_meta(run)["links"]["tables"], []
    whole = relink.paths

    def noted(run, links, name, wanted=None):
        found = whole(run, links, name, wanted)
        read.append((name, len(found), wanted))
        return found

    monkeypatch.setattr(relink, "paths", noted)
    old = spark.createDataFrame([], docs.schema)
    new = spark.createDataFrame([("new1", "invoice", "INV-9", "inv/9", "G1", 0.9, False, False, [])], docs.schema)
    plan = relink.relink(spark, run, old, new, none, none)
    assert read and all(wanted is not None and n <= 1 for name, n, wanted in read if (name, wanted) != ("plan", None))
    after = runs.read_meta(run)["links"]["tables"]
    moved = {name: [b for b in after[name]["parts"] if after[name]["parts"][b] != before[name]["parts"].get(b)] for name in after}
    assert len(moved["index"]) == len(moved["ids"]) == 1 and moved["plan"] in ([], moved["index"]) and moved["rows"] == []
    assert plan_rows(plan) == plan_rows(link.match(rows, docs.unionByName(new)))
    monkeypatch.setattr(relink, "paths", whole)
    gone = relink.relink(spark, run, new, old, none, none)
    assert plan_rows(gone) == plan_rows(link.match(rows, docs)) and plan_rows(relink.relink(spark, run, old, old, none, none)) == plan_rows(gone)


def test_two_edits_at_once_are_told(spark, tmp_path, tables):
    docs, rows = tables
    run, none = runs.new_run(str(tmp_path), "/tree"), decisions.latest(spark.createDataFrame([], decisions.SCHEMA))
    relink.link_all(spark, run, rows.limit(0), docs.filter(F.lit(False)), none, 4)
    with pytest.raises(RuntimeError, match="meanwhile"):
        relink._publish(run, runs.read_meta(run)["links"], 0)
    assert relink.current(spark, run).count() == 0
