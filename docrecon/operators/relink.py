"""Matching again after an edit: only rows whose keys meet what has changed, in the buckets of these keys.

A run keeps what matching reads in tables of buckets: the match index and the rows by invoice number, the ids of invoices,
and the plan by its rows' numbers. What a row gets depends on the invoices of its number, on its own decisions, on whether
the document bound to it is an invoice, and on its supplier being skipped, and on nothing else. So an edit touches the
buckets of the numbers that its documents had and have, and the rows that its decisions name; these are matched anew and
take the place of the old ones in their buckets. A new version of a bucket is a folder of its own, and the list of versions
in the run's metadata changes at once, if nobody else has changed it meanwhile.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docrecon.functions.norm import invoice_key, supplier_key
from docrecon.operators import decisions, link
from docrecon.operators.corpus import invoices
from docrecon.sources.lease import locked, put_meta, read_meta
from docrecon.sources.shared import snapshot

BUCKETS = 256


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


KEYS = {"rows": lambda: invoice_key(F.col("invoice_no")), "plan": lambda: invoice_key(F.col("invoice_no")), "index": lambda: F.col("number"), "ids": lambda: F.col("doc_id")}


def _write(run: str, name: str, df: DataFrame, n: int) -> dict[str, str]:
    """Write a table's buckets as a new version: the version of each bucket that has rows."""
    version = uuid.uuid4().hex
    path = os.path.join(run, "links", name, version)
    dealt = df.withColumn("bucket", _bucket(KEYS[name](), n))
    dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket", df.columns[0]).write.partitionBy("bucket").parquet(path)
    return {d.removeprefix("bucket="): version for d in os.listdir(path) if d.startswith("bucket=")}


def paths(run: str, links: dict, name: str, wanted: set[int] | None = None) -> list[str]:
    """The folders of a table's buckets, or of those wanted."""
    return [os.path.join(run, "links", name, v, f"bucket={b}") for b, v in links["tables"][name]["parts"].items() if wanted is None or int(b) in wanted]


def _read(spark: SparkSession, run: str, links: dict, name: str, wanted: set[int] | None = None) -> DataFrame:
    schema, found = StructType.fromJson(json.loads(links["tables"][name]["schema"])), paths(run, links, name, wanted)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def _buckets(df: DataFrame, name: str, n: int) -> set[int]:
    return {r[0] for r in df.select(_bucket(KEYS[name](), n)).distinct().collect()}


def _publish(run: str, links: dict, base: int) -> None:
    with locked(run):
        meta = read_meta(run)
        if meta.get("links", {}).get("version", 0) != base:
            raise RuntimeError("the links have changed meanwhile; match again")
        put_meta(run, meta | {"links": links | {"version": base + 1}})


def link_all(spark: SparkSession, run: str, rows: DataFrame, docs: DataFrame, now: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Match all rows and keep the tables that later edits need; the plan."""
    base = read_meta(run).get("links", {}).get("version", 0)
    own = decisions.overlay(docs, now)
    found = invoices(own)
    plan = link.match(rows, own, decisions.manual_links(now), decisions.skipped_suppliers(now), decisions.missing_rows(now))
    made = {"rows": rows, "index": link.match_index(found), "ids": found.select("doc_id").distinct(), "plan": plan}
    links = {"buckets": buckets, "tables": {name: {"schema": df.schema.json(), "parts": _write(run, name, df, buckets)} for name, df in made.items()}}
    _publish(run, links, base)
    return current(spark, run)


def current(spark: SparkSession, run: str) -> DataFrame:
    """The plan as it stands."""
    return _read(spark, run, read_meta(run)["links"], "plan")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def relink(spark: SparkSession, run: str, before: DataFrame, after: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    """Match again what an edit touches; the plan.

    ``before`` and ``after`` are the documents that it changed, with their decisions applied; one that came or went is in
    one of them alone. ``was`` and ``now`` are the decisions. Rows themselves don't change; for that there is ``link_all``.
    """
    links = read_meta(run)["links"]
    base, n = links["version"], links["buckets"]
    tables = {name: t | {"parts": dict(t["parts"])} for name, t in links["tables"].items()}
    links = links | {"tables": tables}

    def replace(name: str, df: DataFrame, wanted: set[int]) -> None:
        new = _write(run, name, df, n)
        tables[name]["parts"] = {b: v for b, v in tables[name]["parts"].items() if int(b) not in wanted} | new

    changed = snapshot(before.select("doc_id").union(after.select("doc_id")).distinct(), "changed")
    fresh = snapshot(link.match_index(invoices(after)), "fresh-index")
    numbers = snapshot(link.match_index(invoices(before)).select("number").union(fresh.select("number")).distinct(), "changed-numbers")
    touched = _buckets(numbers, "index", n)
    if touched:
        kept = _read(spark, run, links, "index", touched).join(changed, "doc_id", "left_anti").select(fresh.columns)
        replace("index", kept.unionByName(fresh), touched)
    own_ids = _buckets(changed, "ids", n)
    if own_ids:
        kept = _read(spark, run, links, "ids", own_ids).join(changed, "doc_id", "left_anti")
        replace("ids", kept.unionByName(invoices(after).select("doc_id").distinct()), own_ids)

    manual = decisions.manual_links(now)
    named = _differing(decisions.manual_links(was), manual).select("row").union(_differing(decisions.missing_rows(was), decisions.missing_rows(now)))
    named = snapshot(named.union(manual.join(changed.withColumnRenamed("doc_id", "bound_doc"), "bound_doc", "left_semi").select("row")).distinct(), "named-rows")
    skips = snapshot(_differing(decisions.skipped_suppliers(was), decisions.skipped_suppliers(now)).select(supplier_key(F.col("supplier")).alias("_k")).distinct(), "changed-skips")
    met = _read(spark, run, links, "rows", touched).join(numbers, invoice_key(F.col("invoice_no")) == F.col("number"), "left_semi")
    if not named.isEmpty():
        met = met.unionByName(_read(spark, run, links, "rows").join(named, "row", "left_semi"))
    if not skips.isEmpty():
        met = met.unionByName(_read(spark, run, links, "rows").join(skips, supplier_key(F.col("supplier")) == F.col("_k"), "left_semi"))
    met = snapshot(met.dropDuplicates(["row"]), "rows-again")
    again = _buckets(met, "rows", n)
    if again:
        bound = snapshot(manual.join(met.select("row"), "row", "left_semi"), "bound")
        ids = _read(spark, run, links, "ids", _buckets(bound.select(F.col("bound_doc").alias("doc_id")), "ids", n))
        part = link.outcomes_of(met, _read(spark, run, links, "index", again))
        part = link.resolve(part, link.valid_links(bound, ids), decisions.missing_rows(now), decisions.skipped_suppliers(now))
        old = _read(spark, run, links, "plan", again)
        replace("plan", old.join(met.select("row"), "row", "left_anti").select(old.columns).unionByName(part.select(old.columns)), again)
    _publish(run, links, base)
    return _read(spark, run, links, "plan")


def relink_decisions(spark: SparkSession, run: str, docs: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    """Match again after decisions about ``docs`` (without decisions applied) changed from ``was`` to ``now``."""
    cols = ["kind", "key", "payload"]
    moved = _differing(was.select(cols), now.select(cols))
    about = F.when(F.col("kind") == "bind", F.col("payload")).when(~F.col("kind").isin("missing", "skip"), F.col("key"))
    own = snapshot(docs.join(moved.select(about.alias("doc_id")).filter("doc_id != ''").distinct(), "doc_id", "left_semi"), "edited")
    return relink(spark, run, decisions.overlay(own, was), decisions.overlay(own, now), was, now)


def clean(run: str) -> int:
    """Remove the versions of buckets that later ones have replaced, while nobody reads or matches: how many."""
    links, gone = read_meta(run).get("links"), 0
    for name, table in (links["tables"] if links else {}).items():
        folder = os.path.join(run, "links", name)
        for version in os.listdir(folder):
            for entry in os.listdir(os.path.join(folder, version)):
                if entry.startswith("bucket=") and table["parts"].get(entry.removeprefix("bucket=")) != version:
                    shutil.rmtree(os.path.join(folder, version, entry), ignore_errors=True)
                    gone += 1
    return gone
