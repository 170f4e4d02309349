"""Reviewer decisions as an append-only log, and what they make of the documents.

A decision is (seq, kind, key, payload): the latest of each (kind, key) holds. Kinds: ``confirm`` (payload: JSON of edited
fields), ``reject``, ``approve``, ``hide`` and ``promote``, keyed by document; ``bind`` (payload: document, or null to
unbind) and ``missing``, keyed by row; ``skip``, keyed by supplier. ``on`` in the payload switches the latter kinds; a
null payload means on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.norm import money, supplier_key

SCHEMA = "seq long, kind string, key string, payload string"
OFF = ("0", "false", "off", "")  # fixed values
TEXT_FIELDS = ("company", "invoice_no_content", "vendor_name_pdf", "vendor_gstin", "invoice_date", "bill_to_name", "bill_to_gstin")
MONEY_FIELDS = ("taxable_value", "total_value")


def bad_amounts(payload: str | None) -> list[str]:
    """Names of the money fields of an edit that hold something that is no amount."""
    import json

    fields, bad = json.loads(payload) if payload else {}, []
    for name in MONEY_FIELDS:
        value = str(fields.get(name) or "").strip()
        try:
            if value:
                float(value.replace(",", ""))
        except ValueError:
            bad.append(name)
    return bad


def latest(log: DataFrame) -> DataFrame:
    """kind, key, payload, seq of the decisions that hold. Suppliers are one key however they are spelled."""
    key = F.when(F.col("kind") == "skip", supplier_key(F.col("key"))).otherwise(F.col("key"))
    return log.withColumn("key", key).groupBy("kind", "key").agg(F.max_by(F.struct("payload", "seq"), "seq").alias("x")).select("kind", "key", "x.payload", "x.seq")


def _on() -> Column:
    return ~F.lower(F.coalesce("payload", F.lit("on"))).isin(*OFF)


def manual_links(now: DataFrame) -> DataFrame:
    """row, bound_doc."""
    return now.filter("kind = 'bind' AND payload IS NOT NULL AND payload != ''").select(F.col("key").cast("int").alias("row"), F.col("payload").alias("bound_doc"))


def missing_rows(now: DataFrame) -> DataFrame:
    return now.filter((F.col("kind") == "missing") & _on()).select(F.col("key").cast("int").alias("row"))


def skipped_suppliers(now: DataFrame) -> DataFrame:
    return now.filter((F.col("kind") == "skip") & _on()).select(F.col("key").alias("supplier"))


def overlay(docs: DataFrame, now: DataFrame, by: str = "doc_id") -> DataFrame:
    """The documents with the decisions applied.

    Confirming and approving mark as reviewed, rejecting makes a document ``other`` and reviewed, binding or promoting
    makes one an invoice and reviewed; of rejecting and promoting the later counts. Blank edits of text fields clear
    them, blank or bad amounts change nothing. ``by`` is the column that decisions name documents by: ids, which are short
    and which some of millions of documents share, or their source keys.
    """
    per = now.filter(F.col("kind").isin("confirm", "reject", "approve", "hide", "promote")).select(F.col("key").alias("_doc"), "kind", "payload", "seq")
    bound = now.filter("kind = 'bind' AND payload != ''").select(F.col("payload").alias("_doc"), F.lit("promote").alias("kind"), F.lit(None).cast("string").alias("payload"), "seq")
    pick = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    by_doc = per.unionByName(bound).groupBy("_doc").agg(
        pick("confirm", "payload").alias("_edit"), pick("reject", "seq").alias("_reject"), pick("promote", "seq").alias("_promote"), pick("confirm", "seq").alias("_confirm"), pick("approve", "seq").alias("_approve"), F.max(F.when((F.col("kind") == "hide") & _on(), True)).alias("_hide"))
    out = docs.join(by_doc, docs[by] == F.col("_doc"), "left")
    field = lambda name: F.get_json_object("_edit", f"$.{name}")
    edits = {f: F.when(field(f).isNotNull(), F.when(F.trim(field(f)) != "", F.trim(field(f)))).otherwise(F.col(f)) for f in TEXT_FIELDS if f in docs.columns}
    edits |= {f: F.coalesce(money(field(f)), F.col(f)) for f in MONEY_FIELDS if f in docs.columns}
    rejected = F.col("_reject").isNotNull() & (F.coalesce("_promote", F.lit(-1)) < F.col("_reject"))
    promoted = F.col("_promote").isNotNull() & ~rejected & (F.col("doc_type") != "invoice")
    kind = F.when(rejected, "other").when(promoted, "invoice").otherwise(F.col("doc_type"))
    seen = F.col("reviewed") | rejected | promoted | F.col("_confirm").isNotNull() | (F.col("_approve").isNotNull() & (F.size("flags") > 0))
    return out.withColumns(edits | {"reviewed": seen, "hidden": F.coalesce("_hide", F.col("hidden")), "doc_type": kind}).drop("_doc", "_edit", "_reject", "_promote", "_confirm", "_approve", "_hide")


def bindings(now: DataFrame, plan: DataFrame, docs: DataFrame) -> DataFrame:
    """row, kind (bound or missing), doc_id, filename, supplier, effective: all decisions about rows, by row."""
    own = manual_links(now).select("row", F.lit("bound").alias("kind"), F.col("bound_doc").alias("doc_id")).unionByName(missing_rows(now).select("row", F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("doc_id")))
    rows = plan.select("row", "supplier", "status", F.col("doc_id").alias("p_doc"))
    names = docs.groupBy("doc_id").agg(F.min("filename").alias("filename"))  # documents can share an id
    out = own.join(rows, "row", "left").join(names, "doc_id", "left")
    took = F.when(F.col("kind") == "bound", (F.col("status") == "matched") & (F.col("p_doc") == F.col("doc_id"))).otherwise(F.col("status") == "manual_not_found")
    return out.select("row", "kind", "doc_id", "filename", "supplier", F.coalesce(took, F.lit(False)).alias("effective")).orderBy("row", "kind")


def next_unresolved(plan: DataFrame) -> DataFrame:
    """row, next_row of each unresolved row: the next one, and the first after the last.

    The rows are cut into ranges, each range is numbered by itself, and only the first row of each range is looked up in
    the next, so no task sorts all rows.
    """
    from pyspark.sql import Window

    open_ = plan.filter(F.col("status").isin("not_found", "ambiguous")).select("row", F.floor(F.col("row") / 10_000).alias("slice"))
    firsts = open_.groupBy("slice").agg(F.min("row").alias("first"))
    order = Window.orderBy("slice")  # a row for each slice of 10,000 sheet rows
    after = firsts.select("slice", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("beyond"))
    inside = open_.withColumn("n", F.lead("row").over(Window.partitionBy("slice").orderBy("row")))
    return inside.join(after, "slice").select("row", F.coalesce("n", "beyond").alias("next_row"))
