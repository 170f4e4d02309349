"""Passes over all documents: canonical vendor names, duplicate ids, summary and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.fuzzy import name_score
from docrecon.functions.norm import company_name
from docrecon.operators.stages import codes, flag, with_flags
from docrecon.settings import DEFAULTS, MASTER_COLUMNS


def invoices(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_type") == "invoice")


def needs_review(flags: str = "flags") -> Column:
    return (F.size(flags) > 0) & ~F.col("reviewed")


def canonical_vendors(docs: DataFrame) -> DataFrame:
    """vendor_gstin, canonical: of each tax id the most frequent company folder; of equals the one filed first.

    Counts are summed by (id, company) before the small per-id choice, so a hot id is one row a company.
    """
    named = invoices(docs).filter((F.col("vendor_gstin") != "") & (F.col("company") != ""))
    counted = named.groupBy("vendor_gstin", "company").agg(F.count("*").alias("n"), F.min(F.struct("path", F.coalesce("page_index", F.lit(-1)))).alias("first"))
    return counted.groupBy("vendor_gstin").agg(F.min_by("company", F.struct(-F.col("n"), F.col("first"))).alias("canonical"))


def flag_vendor_variants(docs: DataFrame, named: bool = True) -> DataFrame:
    """Flag invoices whose folder resembles their tax id's usual one too little; adds canonical, if ``named``.

    The similarity is taken once for each pair of names. Without names the documents meet the pairs that differ alone.
    """
    names = canonical_vendors(docs)
    pairs = invoices(docs).filter(F.col("company") != "").select("vendor_gstin", "company").distinct().join(names, "vendor_gstin")
    pairs = pairs.withColumns({"_a": company_name(F.col("company")), "_b": company_name(F.col("canonical"))})
    scored = pairs.select(F.col("vendor_gstin").alias("_g"), F.col("company").alias("_n"), (name_score(F.col("_a"), F.col("_b")) < DEFAULTS.soft).alias("_variant"), *([] if named else ["canonical"]))
    is_invoice = F.col("doc_type") == "invoice"
    if named:
        docs = docs.join(names, "vendor_gstin", "left").withColumn("canonical", F.when(is_invoice, F.col("canonical")))
    out = docs.join(scored if named else scored.filter("_variant"), is_invoice & (F.col("vendor_gstin") == F.col("_g")) & (F.col("company") == F.col("_n")), "left")
    message = F.concat(F.lit("folder '"), "company", F.lit("' differs from GSTIN "), "vendor_gstin", F.lit(" vendor '"), "canonical", F.lit("'"))
    return with_flags(out, flag(F.coalesce("_variant", F.lit(False)), "vendor_folder_variant", message)).drop("_g", "_n", "_variant", *([] if named else ["canonical"]))


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """invoice_id, copies, names (file names in path order) of ids that several invoices have."""
    one = F.struct("path", F.coalesce("page_index", F.lit(-1)).alias("page"), "filename")
    grouped = invoices(docs).filter(F.col("invoice_id") != "").groupBy("invoice_id").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.filter("copies > 1").select("invoice_id", "copies", F.transform("all", lambda x: x["filename"]).alias("names"))


def flag_duplicate_ids(docs: DataFrame) -> DataFrame:
    dup = duplicate_ids(docs).withColumnRenamed("invoice_id", "_id")
    out = docs.join(dup, (F.col("doc_type") == "invoice") & (F.col("invoice_id") == F.col("_id")), "left")
    message = F.concat(F.lit("invoice id '"), "invoice_id", F.lit("' appears in "), F.col("copies").cast("string"), F.lit(" places: ['"), F.array_join("names", "', '"), F.lit("']"))
    return with_flags(out, flag(F.col("copies").isNotNull(), "duplicate_id", message)).drop("_id", "copies", "names")


def corpus_passes(docs: DataFrame, named: bool = True) -> DataFrame:
    """Both passes. Their flags come after confidence is fixed, as they don't lower it."""
    return flag_duplicate_ids(flag_vendor_variants(docs, named))


def summary(docs: DataFrame) -> DataFrame:
    """One row: totals of documents, and the mean confidence of invoices."""
    invoice, ocr = F.col("doc_type") == "invoice", F.count_if(F.col("source") == "ocr")
    return docs.agg(
        F.count("*").alias("total_pdfs"),
        F.count_if(invoice).alias("invoices"),
        F.count_if(needs_review()).alias("flagged"),
        F.count_if(F.col("reviewed")).alias("reviewed"),
        ocr.alias("ocr_docs"),
        F.round(F.when(F.count("*") > 0, ocr / F.count("*")).otherwise(0.0), 3).alias("ocr_ratio"),
        F.round(F.coalesce(F.sum(F.when(invoice, F.col("confidence").cast("decimal(18,3)"))).cast("double") / F.count_if(invoice), F.lit(0.0)), 3).alias("avg_invoice_confidence"),
    )


def by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(F.count("*").alias("n"))


def summary_sheet(docs: DataFrame, run_id: str = "", root: str = "") -> DataFrame:
    """metric, value: the summary in long form, a row for each document type at its end."""
    one = summary(docs).withColumnRenamed("flagged", "flagged_for_review")
    names = one.columns
    stacked = one.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} as string)" for n in names) + ") as (metric, value)"))
    head = docs.sparkSession.createDataFrame([("run_id", run_id), ("root", root)], "metric string, value string")
    return head.unionByName(stacked).unionByName(by_type(docs).select(F.concat(F.lit("doc_type:"), "doc_type").alias("metric"), F.col("n").cast("string").alias("value")))


def relative_path(root: str) -> Column:
    """Path below the root, or the bare file name elsewhere."""
    path, base = F.col("path"), root.rstrip("/") + "/"
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(name) if root else name


def master_sheet(docs: DataFrame, root: str = "") -> DataFrame:
    """The master sheet's columns as text, a row for each invoice, and highlight where it needs review."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = {
        "invoice_date": F.coalesce("invoice_date", "invoice_date_raw", F.lit("")), "reviewed": F.when(F.col("reviewed"), "yes").otherwise(""), "flags": codes(),
        "rel_path": relative_path(root), "file_path": F.col("path"), "confidence": F.round("confidence", 3).cast("string"),
    }
    have = docs.columns
    cols = [(own.get(c) if c in own else text(c) if c in have else F.lit("unknown" if c == "link_status" else "")).alias(c) for c in MASTER_COLUMNS]
    return invoices(docs).select(*cols, needs_review().alias("highlight"))


def exceptions_sheet(docs: DataFrame, root: str = "") -> DataFrame:
    """Documents that need review, are neither invoice nor approval, or failed."""
    odd = ~F.col("doc_type").isin("invoice", "approval")
    messages = F.array_join(F.transform("flags", lambda x: x["message"]), "; ")
    reason = F.coalesce(F.when(F.col("error") != "", F.col("error")), F.when(messages != "", messages), F.lit("non-standard doc"))
    return docs.filter(needs_review() | odd | (F.coalesce("error", F.lit("")) != "")).select(
        relative_path(root).alias("rel_path"), F.col("path").alias("file_path"), "doc_type", reason.alias("reason"), codes().alias("flags"), F.round("confidence", 3).alias("confidence"), F.coalesce("company", F.lit("")).alias("company_folder"))
