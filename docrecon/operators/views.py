"""Views of processed documents for people: lookups, records for a picker, events, tallies, and what each stage took."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.operators.corpus import needs_review
from docrecon.operators.stages import STAGES, seed
from docrecon.settings import DEFAULTS, Settings
from docrecon.sources.shared import snapshot

EVENT = "struct<stage:string,action:string,detail:string,severity:string>"
#: Notes of finished documents that a feed shows.
RECENT = 40


def by_id(docs: DataFrame, doc_id: str) -> DataFrame:
    """The document of an id, no row if there is none."""
    return docs.filter(F.col("doc_id") == doc_id)


def by_path(docs: DataFrame) -> DataFrame:
    """Documents in the order of their paths and pages."""
    return docs.orderBy("path", F.coalesce("page_index", F.lit(-1)))


def hits(docs: DataFrame) -> DataFrame:
    """A flat record of each document for a picker. Documents of other types are bindable too, and marked."""
    folder = F.array_join(F.slice("rel_parts", 1, F.greatest(F.size("rel_parts") - 1, F.lit(0))), "/")
    have = lambda name, kind: F.col(name) if name in docs.columns else F.lit(None).cast(kind)
    return docs.select(
        F.col("doc_id").alias("id"), "filename", folder.alias("folder"), F.array_join("rel_parts", "/").alias("rel"), have("score", "double").alias("score"), "invoice_id",
        F.col("vendor_gstin").alias("gstin"), F.col("vendor_name_pdf").alias("vendor"), F.col("invoice_date").alias("date"), F.col("total_value").alias("amount"), "company",
        F.round("confidence", 2).alias("confidence"), (F.col("doc_type") == "invoice").alias("is_invoice"), "doc_type", have("gstr_row", "int").alias("gstr_row"), "hidden")


def with_event(docs: DataFrame, when: Column, stage: str, action: str, detail: Column | str = "", severity: str = "info") -> DataFrame:
    """Append an event to the documents that ``when`` holds of. Events are never changed or taken away."""
    have = F.col("events") if "events" in docs.columns else F.array().cast(f"array<{EVENT}>")
    text = F.lit(detail) if isinstance(detail, str) else detail
    one = F.struct(F.lit(stage).alias("stage"), F.lit(action).alias("action"), text.alias("detail"), F.lit(severity).alias("severity"))
    return docs.withColumn("events", F.when(F.coalesce(when, F.lit(False)), F.concat(have, F.array(one))).otherwise(have))


def stage_events(docs: DataFrame) -> DataFrame:
    """The events that the stages leave: failures, lacking text, extraction, and the type with its reasons."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    docs = with_event(docs, failed, "extract", "error", F.col("error"), "error")
    docs = with_event(docs, ~failed & (F.col("source") == "none"), "extract", "no_text", "", "warn")
    docs = with_event(docs, F.col("source") != "none", "extract", "extracted", F.concat("source", F.lit(", "), F.length("text").cast("string"), F.lit(" chars")))
    return with_event(docs, F.lit(True), "classify", "classified", F.concat("doc_type", F.lit(": "), "reasons"))


def failed_in(stage: str) -> Column:
    """Whether a document failed in a stage."""
    return F.exists("flags", lambda x: (x["code"] == "stage_error") & x["message"].startswith(f"{stage} "))


def tallies(docs: DataFrame) -> DataFrame:
    """One row: pdfs, invoices, approvals, ocr, flagged, errors. Over a stream it is a running tally (complete mode)."""
    return docs.agg(
        F.count("*").alias("pdfs"), F.count_if(F.col("doc_type") == "invoice").alias("invoices"), F.count_if(F.col("doc_type") == "approval").alias("approvals"),
        F.count_if(F.col("source") == "ocr").alias("ocr"), F.count_if(needs_review()).alias("flagged"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))


def recent(docs: DataFrame, order: str = "seq", limit: int = RECENT) -> DataFrame:
    """The documents that were finished last, newest first."""
    return docs.orderBy(F.desc(order), "doc_id").limit(limit).select("doc_id", "filename", "doc_type", "source", "confidence", needs_review().alias("flagged"), "error")


def timed(docs: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The processed documents, and stage, docs, errors, seconds, ms_per_doc of each stage by itself.

    Every stage's result is written, so that the next one's time isn't mixed with it; for measuring, not for every day.
    """
    now, rows = snapshot(seed(docs, settings), "stage-seed"), []
    for stage in STAGES:
        began = time.monotonic()
        now = snapshot(stage(now, settings), f"stage-{stage.__name__}")
        took = time.monotonic() - began
        n, errors = now.agg(F.count("*"), F.count_if(failed_in(stage.__name__))).first()
        rows.append((stage.__name__, n, errors, took, 1000 * took / n if n else 0.0))
    return now, docs.sparkSession.createDataFrame(rows, "stage string, docs long, errors long, seconds double, ms_per_doc double")
