"""The library's entry points: scan, link, export and search over a run folder."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.operators import decisions, link
from docrecon.operators.corpus import corpus_passes, exceptions_sheet, master_sheet, needs_review, summary_sheet
from docrecon.operators.stages import process
from docrecon.operators.views import with_event
from docrecon.settings import DEFAULTS, Settings
from docrecon.sources import lease, runs
from docrecon.sources.shared import snapshot
from docrecon.sources.workbook import REF_HEADER, REPORT_SHEET, SHEET, fill_workbook, read_return
from docrecon.streaming import ingest

PageWriter = Callable[[bytes, int], bytes]


def scan_table(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Processed documents, with the passes over all of them, from a table of paths and texts."""
    return corpus_passes(process(docs, settings))


def save(docs: DataFrame, run: str) -> None:
    """Write the snapshot as a new version; a crash at any time leaves the old one or the new one."""
    runs.save_table(docs.sparkSession, run, "snapshot", docs)


def load(spark: SparkSession, run: str) -> DataFrame | None:
    """Snapshot and what the ledger has beyond it. While a scan runs this is a live view of what is finished. The events
    of the scan's stages stay in the ledger; ``views.stage_events`` tells them from the documents."""
    found = ingest.ledger(spark, run)
    done = found if found is None else runs.last_write(found.drop("pass", "batch", "events")).drop("seq", "position")
    kept = runs.load_table(spark, run, "snapshot")
    return kept if done is None else done if kept is None else runs.overlay_ledger(kept, done)


def save_plan(plan: DataFrame, run: str, own: lease.Lease | None = None) -> None:
    runs.save_table(plan.sparkSession, run, "link", plan, own)


def load_plan(spark: SparkSession, run: str) -> DataFrame | None:
    """The link plan as it was saved last, None if there is none."""
    return runs.load_table(spark, run, "link")


def decide(spark: SparkSession, run: str, kind: str, key: str, payload: str | None = None) -> list[str]:
    """Append a decision. Refused while the run is scanning or exporting. Returns the amounts of an edit that are none;
    the rest of the edit holds."""
    with lease.edited(run, "decisions") as seq:
        spark.createDataFrame([(seq, kind, key, payload)], decisions.SCHEMA).write.mode("append").parquet(os.path.join(run, "decisions"))
    return decisions.bad_amounts(payload) if kind == "confirm" else []


def approve_all(spark: SparkSession, run: str, docs: DataFrame) -> int:
    """One decision for each document that needs review, in one append; nothing is matched again."""
    todo = snapshot(docs.filter(needs_review()).select("doc_id"), "approved")
    n = todo.count()
    if n:
        with lease.edited(run, "decisions") as seq:
            todo.select(F.lit(seq).cast("long").alias("seq"), F.lit("approve").alias("kind"), F.col("doc_id").alias("key"), F.lit(None).cast("string").alias("payload")).write.mode("append").parquet(os.path.join(run, "decisions"))
    return n


def decided(spark: SparkSession, run: str) -> DataFrame:
    path = os.path.join(run, "decisions")
    return decisions.latest(spark.read.parquet(path) if os.path.isdir(path) else spark.createDataFrame([], decisions.SCHEMA))


def link_now(docs: DataFrame, rows: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan, and the documents with decisions and links, from scratch each time."""
    own = decisions.overlay(docs, now)
    plan = link.match(rows, own, decisions.manual_links(now), decisions.skipped_suppliers(now), decisions.missing_rows(now))
    stale = [c for c in ("link_status", "gstr_row", "gstr_ref") if c in own.columns]
    return plan, own.drop(*stale).join(link.stamp(plan, own), "doc_id", "left")


def export(plan: DataFrame, docs: DataFrame, out: str, copied: DataFrame | None = None, template: str = "", sheet: str = SHEET) -> None:
    """The sheets as tables under ``out``. ``copied`` (row, ok) tells which copies of matched files failed."""
    link.cells(plan, docs, copied).write.mode("overwrite").parquet(os.path.join(out, "cells"))
    link.report(plan, docs, copied, template, sheet).write.mode("overwrite").parquet(os.path.join(out, "report"))
    for name, section in link.report_sections(plan, docs).items():
        section.write.mode("overwrite").parquet(os.path.join(out, f"report_{name}"))
    master_sheet(docs).write.mode("overwrite").parquet(os.path.join(out, "master"))
    exceptions_sheet(docs).write.mode("overwrite").parquet(os.path.join(out, "exceptions"))
    summary_sheet(docs).write.mode("overwrite").parquet(os.path.join(out, "summary"))


def copy_files(todo: DataFrame, folder: str, page_writer: PageWriter | None = None) -> DataFrame:
    """row, name, ok: copies of files (row, name, path, page_index) in one folder that executors share, made by tasks of
    their own. A page of a file needs ``page_writer`` (bytes and page to a one-page file). A copy that fails is told."""

    def copy(batches: Iterator) -> Iterator:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            ok = []
            for path, name, page in zip(batch["path"], batch["name"], batch["page_index"], strict=True):
                target = os.path.join(folder, name)
                try:
                    if pd.isna(page):
                        shutil.copyfile(path, target + ".part")
                    else:
                        with open(path, "rb") as file, open(target + ".part", "wb") as out:
                            out.write(page_writer(file.read(), int(page)))
                    os.replace(target + ".part", target)
                    ok.append(True)
                except Exception:  # whatever ails one file must not end the others
                    ok.append(False)
            yield batch[["row", "name"]].assign(ok=ok)

    return todo.select("row", "name", "path", "page_index").mapInPandas(copy, "row int, name string, ok boolean")


def _pages(docs: DataFrame) -> DataFrame:
    page = F.col("page_index") if "page_index" in docs.columns else F.lit(None)
    return docs.select("doc_id", "path", page.cast("int").alias("page_index"))


def copy_matched(plan: DataFrame, docs: DataFrame, folder: str, page_writer: PageWriter | None = None) -> DataFrame:
    """row, name, ok: the matched files under their reference names in a fresh folder. The result is written, so that no
    file is copied twice."""
    shutil.rmtree(folder, ignore_errors=True)
    names = link.cells(plan, docs).filter("name IS NOT NULL").select("row", "name")
    todo = names.join(plan.select("row", "doc_id"), "row").join(_pages(docs), "doc_id")
    return snapshot(copy_files(todo, folder, page_writer), "copied")


def copy_flagged(docs: DataFrame, folder: str, page_writer: PageWriter | None = None) -> DataFrame:
    """The documents, those that need review with ``review_pdf_path``, or an event if their copy failed."""
    todo = docs.filter(needs_review()).join(_pages(docs).select("doc_id", F.col("page_index").alias("_page")), "doc_id")
    todo = todo.select("doc_id", F.lit(0).alias("row"), F.concat("doc_id", F.lit("__"), "filename").alias("name"), "path", F.col("_page").alias("page_index"))
    done = snapshot(copy_files(todo, folder, page_writer), "copied").select(F.split("name", "__")[0].alias("_id"), F.col("name").alias("_name"), "ok")
    out = docs.join(done, F.col("doc_id") == F.col("_id"), "left").withColumn("review_pdf_path", F.when(F.col("ok"), F.concat(F.lit(folder.rstrip("/") + "/"), "_name")))
    return with_event(out, ~F.col("ok"), "review", "copy_failed", F.col("path"), "warn").drop("_id", "_name", "ok")


def link_workbook(spark: SparkSession, run: str, template: str, docs: DataFrame, now: DataFrame, page_writer: PageWriter | None = None, sheet: str = SHEET, ref_header: str = REF_HEADER) -> tuple[str, DataFrame]:
    """Match the return, copy the matched files flat, and write the return with its references and the report beside the
    template's sheets: the workbook's path and the plan. The run is locked for edits meanwhile."""
    with lease.Lease(run, "export") as own:
        plan, whole = link_now(docs, read_return(spark, template, sheet, ref_header), now)
        copied = copy_matched(plan, whole, os.path.join(run, "linked"), page_writer)
        out = os.path.join(run, os.path.splitext(os.path.basename(template))[0] + "_linked.xlsx")
        cells = {r["row"]: r["cell"] for r in link.cells(plan, whole, copied).toLocalIterator()}  # a sheet's rows, which one file holds
        report = [["metric", "value"], *([r["metric"], r["value"]] for r in link.report(plan, whole, copied, os.path.basename(template), sheet).collect())]
        for title, section in link.report_sections(plan, whole).items():
            rows = [list(r) for r in section.orderBy("row").toLocalIterator()]
            if rows:
                report += [[], [link.SECTIONS[title]], link.section_header(section.columns), *rows]
        fill_workbook(template, out, sheet, ref_header, cells, {REPORT_SHEET: report})
        save_plan(plan, run, own)
    return out, plan


def flagged(docs: DataFrame) -> DataFrame:
    """Documents that need review, the least sure first."""
    return docs.filter(needs_review()).orderBy("confidence", "path")
