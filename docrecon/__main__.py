"""Command line: ``python -m docrecon`` scan, gate, years, runs, export, link-gstr."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from docrecon import api
from docrecon.settings import Settings
from docrecon.sources import runs, tree
from docrecon.sources.workbook import REF_HEADER, SHEET
from docrecon.streaming import ingest
from docrecon.streaming.control import Gate, Progress, terminal


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("docrecon").getOrCreate()


def _named(where: str | None):
    """The object that ``module:name`` names."""
    if not where:
        return None
    module, _, name = where.partition(":")
    return getattr(importlib.import_module(module), name)


def _run(args) -> str:
    run = args.run or runs.latest_run(args.out)
    if not run or not runs.read_meta(run).get("root"):
        raise SystemExit(f"no run under {args.out}")
    return run


def cmd_scan(args) -> None:
    """A new run, the newest unfinished one of the same scope, or one that is named."""
    if args.continue_run:
        meta = runs.read_meta(args.continue_run)
        run, root, fy = args.continue_run, meta.get("root"), meta.get("fy")
        if not root:
            raise SystemExit(f"{run} is no run folder")
    elif args.root:
        root, fy = os.path.abspath(args.root), args.fy
        years = tree.fy_folders(root)
        if fy and tree.year_name(fy) not in map(tree.year_name, years):
            raise SystemExit(f"no folder of {fy} under {root}; there are: {', '.join(years) or 'none'}")
        run = runs.find_resumable(args.out, root, fy) or runs.new_run(args.out, root, fy)
    else:
        raise SystemExit("--root or --continue-run is needed")
    if args.gstr:
        runs.keep_workbook(run, args.gstr)
    spark, gate = _spark(), Gate(os.path.join(run, "gate"))
    gate.reopen()
    progress = Progress(os.path.join(run, "status.json"), gate, () if args.quiet else (terminal(sys.stderr),))
    complete = ingest.scan(spark, run, root, _named(args.provider), Settings(root=root, fy_scope=fy), gate=gate, progress=progress)
    docs = api.load(spark, run)
    if docs is not None:
        api.save(api.corpus_passes(docs), run)
    print(run, "complete" if complete else "incomplete")


def cmd_years(args) -> None:
    print("\n".join(tree.fy_folders(args.root)))


def cmd_runs(args) -> None:
    for r in runs.recent_runs(args.out):
        print(r["run_id"], r["root"], r.get("fy") or "-", "complete" if r.get("complete") else "incomplete")


def cmd_gate(args) -> None:
    """Pause, resume or stop the scan of a run, which another process may be running."""
    getattr(Gate(os.path.join(_run(args), "gate")), args.do)()


def cmd_export(args) -> None:
    run, spark = _run(args), _spark()
    docs = api.load(spark, run)
    template = runs.find_workbook(run)
    if template:
        from docrecon.sources.workbook import read_return

        plan, docs = api.link_now(docs, read_return(spark, template), api.decided(spark, run))
        api.export(plan, docs, os.path.join(run, "export"), template=os.path.basename(template))
    else:
        api.master_sheet(docs).write.mode("overwrite").parquet(os.path.join(run, "export", "master"))
    print(os.path.join(run, "export"))


def cmd_link(args) -> None:
    run, spark = _run(args), _spark()
    template = runs.keep_workbook(run, args.gstr)
    out, plan = api.link_workbook(spark, run, template, api.load(spark, run), api.decided(spark, run), _named(args.page_writer), args.sheet, args.ref_column)
    print(out)
    for r in plan.groupBy("status").count().orderBy("status").collect():
        print(r["status"], r["count"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docrecon", description="Detect invoices in a folder tree and reconcile them with a return")
    p.add_argument("--out", default="out", help="folder of the runs")
    sub = p.add_subparsers(dest="cmd", required=True)
    scan = sub.add_parser("scan", help="scan a folder tree, or go on with a run")
    scan.add_argument("--root")
    scan.add_argument("--continue-run", metavar="RUN")
    scan.add_argument("--fy", help="only this financial year's folder")
    scan.add_argument("--gstr", help="workbook of the return to match")
    scan.add_argument("--provider", required=True, metavar="MODULE:NAME", help="text provider")
    scan.add_argument("--quiet", action="store_true")
    scan.set_defaults(run_command=cmd_scan)
    years = sub.add_parser("years", help="financial-year folders under a root")
    years.add_argument("--root", required=True)
    years.set_defaults(run_command=cmd_years)
    sub.add_parser("runs", help="the newest runs").set_defaults(run_command=cmd_runs)
    gate = sub.add_parser("gate", help="pause, resume or stop a run's scan")
    gate.add_argument("do", choices=["pause", "resume", "stop"])
    gate.add_argument("--run")
    gate.set_defaults(run_command=cmd_gate)
    export = sub.add_parser("export", help="write a run's sheets again")
    export.add_argument("--run")
    export.set_defaults(run_command=cmd_export)
    link = sub.add_parser("link-gstr", help="match a return, copy its files and fill its reference column")
    link.add_argument("--run")
    link.add_argument("--gstr", required=True)
    link.add_argument("--sheet", default=SHEET)
    link.add_argument("--ref-column", default=REF_HEADER)
    link.add_argument("--page-writer", metavar="MODULE:NAME", help="writes a page of a file as a file of one page")
    link.set_defaults(run_command=cmd_link)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run_command(args)


if __name__ == "__main__":
    main()
