"""Run folders: snapshot, ledger, metadata and decisions of a scan, and how runs are found again.

A run folder holds versions of ``snapshot`` and ``link`` and the ``ledger`` (Parquet), ``decisions`` (Parquet, appended),
the return's workbook, and ``run_meta.json``. Run folders lie on a file system that is mounted on the driver and, for
what executors write, on all executors.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecon.sources.lease import Lease, locked, put_meta, read_meta, write_meta


def slug(text: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "-", text).strip("-")


def new_run(out_root: str, root: str, fy: str | None = None, pages: bool = True) -> str:
    """Make a run folder named by time and scope; returns its path."""
    name = "run_" + dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d-%H%M%S-%f") + (f"_{slug(fy)}" if fy else "")
    path = os.path.join(out_root, name)
    os.makedirs(path)
    write_meta(path, root=root, fy=fy, pages=pages, complete=False)
    return path


def keep_workbook(run: str, path: str) -> str:
    """Copy the return into the run, so that the run stays whole if the original moves; returns the path to use from now on."""
    kept = os.path.abspath(os.path.join(run, os.path.basename(path)))
    try:
        if os.path.abspath(path) != kept:
            shutil.copy2(path, kept)
    except OSError:
        kept = os.path.abspath(path)
    write_meta(run, gstr_path=kept, gstr_original=os.path.abspath(path))
    return kept


def find_workbook(run: str) -> str | None:
    """The run's return: where the metadata says, else the copy of that name in the run folder, else where it came from."""
    meta = read_meta(run)
    named = meta.get("gstr_path")
    tried = [named, os.path.join(run, os.path.basename(named)) if named else None, meta.get("gstr_original")]
    return next((p for p in tried if p and os.path.isfile(p)), None)


def save_table(spark: SparkSession, run: str, name: str, df: DataFrame, lease: Lease | None = None) -> None:
    """Write a table of the run beside its last version, then point the metadata at it, which is one replacement of a
    file: whoever reads sees the one or the other. The version before last goes. For a job its ``lease`` is asked before
    the metadata changes."""
    with locked(run):
        meta = read_meta(run)
        number = meta.get(f"{name}_version", 0) + 1
        put_meta(run, meta | {f"{name}_version": number})
    fresh = f"{name}-{number:06d}"
    df.write.mode("overwrite").parquet(os.path.join(run, fresh))
    with lease.writing() if lease else locked(run):
        meta = read_meta(run)
        old = meta.get(name)
        put_meta(run, meta | {name: fresh, f"{name}_before": old})
    for entry in os.listdir(run):
        if re.fullmatch(rf"{name}-[0-9]{{6}}", entry) and entry < fresh and entry != old:
            shutil.rmtree(os.path.join(run, entry), ignore_errors=True)


def load_table(spark: SparkSession, run: str, name: str) -> DataFrame | None:
    """The table's last version, None where there is none or it can't be read."""
    here = read_meta(run).get(name)
    path = os.path.join(run, here) if here else None
    if not path or not os.path.isfile(os.path.join(path, "_SUCCESS")):
        return None
    return spark.read.parquet(path)


def recent_runs(out_root: str, limit: int = 10) -> list[dict]:
    """The newest valid run folders, by time of change."""
    found = []
    for entry in os.scandir(out_root) if os.path.isdir(out_root) else ():
        meta = read_meta(entry.path) if entry.is_dir() else {}
        if meta.get("root"):
            found.append({"path": entry.path, "run_id": entry.name, "changed": entry.stat().st_mtime} | meta)
    return sorted(found, key=lambda r: (-r["changed"], r["run_id"]))[:limit]


def latest_run(out_root: str) -> str | None:
    """The run folder with the greatest name."""
    names = [e.path for e in os.scandir(out_root) if e.is_dir() and e.name.startswith("run_")] if os.path.isdir(out_root) else []
    return max(names, default=None)


def find_resumable(out_root: str, root: str, fy: str | None, pages: bool | None = None) -> str | None:
    """The newest incomplete run of the same tree and year (and page mode, if given) whose scan has begun."""
    own = lambda m: m.get("root") == root and m.get("fy") == fy and not m.get("complete") and (pages is None or m.get("pages") == pages)
    found = [e.path for e in os.scandir(out_root) if e.is_dir() and own(m := read_meta(e.path)) and (m.get("pass") or os.path.isdir(os.path.join(e.path, "ledger")))] if os.path.isdir(out_root) else []
    return max(found, default=None)


def describe(spark: SparkSession, run: str) -> dict:
    """Root, year, whether complete, how many documents are done, and whether the tree is still there."""
    meta, ledger = read_meta(run), os.path.join(run, "ledger")
    if not meta.get("root"):
        raise ValueError(f"{run} is no run folder")
    done = spark.read.parquet(ledger).agg(F.count_distinct("source_key")).first()[0] if os.path.isdir(ledger) and os.listdir(ledger) else 0
    return {k: meta.get(k) for k in ("root", "fy", "pages", "complete")} | {"gstr_path": find_workbook(run), "done": done, "tree_exists": os.path.isdir(meta["root"])}


def read_ledger_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; lines that are blank or torn are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_write(ledger: DataFrame, key: str = "source_key", order: str = "seq") -> DataFrame:
    """The last row of each key, with ``position``, the order in which the key came first.

    Two aggregates merged before the shuffle, so a key that was written often is one row a task.
    """
    rest = [c for c in ledger.columns if c != key]
    summed = ledger.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"), F.min(order).alias("position"))
    return summed.select(key, *[F.col("x")[c].alias(c) for c in rest], "position")


def overlay_ledger(snapshot: DataFrame, ledger: DataFrame, key: str = "source_key") -> DataFrame:
    """The snapshot and those rows of the ledger whose keys it lacks."""
    return snapshot.unionByName(ledger.join(snapshot.select(key), key, "left_anti"), allowMissingColumns=True)


def unfinished(seeds: DataFrame, ledger: DataFrame, key: str = "source_key") -> DataFrame:
    """Seeds that the ledger doesn't have."""
    return seeds.join(ledger.select(key).distinct(), key, "left_anti")


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Rows ``(page - 1) * size`` onward, ``size`` of them, in an order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def duplicates_numbered(df: DataFrame, name: str, order: str) -> DataFrame:
    """Add ``nth``: how many rows of the same name come before."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1)
