"""Folder trees as tables of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.settings import DEFAULTS, FY_FOLDER, Settings
from docrecon.sources.folders import list_folder, year_name
from docrecon.sources.shared import snapshot

FILES = "path string, modificationTime timestamp, length long, content binary"


def fy_folders(root: str) -> list[str]:
    """Names of the financial-year folders directly under ``root``, sorted; none if it can't be read."""
    try:
        with os.scandir(root) as found:
            return sorted(e.name for e in found if e.is_dir() and re.match(FY_FOLDER, e.name))
    except OSError:
        return []


def scan_tree(spark: SparkSession, root: str, settings: Settings = DEFAULTS, content: bool = False) -> DataFrame:
    """path, filename, size_bytes (and content) of the PDF files under ``root``.

    With a year set, only that year's folders and the folders of no year are listed. Bytes are read only if asked for.
    """
    names = fy_folders(root)
    paths = [root]
    if settings.fy_scope and names:
        with os.scandir(root) as found:
            paths = [e.path for e in found if e.is_dir() and (e.name not in names or year_name(e.name) == year_name(settings.fy_scope))]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]")
    files = reader.load(paths) if paths else spark.createDataFrame([], FILES)
    return named(files, content)


def walk(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    """path, filename, size_bytes of the PDF files under ``root``, names that begin with a dot or an underscore among them,
    which Spark's file source leaves out.

    Executors list the folders, a level of the tree at a time; only the folders of a level are a table, and it is written
    between levels. Other banks' folders, and with a year set those of other years, are left out at any depth. Folders that
    can't be read hold nothing.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column("path").to_pylist():
                folders, files = list_folder(folder, settings.root, settings.fy_scope, settings.bank_scope)
                rows += [(path, None, None, True) for path in folders] + [(*file, False) for file in files]
            kinds = {"path": pa.string(), "filename": pa.string(), "size_bytes": pa.int64(), "folder": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    level, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        here = snapshot(level.mapInArrow(listed, "path string, filename string, size_bytes long, folder boolean"), "tree-level")
        own_files = here.filter("NOT folder").drop("folder")
        files = own_files if files is None else files.unionByName(own_files)
        level = here.filter("folder").select("path")
        if level.isEmpty():
            return files
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(files: DataFrame, content: bool = False) -> DataFrame:
    """Files of the binary reader with plain paths."""
    path = F.regexp_replace("path", "^file:/*", "/")
    keep = ["path", "filename", "size_bytes", *(["content"] if content else [])]
    return files.withColumns({"path": path, "filename": F.element_at(F.split(path, "/"), -1), "size_bytes": F.col("length")}).select(*keep)


def explode_pages(files: DataFrame, pages: str = "pages") -> DataFrame:
    """A row for each page of files of several pages (``page_index`` from 0); other files stay as they are.

    ``pages`` is a column of page counts, null where the count isn't known.
    """
    many = F.col(pages) > 1
    index = F.explode(F.when(many, F.sequence(F.lit(0), F.col(pages) - 1)).otherwise(F.array(F.lit(None).cast("int"))))
    key = F.concat(F.lit("local:"), "path", F.coalesce(F.concat(F.lit("#page="), F.col("page_index").cast("string")), F.lit("")))
    return files.withColumn("page_index", index).withColumn("source_key", key).drop(pages)
