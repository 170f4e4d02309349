"""Shared storage: where intermediate tables and output files go, and how executors open them.

Everything an operator writes lies under the folder that the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors share.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from docrecon.sources.shared import bounded, shared_dir

__all__ = ["bounded", "create", "fresh_path", "map_array", "materialize", "open_random"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. Rows come back as they were written, so what a
    nondeterministic plan decided (a partition number, say) is decided once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def create(uri: str):
    """Open ``uri`` for writing bytes, on the local file system or on one that pyarrow knows."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def open_random(uri: str):
    """Open ``uri`` for reading at any position."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def map_array(uri: str, dtype, offset: int, count: int):
    """``count`` items of ``dtype`` from byte ``offset`` on: memory-mapped where the file is local, read otherwise."""
    import numpy as np

    if count == 0:
        return np.empty(0, dtype)
    if (path := _local(uri)) is not None:
        return np.memmap(path, dtype, "r", offset, (count,))
    with open_random(uri) as file:
        file.seek(offset)
        return np.frombuffer(file.read(count * np.dtype(dtype).itemsize), dtype)
