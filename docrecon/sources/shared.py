"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch.
BATCH = 4 << 20
_UNBOUNDED = (1 << 31) - 1

_kept: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a single machine gets a folder of its own; on
    a cluster that would be another folder on each machine, so it is an error there."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docrecon-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: the lineage ends here, and what follows plans on a plain scan."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python Arrow batches of ``BATCH`` bytes at most, however long texts are.

    Spark bounds batches by their rows alone unless this is set. A bound that the session has set stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(_UNBOUNDED))) >= _UNBOUNDED:
        conf.set(name, str(BATCH))
    return df


def folder_once(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """The folder of this name that the application has filled already, else a new one that ``make`` fills."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
        make(path)
        _kept[key] = path
    return _kept[key]


def is_kept(spark: SparkSession, name: str) -> bool:
    """Whether the application has filled the folder of this name."""
    return (spark.sparkContext.applicationId, name) in _kept


def snapshot_once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The snapshot of this name that the application has made already, else a new one."""
    return spark.read.parquet(folder_once(spark, name, lambda path: make().write.parquet(path)))


def forget() -> None:
    """Make snapshots anew from now on."""
    _kept.clear()
