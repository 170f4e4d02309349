"""Range buckets: rows dealt into ordered, nearly equal intervals of a key, as a plain column expression.

Unlike ``repartitionByRange`` the cut is a value of the row and not of the run, so totals by bucket and rows by bucket
agree even if a lost executor makes Spark compute either of them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, key: str, parts: int, accuracy: int = 100) -> list:
    """``parts - 1`` ascending approximate quantiles of ``key``. A value that holds many rows repeats, and so do nulls,
    which come first as None."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.select(F.percentile_approx(key, shares, max(10_000, accuracy * parts)).alias("q"), F.count("*").alias("n"), F.count(key).alias("known")).first()
    nulls = row["n"] - row["known"]
    if not nulls:
        return list(row["q"] or [])
    own = min(parts - 1, max(1, round(parts * nulls / row["n"])))
    known = list(row["q"] or [])
    rest = parts - own  # buckets of what isn't null, cut at every so many of the quantiles
    return [None] * own + [known[round(i * parts / rest) - 1] for i in range(1, rest) if known]


def _before(points: Column, n: int, holds) -> Column:
    """How many of the ``n`` ascending points come before the first that ``holds`` is false of, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & holds(F.try_element_at(points, at + step)), at + step).otherwise(at))


def bucket_of(key: Column, spread: Column, cuts: list, kind: str) -> Column:
    """The bucket of a row: 0 to ``len(cuts)``, ascending in (key, spread); nulls come first.

    Rows of a key that holds several cut points (a hot key, or null) are spread over as many buckets by ``spread``, a
    value from 0 to below 1.
    """
    if not cuts:
        return F.lit(0)
    nulls = sum(c is None for c in cuts)
    known = cuts[nulls:]
    at = F.lit(0)
    if known:
        points = F.array(*[F.lit(c) for c in known]).cast(f"array<{kind}>")
        below, upto = _before(points, len(known), lambda c: c < key), _before(points, len(known), lambda c: c <= key)
        at = below + F.when(upto - below > 1, F.floor(spread * (upto - below))).otherwise(0)
    return F.when(key.isNull(), F.floor(spread * nulls)).otherwise(at + nulls).cast("int")


def spread_of(*columns: Column) -> Column:
    """A reproducible value from 0 to below 1 made of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / F.lit(float(1 << 20))


def shuffle_parts(df: DataFrame, least: int = 1) -> int:
    """The number of partitions that the session deals shuffles into."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of ``rows`` rows and of ``size`` bytes of ``column`` at most; a longer text is a piece by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = min(low + rows, max(low + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(low, high - low)
            low = high
