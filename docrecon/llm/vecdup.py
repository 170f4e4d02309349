"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c or more lie within epsilon = sqrt(2 - 2c) of each other, and so do their projections on any
orthonormal axes. Vectors are projected on their leading principal axes, put into grid cells of side epsilon, and sorted
by label and cells in turn: the epsilon grid order. Equal vectors are joined to one first. The sequence is cut into
intervals of bounded bytes; the bounding boxes of intervals tell which pairs of intervals can hold a link at all, and
each such pair is joined in a task by halving the intervals recursively, dropping halves whose boxes are more than
epsilon apart, down to short ones that are compared by cosine in double precision. Intervals are large, so that few
pairs of them have to move; most of the order's work is done by the halving.

From a pair of intervals come the links of a spanning forest and a count of links for each vector, so that output stays
linear in the rows however many links there are.

Edge cases: a vector that is null, empty, zero or has null or non-finite components, or whose label is null, links with
nothing; very long and very short vectors are scaled before their squares are taken. Vectors of different lengths aren't
compared. Rows that share an id are one vector to the components and count one by one as links. A null id is passed
through with no component and is kept. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.graph import components
from docrecon.llm.ranges import shuffle_parts
from docrecon.llm.storage import bounded, materialize

COSINE = 0.98
#: Principal axes of the grid, bytes of an interval's vectors, and rows below which vectors are compared outright.
AXES, INTERVAL, LEAF = 8, 4 << 20, 64
_SLACK = 1e-9


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors at length one. Divided by their greatest component first, their squares neither vanish nor overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def prepare(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the number of their group of equal vectors (null if they link with nothing), and the groups: id
    (smallest of its rows), label, vector, copies."""
    vector = F.col("embedding").cast("array<double>")
    plain = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    checked = rows.select(*plain).withColumn("sound", sound)
    # The label's length stands first, so that no label with commas can be taken for part of a vector.
    named = F.concat(F.length("label").cast("string"), F.lit(":"), "label", F.lit(","), F.array_join(F.col("vector").cast("array<string>"), ","))
    key = F.when(F.col("sound"), F.sha2(named, 256))
    keyed = checked.withColumn("key", key)
    good = keyed.filter("sound AND vec_id IS NOT NULL")
    groups = good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min(F.struct("label", "vector")).alias("x"))
    return keyed.select("vec_id", "key"), groups.select("key", "id", "x.label", "x.vector", "copies")


def principal_axes(groups: DataFrame, dim: int, axes: int = AXES) -> np.ndarray:
    """Leading principal axes of the unit vectors, from sums that each task makes of its rows: dim by axes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            x = _units(batch.column("vector"), dim)
            total[0] += x.sum(axis=0)
            total[1:] += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array([[float(n), *row] for row in total], pa.list_(pa.float64()))], ["row", "s"])

    added = groups.select("vector").mapInArrow(sums, "row long, s array<double>").groupBy("row").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim + 1)])
    rows = {r["row"]: np.array(r[1:], float) for r in added.collect()}  # dim + 1 rows
    n = max(rows[0][0], 1.0)
    mean = rows[0][1:] / n
    cov = np.array([rows[i + 1][1:] for i in range(dim)]) / n - np.outer(mean, mean)
    _, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return np.ascontiguousarray(vectors[:, ::-1][:, : min(axes, dim)])


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, label, embedding)."""
    keyed, groups = prepare(bounded(rows))
    keyed, groups = materialize(keyed, "vector-keys"), materialize(groups, "vectors")
    found = [_links(groups.filter(F.size("vector") == r["d"]), r["d"], cosine) for r in groups.select(F.size("vector").alias("d")).distinct().orderBy("d").collect()]
    spark = rows.sparkSession
    links = spark.createDataFrame([], "a long, b long, n long")
    for more in found:
        links = links.unionByName(more)
    links = materialize(links, "vector-links")
    counts = links.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    classes = components(links.filter("b IS NOT NULL").select("a", "b"))
    g = groups.select("key", "id", "copies").join(counts, F.col("id") == F.col("a"), "left").drop("a").join(classes, F.col("id") == F.col("node"), "left")
    g = g.select(F.col("key").alias("g_key"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.join(g, F.col("key") == F.col("g_key"), "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    n = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    return out.select("vec_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def _links(groups: DataFrame, dim: int, cosine: float) -> DataFrame:
    """a, b, n: links of spanning forests (b set), and numbers of links of a (b null)."""
    eps = float(np.sqrt(max(2 - 2 * cosine, 0.0))) + _SLACK
    axes = principal_axes(groups, dim)
    length = max(512, INTERVAL // (8 * dim))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("vector"), dim)
            cells = np.floor((x @ axes) / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("copies"), pa.array(list(cells), pa.list_(pa.int32())), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "copies", "cells", "unit"])

    ordered = groups.select("id", "label", "copies", "vector").mapInArrow(placed, "id long, label string, copies long, cells array<int>, unit binary")
    parts = shuffle_parts(groups)
    schema = "interval long, label string, slab int, low array<double>, high array<double>, ids binary, copies binary, units binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Intervals of the sequence, each within one label, with their boxes."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def done():
            nonlocal number
            units = np.frombuffer(b"".join(r[3] for r in held)).reshape(-1, dim)
            at = units @ axes
            low, high = at.min(axis=0), at.max(axis=0)
            row = [number, held[0][1], int(np.floor(low[0] / eps)), low.tolist(), high.tolist(), np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[2] for r in held], np.int64).tobytes(), units.tobytes()]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["interval", "label", "slab", "low", "high", "ids", "copies", "units"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "label", "copies", "unit")], strict=True):
                if held and (row[1] != held[0][1] or len(held) == length):
                    yield done()
                held.append(row)
        if held:
            yield done()

    sequence = ordered.repartitionByRange(parts, "label", "cells", "id").sortWithinPartitions("label", "cells", "id")
    intervals = materialize(sequence.select("id", "label", "copies", "unit").mapInArrow(cut, schema), "intervals")

    # Which intervals can meet: equal labels and boxes within epsilon. An interval is entered under every slab of the
    # first axis that it reaches into, and looked up from its own slabs and the next; the pair counts where the later begins.
    boxes = intervals.select("interval", "label", "low", "high")
    slab = lambda x: F.floor(x / eps).cast("int")
    left = boxes.select(F.col("interval").alias("i"), "label", F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.sequence(slab(F.col("low")[0]), slab(F.col("high")[0] + eps))).alias("slab"))
    right = boxes.select(F.col("interval").alias("j"), F.col("label").alias("label2"), F.col("low").alias("l2"), F.col("high").alias("h2"), slab(F.col("low")[0]).alias("slab2"))
    apart = F.aggregate(F.zip_with(F.zip_with("l1", "h2", lambda a, b: a - b), F.zip_with("l2", "h1", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    first = F.struct(F.col("l1")[0], F.col("i"))
    second = F.struct(F.col("l2")[0], F.col("j"))
    pairs = left.join(right, (F.col("label") == F.col("label2")) & (F.col("slab") == F.col("slab2")) & (first <= second) & (apart <= eps * eps)).select("i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair's intervals come one after the other; an interval that meets itself comes alone."""
        last, first = None, None

        def joined(a, b):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in join_intervals(a, b, axes, eps, cosine)], ["a", "b", "n"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pair, side = (row["i"], row["j"]), _side(row, dim)
                if row["i"] == row["j"]:
                    yield joined(side, side)
                elif pair == last:
                    yield joined(first, side)
                    first = None
                else:
                    last, first = pair, side

    # Each interval moves once for each pair that it is in.
    needed = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("which"))
    payload = intervals.select(F.col("interval").alias("which"), "ids", "copies", "units")
    met = needed.join(payload, "which").repartition(parts, "i", "j").sortWithinPartitions("i", "j", "which")
    return met.select("i", "j", "ids", "copies", "units").mapInArrow(meet, "a long, b long, n long")


def _side(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64), np.frombuffer(row["units"]).reshape(-1, dim)


def join_intervals(a: tuple, b: tuple, axes: np.ndarray, eps: float, cosine: float) -> tuple[list[int], list, list]:
    """Links between two intervals (or inside one, if they are the same object): spanning forest and counts."""
    same = a is b
    (ids_a, copies_a, x), (ids_b, copies_b, y) = a, b
    at_x, at_y = x @ axes, y @ axes
    count_a, count_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    tree: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(n: int) -> int:
        while tree.setdefault(n, n) != n:
            tree[n] = n = tree[tree[n]]
        return n

    def recurse(r: range, s: range) -> None:
        if same and s.stop <= r.start:
            return
        p, q = at_x[r.start : r.stop], at_y[s.start : s.stop]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if gap @ gap > eps * eps:
            return
        if len(r) <= LEAF and len(s) <= LEAF:
            near = x[r.start : r.stop] @ y[s.start : s.stop].T >= cosine
            if same:
                near &= np.arange(r.start, r.stop)[:, None] < np.arange(s.start, s.stop)
            if near.any():
                i, j = np.nonzero(near)
                i, j = i + r.start, j + s.start
                np.add.at(count_a, i, copies_b[j])
                np.add.at(count_a if same else count_b, j, copies_a[i])
                for u, v in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        tree[ru] = rv
                        out.append((u, v))
            return
        halves = lambda z: (z[: len(z) // 2], z[len(z) // 2 :]) if len(z) > LEAF else (z,)
        for f in halves(r):
            for g in halves(s):
                recurse(f, g)

    recurse(range(len(x)), range(len(y)))
    hit_a, hit_b = np.flatnonzero(count_a), np.flatnonzero(count_b)
    ids = [*[u for u, _ in out], *ids_a[hit_a].tolist(), *ids_b[hit_b].tolist()]
    others = [*[v for _, v in out], *[None] * (len(hit_a) + len(hit_b))]
    numbers = [*[None] * len(out), *count_a[hit_a].tolist(), *count_b[hit_b].tolist()]
    return ids, others, numbers
