"""Deep pages of a listing: documents kept in ranges of their paths, so that a page reads the ranges it lies in.

The table is dealt into ranges of (path, id) once, and each range is a folder. A page is found by counting what each range
holds of the answer, which a filter of the same pass restricts, and by the sums of these counts before each range; only the
ranges that the page lies in are then read and sorted, whichever page it is.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.operators.finder import grep

#: Rows of a range, about.
RANGE = 20_000


def write_listing(docs: DataFrame, path: str, rows: int = RANGE) -> None:
    """Write documents in ranges of the order in which they are listed: by path without case, then by id."""
    n = docs.count()
    keyed = docs.withColumn("list_key", F.lower(F.array_join("rel_parts", "/")))
    if not n:  # partitions of no rows would leave no file, and so no schema
        keyed.write.mode("overwrite").parquet(f"{path}/list_range=0")
        return
    dealt = keyed.repartitionByRange(-(-n // rows), "list_key", "doc_id").withColumn("list_range", F.spark_partition_id())
    dealt.sortWithinPartitions("list_range", "list_key", "doc_id").write.mode("overwrite").partitionBy("list_range").parquet(path)


def page_of_listing(spark: SparkSession, path: str, query: str = "", page: int = 1, page_size: int = 50, include_hidden: bool = False) -> tuple[DataFrame, dict]:
    """``finder.flat`` of the documents written to ``path``: one page of those that ``grep`` finds, and total, page and pages."""
    stored = spark.read.parquet(path)
    found = grep(stored, query, include_hidden)
    counts = sorted(tuple(r) for r in found.groupBy("list_range").count().collect())  # a row for each range
    ends = list(accumulate(n for _, n in counts))
    total, size = ends[-1] if ends else 0, max(1, page_size)
    pages = -(-total // size)
    page = min(max(1, page), max(1, pages))
    first, last = (page - 1) * size, min(page * size, total)
    wanted = [k for k, (_, end) in enumerate(zip(counts, ends, strict=True)) if end > first and end - counts[k][1] < last]
    told = {"total": total, "page": page, "pages": pages, "page_size": size}
    columns = [c for c in stored.columns if c not in ("list_key", "list_range")]
    if not wanted:
        return stored.select(*columns).limit(0), told
    folders = [f"{path}/list_range={counts[k][0]}" for k in wanted]
    rows = grep(spark.read.schema(stored.schema).option("basePath", path).parquet(*folders), query, include_hidden)
    before = ends[wanted[0]] - counts[wanted[0]][1]
    return rows.orderBy("list_key", "doc_id").offset(first - before).limit(size).select(*columns), told
