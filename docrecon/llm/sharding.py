"""Contiguous shards of nearly equal bytes, from global prefix sums made of per-bucket totals. DataFrame functions only.

Edge cases: a null or empty text weighs ``overhead`` bytes. A null document id comes first. Rows that share a document
id, null too, follow each other in the order of a hash, by which many of them are spread over several buckets; equal rows
are counted and then told apart by a number, and are interchangeable. An empty table gives no rows. Other columns,
whatever their names, are ignored. A document larger than a whole share leaves a neighbouring shard small or empty; it is never split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.ranges import bucket_of, cut_points, shuffle_parts, spread_of
from docrecon.llm.storage import materialize


def balanced_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row.

    The rows in order of doc_id are laid on a line by size; the middle of a row tells its shard, so each shard's bytes
    miss the equal share by at most the halves of the two rows at its ends. The order is never sorted in one place:
    rows are dealt into range buckets, each bucket is summed by itself, and only the bucket totals (``buckets`` rows)
    are summed in one task and sent back. No text is shuffled, only its size and checksum.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    buckets = buckets or shuffle_parts(docs, 8)
    cuts = cut_points(rows.select("doc_id"), "doc_id", buckets)
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n").withColumn("spread", spread_of(F.col("text_crc32"), F.col("size"), F.col("copy")))
    rows = materialize(each.withColumn("bucket", bucket_of(F.col("doc_id"), F.col("spread"), cuts, "bigint")), "shard-rows")

    totals = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    bases = totals.select("bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))

    inside = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "spread", "text_crc32", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside))
    placed = summed.join(F.broadcast(bases), "bucket")  # as many rows as buckets, a parameter
    twice = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")  # twice the row's middle
    share = (twice.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes")).cast("decimal(38,0)")).cast("double")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", F.least(F.floor(share), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("position")), "shard-positions")

    first = placed.groupBy("shard").agg(F.min("position").alias("first_position"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first_position")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
