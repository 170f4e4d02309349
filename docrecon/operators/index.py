"""A search index that is kept: postings in buckets of tokens, and the vocabulary with how many documents hold each token.

Documents come in batches, each a folder of its own, which replaces itself if the batch is written again. A query goes
through the vocabulary, which is small, and reads only the buckets of the tokens that answer it, whatever else is indexed.
A document that was edited is indexed again in a later batch; what a posting says is checked against the document as it is
now, so old postings find nothing wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.operators.finder import haystack, postings, query_words, ranked, searched, token_scores
from docrecon.sources.shared import snapshot

BUCKETS = 256


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def add(docs: DataFrame, index: str, batch: int = 0) -> None:
    """Write the postings of a batch of documents, and their vocabulary. Hidden ones too: who searches decides."""
    posts = snapshot(postings(docs), "postings").withColumn("bucket", _bucket(F.col("token")))
    posts.repartition("bucket").sortWithinPartitions("bucket", "token", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/postings/batch={batch}")
    posts.groupBy("token").agg(F.count("*").alias("docs")).write.mode("overwrite").parquet(f"{index}/vocabulary/batch={batch}")


def vocabulary(spark: SparkSession, index: str) -> DataFrame:
    """token, docs (of all batches; a document that was indexed twice counts twice)."""
    return spark.read.schema("token string, docs long, batch int").parquet(f"{index}/vocabulary").groupBy("token").agg(F.sum("docs").alias("docs"))


def postings_of(spark: SparkSession, index: str, tokens: DataFrame) -> DataFrame:
    """token, doc_id of the ``tokens``, from their buckets alone, which are numbers below ``BUCKETS``."""
    wanted = sorted(r[0] for r in tokens.select(_bucket(F.col("token"))).distinct().collect())
    schema = "token string, doc_id string, batch int, bucket int"
    if not wanted:
        return spark.createDataFrame([], schema).select("token", "doc_id")
    # Folders by name, so that others aren't even listed; a token of the vocabulary has its bucket in a batch at least.
    stored = spark.read.schema(schema).option("basePath", f"{index}/postings").parquet(*[f"{index}/postings/batch=*/bucket={b}" for b in wanted])
    return stored.join(tokens.select("token").distinct(), "token", "left_semi").select("token", "doc_id").distinct()


def answering(spark: SparkSession, index: str, words: Sequence[str]) -> DataFrame:
    """pos, token, s: the tokens of the vocabulary that answer each word of a query."""
    return snapshot(token_scores(words, vocabulary(spark, index)), "answering")


def search(docs: DataFrame, index: str, query: str, limit: int | None = 20, invoices_only: bool = False, include_hidden: bool = False) -> DataFrame:
    """``finder.search`` from the index: the same documents, scores and order. ``docs`` are those that are indexed."""
    key, words = query_words(query)
    pool = searched(docs, invoices_only, include_hidden)
    if not words:
        return ranked(pool.limit(0), key, docs.select("doc_id", F.lit(0.0).alias("mean")).limit(0), limit)
    spark = docs.sparkSession
    tokens = answering(spark, index, words)
    found = tokens.join(postings_of(spark, index, tokens), "token")
    now = pool.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.split(haystack(), " ").alias("held"))
    held = found.join(now, "doc_id").filter(F.array_contains("held", F.col("token")))
    means = held.groupBy("doc_id", "pos").agg(F.max("s").alias("s")).groupBy("doc_id").agg((F.sum("s") / len(words)).alias("mean"))
    return ranked(pool, key, means, limit)
