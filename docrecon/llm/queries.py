"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.llm import bpe, decontam, fim, lm, mixing, neardup, pii, sharding, tokenbin, toxicity, variants, vecdup, warc


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokenbin.token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40, overhead=16)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url_key")


OP4_SQL = """
WITH payload AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), largest AS (
  SELECT digest, max(page_id) AS last_id FROM payload WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN last_id > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id > page_id THEN last_id END AS refers_to
FROM payload p LEFT JOIN largest l ON p.digest = l.digest AND n >= 1000
"""

def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fim.restored(F.col("output"), F.col("form")), 256)}
    return made.withColumns(digests).drop("output")


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), placed AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
         CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, left(t, least(x, y)) AS p, substr(t, least(x, y) + 1, abs(x - y)) AS m, substr(t, greatest(x, y) + 1) AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    decoded = bpe.decode(encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), path)
    return decoded.withColumn("decoded_sha256", F.sha2("text", 256)).drop("text")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Words meet here where they agree after the loss of a letter at one place, or of one of them, and not in bands; the checksum
# is worked out by its polynomial.
OP13_SQL = """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS crcs FROM range(256) t(b)
), found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM counted
), drawn AS (
  SELECT run, n, xor(list_reduce(range(1, length(x), 2), lambda c, i: xor(c >> 8, crcs[xor(c & 255, CAST('0x' || substr(x, i, 2) AS BIGINT)) + 1]), 4294967295), 4294967295) AS h FROM bytes, bits
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n AS times FROM drawn
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), lacking AS (
  SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE left(word, i - 1) || substr(word, i + 1) END AS rest FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), ahead AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT a.word, a.next, f.form FROM ahead a JOIN forms f ON a.next = f.word
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ahead a ON f.word = a.word AND a.next IS NULL
"""

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_vector_duplicates": op7_vector_duplicates,
    "op8_decontamination": op8_decontamination,
    "op9_language_model": op9_language_model,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}
#: The other queries can't be expressed in SQL; their tests compare them with brute force.
ORACLE_SQL = {"op4_warc": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op13_spelling_variants": OP13_SQL}
