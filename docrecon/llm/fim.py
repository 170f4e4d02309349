"""Fill-in-middle transformation: texts cut in three and put together with the middle last, in DuckDB on Arrow batches.

Every batch is registered as a view and one SQL statement transforms it; no row is touched by Python. Where a text is cut
and in which form it comes out depends on the SHA-256 of the seed and the document's id alone, so it doesn't change with
partitions, attempts or other rows.

A text is matched into units from left to right, first in blocks of ``BLOCK`` units, of which only the two that hold a cut
are matched into single units. So memory grows with the bytes of a batch and not with a list item for each of its units.

Edge cases: a null or empty text is plain, and so is one that holds a sentinel, whose output could not be told apart. A null
id counts as an empty one. Rows that repeat come out alike, each of them. Other columns are ignored. A text longer than a
piece is a batch by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.ranges import pieces
from docrecon.llm.storage import bounded

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a block; texts and rows of a batch.
BLOCK, ROWS = 64, 2048
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

_JOINED = "CREATE MACRO joined(l, a, b) AS coalesce(array_to_string(list_slice(l, a, b), ''), '')"
_SQL = f"""
WITH matched AS (
  SELECT doc_id, text, sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(text, $blocks) AS b FROM docs
), counted AS (
  SELECT *, {BLOCK} * greatest(len(b) - 1, 0) + coalesce(len(regexp_extract_all(b[-1], $unit)), 0) AS n,
         list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS draw
  FROM matched
), placed AS (
  SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS lo, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS hi,
         CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR draw[3] % 100 >= $plain THEN 'plain'
              WHEN draw[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), opened AS (
  SELECT *, regexp_extract_all(b[lo // {BLOCK} + 1], $unit) AS at_lo, regexp_extract_all(b[hi // {BLOCK} + 1], $unit) AS at_hi FROM placed
), cut AS (
  SELECT *, joined(b, 1, lo // {BLOCK}) || joined(at_lo, 1, lo % {BLOCK}) AS prefix,
         CASE WHEN lo // {BLOCK} = hi // {BLOCK} THEN joined(at_lo, lo % {BLOCK} + 1, hi % {BLOCK})
              ELSE joined(at_lo, lo % {BLOCK} + 1, {BLOCK}) || joined(b, lo // {BLOCK} + 2, hi // {BLOCK}) || joined(at_hi, 1, hi % {BLOCK}) END AS middle,
         joined(at_hi, hi % {BLOCK} + 1, {BLOCK}) || joined(b, hi // {BLOCK} + 2, len(b)) AS suffix
  FROM opened
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                 ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM cut
"""


def transform(docs: DataFrame, seed: str = "1", plain: int = 90, spm: int = 20, unit: str = ".") -> DataFrame:
    """``docs`` (doc_id, text) as training examples: doc_id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is what a cut doesn't divide, an RE2 pattern whose matches cover every text: a code point unless told
    otherwise, ``\\S+|\\s+`` for words. ``n`` and the lengths count units. Of a hundred texts about ``plain`` are
    rearranged, and of a hundred of these ``spm`` with the suffix first.
    """
    # A possible next unit never changes the match of the one before it, so blocks hold whole units.
    given = {"seed": seed, "plain": plain, "spm": spm, "unit": f"(?s){unit}", "blocks": f"(?s)(?:{unit}){{1,{BLOCK}}}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            con.execute(_JOINED)
            for piece in pieces(batches, ROWS):
                con.register("docs", pa.Table.from_batches([piece]))
                yield from con.sql(_SQL, params=given).to_arrow_table().cast(_ARROW).to_batches()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return bounded(texts).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
