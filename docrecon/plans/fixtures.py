"""Invoices and returns rendered from orders and customers, by SQL that Spark and DuckDB read alike.

Remainders of the order key plant the cases: approvals, returns, notes, empty texts, a vendor's own layout, missing
fields, amounts that don't fit, folders and file names that disagree, incomplete paths, and doubled numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROOT = "/tree"

_BASE = """
base AS (
  SELECT o_orderkey AS k, c_custkey AS c, CAST(CAST(o_totalprice AS decimal(18,2)) * 100 AS bigint) AS cents,
         year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
         lpad(CAST(c_nationkey AS string), 2, '0') || 'AAB' || chr(CAST(65 + c_custkey % 26 AS int)) || 'C' || lpad(CAST(c_custkey % 10000 AS string), 4, '0') || 'F1Z5' AS tax_id,
         CASE c_custkey % 5 WHEN 0 THEN 'Apex' WHEN 1 THEN 'Blue Ridge' WHEN 2 THEN 'Cobalt' WHEN 3 THEN 'Delta' ELSE 'Evergreen' END
           || CASE c_custkey % 3 WHEN 0 THEN ' Traders' WHEN 1 THEN ' Consultants' ELSE ' Stores' END AS trade
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
), told AS (
  SELECT *, trade || ' ' || CAST(c % 97 AS string) AS vendor,
         lpad(CAST(CASE WHEN k % 31 = 0 AND k > 0 THEN k - 1 ELSE k END AS string), 7, '0') AS serial,
         lpad(CAST(d AS string), 2, '0') || '-' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * m - 2 AS int), 3) || '-' || CAST(y AS string) AS day_text,
         substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * m - 2 AS int), 3) || '-' || CAST(y AS string) AS month_text,
         CASE WHEN k % 33 = 1 THEN cents + 50000 ELSE cents - cents % 10 END AS net
  FROM base
), priced AS (
  SELECT *, CASE WHEN cents >= 100000 THEN CAST(CAST((cents - cents % 100000) / 100000 AS bigint) AS string) || ',' ELSE '' END
              || lpad(CAST(CAST((cents % 100000 - cents % 100) / 100 AS bigint) AS string), 3, '0') || '.' || lpad(CAST(cents % 100 AS string), 2, '0') AS total_text,
         CASE WHEN net >= 100000 THEN CAST(CAST((net - net % 100000) / 100000 AS bigint) AS string) || ',' ELSE '' END
              || lpad(CAST(CAST((net % 100000 - net % 100) / 100 AS bigint) AS string), 3, '0') || '.' || lpad(CAST(net % 100 AS string), 2, '0') AS net_text
  FROM told
)"""

DOCS = (
    _BASE
    + """, rendered AS (
  SELECT k,
    '/tree/FY ' || lpad(CAST(y % 100 AS string), 2, '0') || '-' || lpad(CAST((y + 1) % 100 AS string), 2, '0') || '/Payments/Kotak/' || month_text || '/'
      || CASE WHEN k % 17 = 4 THEN CAST(y AS string) || '-' || lpad(CAST(m AS string), 2, '0') || '-' || lpad(CAST(d AS string), 2, '0') ELSE day_text END || '/'
      || CASE WHEN k % 19 = 6 THEN '' WHEN k % 29 = 0 THEN 'Omega Stores/' WHEN k % 13 = 0 THEN trade || ' & Sons/' ELSE vendor || ' Pvt Ltd/' END AS folder,
    CASE WHEN k % 7 = 3 THEN 'scan_' || serial WHEN k % 11 = 5 THEN 'Approval-INV-' || serial WHEN k % 43 = 0 THEN 'Invoice_INV-9' || serial ELSE 'Invoice_INV-' || serial END || '.pdf' AS filename,
    CASE
      WHEN k % 10 = 9 THEN 'PURCHASE / EXPENSE APPROVAL' || chr(10) || 'Approval Form' || chr(10) || 'Requested for ' || vendor || chr(10) || 'Invoice No: INV/' || serial
      WHEN k % 50 = 7 THEN 'FORM GSTR-2A' || chr(10) || 'GSTIN ' || tax_id
      WHEN k % 40 = 13 THEN ''
      WHEN k % 37 = 5 THEN 'Meeting notes for ' || vendor
      WHEN k % 23 = 11 THEN 'TAX INVOICE' || chr(10) || 'Zephyr Logistics Pvt Ltd' || chr(10) || 'GSTIN: ' || tax_id || chr(10) || 'Bill No: ZL/' || serial || chr(10)
        || 'Dated: ' || lpad(CAST(d AS string), 2, '0') || '/' || lpad(CAST(m AS string), 2, '0') || '/' || CAST(y AS string) || chr(10)
        || 'Taxable: INR ' || net_text || chr(10) || 'Amount Payable: Rs. ' || total_text
      ELSE 'TAX INVOICE' || chr(10) || vendor || CASE c % 4 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Pvt Ltd' WHEN 2 THEN ' LLP' ELSE '' END || chr(10)
        || CASE WHEN k % 12 = 0 THEN '' ELSE 'GSTIN: ' || tax_id || chr(10) END || 'Invoice No: INV/' || serial || chr(10)
        || CASE WHEN k % 14 = 0 THEN '' ELSE 'Invoice Date: ' || day_text || chr(10) END || 'Place of Supply: Pune' || chr(10) || 'HSN/SAC 9983' || chr(10)
        || CASE WHEN k % 16 = 0 THEN '' ELSE 'Taxable Value Rs. ' || net_text || chr(10) END || CASE WHEN k % 18 = 0 THEN '' ELSE 'Total Invoice Value Rs. ' || total_text || chr(10) END
        || 'Bill To: Harbour Foods' || chr(10) || 'GSTIN: 27AAACH' || lpad(CAST(c % 7 AS string), 4, '0') || 'K1ZQ'
    END AS text
  FROM priced
), inv_docs AS (
  SELECT k, folder || filename AS path, filename, text, CASE WHEN text = '' THEN 'none' WHEN k % 5 = 0 THEN 'ocr' ELSE 'text' END AS source FROM rendered
)"""
)

ROWS = (
    _BASE
    + """, return_rows AS (
  SELECT CAST(k + 2 AS int) AS row,
    CASE WHEN k % 21 = 2 THEN '' WHEN k % 22 = 3 THEN '99ZZZZZ9999Z9Z9' ELSE lower(tax_id) END AS gstin,
    CASE WHEN k % 26 = 4 THEN '' WHEN k % 27 = 5 THEN 'LOST-' || serial WHEN k % 3 = 0 THEN 'INV-' || serial ELSE 'inv/' || serial END AS invoice_no,
    day_text AS invoice_date, vendor AS supplier, total_text AS value,
    CASE WHEN k % 54 = 5 THEN 'kept__' || serial || '.pdf' WHEN k % 54 = 32 THEN 'AMBIGUOUS (2)' ELSE '' END AS existing_ref
  FROM priced WHERE k % 4 <> 1
)"""
)


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rendering of the orders. A small file holds them, and what follows takes much longer than reading it, so the
    orders are dealt to all partitions before they are rendered."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    dealt = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return spark.sql(sql, orders=dealt, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, filename, text, source of the rendered documents, and k."""
    return _read(spark, sf_dir, f"WITH {DOCS} SELECT * FROM inv_docs")


def return_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, f"WITH {ROWS} SELECT * FROM return_rows")
