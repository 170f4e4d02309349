"""What Spark makes of the stages: nothing costly is written out again for each of its uses."""

from pyspark.sql import functions as F

from docrecon.operators import stages
from docrecon.settings import INVOICE_DATE, Settings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_path_is_made_once_more_for_the_filter(spark):
    docs = spark.range(3).select(F.concat(F.lit("/tree/Payments/Kotak/MARK"), F.col("id").cast("string"), F.lit(".pdf")).alias("path"))
    found = stages.seed(docs, Settings(root="/tree", fy_scope="FY 22-23"))
    assert found.count() == 3 and plan(found).count("MARK") == 2


def test_a_text_is_searched_once_for_each_field(spark):
    docs = spark.createDataFrame([("/tree/Payments/Kotak/a.pdf", "TAX INVOICE\nInvoice No: 1\nInvoice Date: 1-Feb-2023")], "path string, text string")
    made = stages.process(docs, Settings(root="/tree"))
    assert plan(made).count(INVOICE_DATE) == 1 and made.first()["invoice_date"] == "2023-02-01"
