"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step shuffles the links on a node and replaces them by links to the smallest neighbour; a hot node is summed up
before the shuffle and its links are split in the join. Every round is written to the shared folder, which cuts the
lineage. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over ``links`` (u > v). Large: larger neighbours of each node go to its smallest; small: smaller ones and itself."""
    if large:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
    # Twice inverted, the key is none that the sums are dealt by already. So the join deals both of its sides itself, and
    # Spark can split the links of a hot node, which it can't below an aggregate.
    least = least.withColumn("n", F.bitwise_not(F.bitwise_not("n")))
    joined = both.join(least, "n")
    if large:
        out = joined.filter(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``links`` (two long columns; direction, repeats and loops don't matter)."""
    a, b = links.columns[:2]
    now = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "links")
    while True:
        several = now.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo != hi")
        nested = now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi")
        if several.isEmpty() and nested.isEmpty():
            break
        now = materialize(_star(_star(now, True), False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
