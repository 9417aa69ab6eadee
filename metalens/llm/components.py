"""Connected components of a link table, by alternating large-star and small-star.

Each step is a map-side-combined minimum per node and a join that adaptive
execution can split on hot nodes. Every round's links are written to the shared
folder, so lineage stays short; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    moved = links.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionAll(least.select("u", F.col("least").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (long columns u, v); root is the least node it reaches.

    Self links and repeated links are ignored; an empty table gives an empty result.
    """
    links = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    size = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = links.select(size.alias("s")).first()["s"]
    while before[0]:
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
        after = links.select(size.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
