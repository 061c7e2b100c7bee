"""Connected components over a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (v, c): every linked id with the smallest id that it reaches.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    long chains halve. Rounds are written tables: no lineage grows and nothing is collected.
    """
    both = cut(links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "links")
    labels = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        now = cut(step.join(jump, "c", "left").select("v", "old", F.coalesce(F.least("c", "cc"), "c").alias("c")), "labels")
        if now.where("c != old").isEmpty():
            return now.select("v", "c")
        labels = now.select("v", "c")
