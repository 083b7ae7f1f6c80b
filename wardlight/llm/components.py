"""Connected components by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import write_table


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for the vertices of ``edges`` (a, b): the smallest vertex that each reaches.

    Every round takes the smallest label among neighbours and then the label of that label; rounds are tables in the
    shared folder, and only whether anything changed reaches the driver. Two rounds suffice for stars, a chain of n takes about log(n).
    """
    both = write_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = write_table(lower, "labels")
        up = lower.select(F.col("v").alias("label"), F.col("label").alias("up"))
        labels = write_table(lower.join(up, "label", "left").select("v", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if not labels.where("label < was").take(1):
            return labels.select("v", "label")
        labels = labels.select("v", "label")
