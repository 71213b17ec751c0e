"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the least node it is connected with.

    Each round takes the least label among neighbours, then the label of that label, so rounds grow with the
    logarithm of a component's width. The state is written in each round.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = written(pairs.union(pairs.select("other", "node")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
        near = seen.groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = written(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if after.where("label < was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
