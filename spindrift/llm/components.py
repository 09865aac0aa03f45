"""Connected components of links between texts, by least labels and pointer jumping; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component). links: a, b, in any direction and number; loops keep single nodes."""
    both = shared.table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = shared.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        # the least label among the neighbours, then that node's own label
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        after = shared.table(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("upper", "label")).alias("label")))
        labels = after.select("node", "label")
        if not after.where("old <> label").limit(1).count():
            return labels
