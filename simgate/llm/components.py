"""Connected components of an edge table, by lowering labels and jumping; nothing meets in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgate.llm.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) reaches.

    Each round every node takes the least label of its neighbours, then the label of that label, so
    a path of n nodes takes about log n rounds. Rounds are written to the shared folder; only the last one stays.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(least, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        lower = written(lower, "labels")
        ahead = lower.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        jumped = lower.join(ahead, "next").select("node", F.col("jump").alias("label"), "old")
        jumped = written(jumped, "labels")
        discard(labels, lower)
        if jumped.where("label <> old").isEmpty():
            discard(both)
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped
