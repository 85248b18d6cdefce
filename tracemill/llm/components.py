"""Connected components of a link table: smallest reachable id, by neighbours' labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest id reachable, the node itself included.

    Each round takes the least label among the neighbours, then the label of that label, so a chain of n links needs
    about log n rounds. Minima are taken before the shuffle, so a hub costs one row per task. Labels are written after
    each round; nothing is collected but the number of changes.
    """
    one = links.select("a", "b").where("a <> b")
    both = stored(one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = stored(labels, "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("at")), "b")
        heard = heard.groupBy(F.col("a").alias("node")).agg(F.min("at").alias("at"))
        near = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "at").alias("at"))
        ahead = labels.select(F.col("node").alias("at"), F.col("component").alias("ahead"))
        step = near.join(ahead, "at").select("node", "old", F.least("at", "ahead").alias("component"))
        step = stored(step, "labels")
        if step.where("component <> old").isEmpty():
            return labels
        labels = step.select("node", "component")
