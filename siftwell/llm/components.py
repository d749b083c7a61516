"""Connected components over links, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches.

    Each round is a join, an aggregation and a jump to the label's label, written to the shared
    folder; the rounds grow with the logarithm of a component's diameter in practice.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        jumped = saved(spread.join(target, spread["label"] == target["at"]).select("node", "old", F.least("label", "jump").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.where("label < old").limit(1).count():
            return labels
