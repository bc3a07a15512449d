"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. links: (a, b). Nodes without links aren't listed.

    Smallest labels spread along links and jump over labels of labels, which mostly doubles what a label has
    crossed. Each round but the last lowers a label, so it ends for any links, however long a component is.
    Nothing is collected; a hub's links are summed before they are shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    changed = True
    while changed:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "next").select("node", F.least("next", "far").alias("new"), (F.least("next", "far") < F.col("label")).alias("changed")), "labels")
        discard(labels)
        changed = step.filter("changed").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        labels._stored_at = step._stored_at
    discard(both)
    return labels
