"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` for every linked node.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, until nothing changes. Every label table is
    cut into the shared folder.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("root").alias("old"),
                                                   F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        new = staged(lowered.join(jump, "low", "left").select(
            "node", "old", F.least("low", F.coalesce("jump", "low")).alias("root")), "labels")
        moved = new.filter(F.col("old") != F.col("root")).limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
