"""Connected components of a table of links, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of the links (a, b), longs without
    NULLs: component is the smallest node reachable.  Each round takes the
    smallest label among a node and its neighbours (one shuffle with map-side
    minimum, so a node with many links is no hot key) and then follows labels
    (path halving); rounds grow with the logarithm of a chain's length.  Every
    round is written to the shared folder."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "cc-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")),
                     "cc-labels")
    while True:
        own = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        # neighbours' labels; the side with the links is the one AQE may split
        near = both.join(own, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", F.least("component", "other").alias("next"),
                                                "component")
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("above"))
        new = written(step.join(up, "next").select("node", F.least("next", "above").alias("new"), "component"),
                      "cc-labels")
        if not new.where("new <> component").limit(1).count():
            return labels
        labels = new.select("node", F.col("new").alias("component"))
