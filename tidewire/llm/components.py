"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.lineage import stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b): the least node it is connected with.

    Each step takes the least root among a node and its neighbours, and then the root's
    root, so chains shrink by about half. Every step is written to the shared folder, which cuts the
    lineage; links and roots stay distributed.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    while True:
        roots = stored(roots, "roots")
        near = (
            both.join(roots.withColumnsRenamed({"node": "b"}), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = stored(
            lower.join(up, "root", "left").select("node", F.least("root", "above").alias("root"), "old"), "roots"
        )
        roots = moved.select("node", "root")
        if moved.filter(F.col("root") < F.col("old")).isEmpty():
            return roots
