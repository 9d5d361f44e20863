"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of (x, y); a component is named by its smallest id.

    Each round every vertex takes the smallest label among itself and its
    neighbours and then that label's own label, so a chain shrinks to half per
    round or better. Minima are pre-aggregated in every task; lineage is cut by
    ``checkpoint()``.
    """
    both = edges.select("x", "y").union(edges.select("y", "x")).distinct().checkpoint()
    labels = (both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m"))
              .select("id", F.least("id", "m").alias("component"))).checkpoint()
    while True:
        seen = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(
            F.min("component").alias("m"))
        near = labels.join(seen, "id").select("id", F.least("component", "m").alias("c"),
                                              F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        new = near.join(jump, "c", "left").select(
            "id", F.coalesce(F.least("c", "further"), "c").alias("component"), "old").checkpoint()
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
