"""Connected components of a table of links, contracted round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.sources.storage import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes of one component share their root.

    Each round maps every node to the neighbour, or itself, that comes first in an order drawn
    anew, and replaces links by those between the images; a constant share of the nodes goes in
    each round whatever the shape of the graph. Links and labels stay in tables written to the
    shared folder; only their number reaches the driver. An empty table gives an empty result.
    """
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        step = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["v"].alias("to"))
        step = stage(step, "steps")
        first, second = step.toDF("a", "x"), step.toDF("b", "y")
        edges = stage(
            edges.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(),
            "links",
        )
        if labels is None:
            labels = step.toDF("node", "root")
        else:
            moved = labels.join(step.toDF("root", "to"), "root", "left")
            labels = stage(moved.select("node", F.coalesce("to", "root").alias("root")), "labels")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
