"""Connected components of an undirected graph, by repeated contraction. No part of the graph goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that can be reached.

    Each round maps every node to its smallest neighbour or itself, follows these maps to their ends by doubling, and
    keeps the edges between different ends, the nodes that have no smaller neighbour. The maps are then applied one after the other. Loops and repeated edges do no
    harm; an empty graph gives an empty table. The last map joins give nodes their final image; the images are then
    replaced by the smallest node of their class.
    """
    pairs = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut(pairs(edges))
    out = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        image = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")))
        while True:  # every node to the end of its chain of images; each turn doubles the steps taken
            jumped = cut(image.join(image.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            image = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        left = cut(pairs(left.join(image.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(image.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
        if out is None:
            out = image
        else:
            out = out.join(image.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    # an image is never larger than its node, so the last image of a component is its smallest node
    return out.select("node", F.col("to").alias("component"))
