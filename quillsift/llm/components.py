"""Connected components of links between documents, by hooking to the smallest neighbour and contraction.

Each round hooks every node that still has links to its smallest neighbour if that is smaller, follows the
hooks to their ends by doubling, and rewrites the links between what remains. The smallest node of a component is never
hooked, so it is the label that is left. Links and labels stay distributed; each round ends in a reliable
checkpoint. Rows of one hot node meet in joins (which the engine may split) and partial aggregations only.
A round writes no more files than its rows need, as a local file system starts a process for each to set its mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import checkpointed

#: Rows of a round that are worth a file, about; there are never more files than the session's partitions.
FILE_ROWS = 10_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (u, v); the label is the component's smallest node.

    Repeated links, links both ways and links of a node to itself make no difference; links with a
    null end are no links.
    """
    edges = checkpointed(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null").distinct())
    files = max(1, -(-2 * edges.count() // FILE_ROWS))  # no table of a round has more than two rows a link

    def kept(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(files))

    ends = edges.select("u").union(edges.select("v"))
    labels = ends.distinct().select(F.col("u").alias("node"), F.col("u").alias("label"))
    edges = edges.where("u != v")
    first = True
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("to")))
        moved = True
        while moved:  # hooks of hooks, until every one names a root: as often as the logarithm of the longest chain
            further = hooks.where("of != to").select(F.col("of").alias("of2"), F.col("to").alias("to2"))
            hooks = kept(hooks.join(further, F.col("to") == F.col("of2"), "left").select("of", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")))
            moved = not hooks.where("moved").isEmpty()
        if first:  # at first every node of the links is its own label
            labels = labels.join(hooks, F.col("node") == F.col("of"), "left").select("node", F.coalesce("to", "label").alias("label"))
            first = False
        else:
            labels = labels.join(hooks, F.col("label") == F.col("of"), "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = kept(labels)
        left = hooks.select(F.col("of").alias("of_u"), F.col("to").alias("a"))
        right = hooks.select(F.col("of").alias("of_v"), F.col("to").alias("b"))
        edges = kept(
            edges.join(left, F.col("u") == F.col("of_u")).join(right, F.col("v") == F.col("of_v")).where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
    return labels
