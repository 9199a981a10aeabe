"""Connected components of a link table, by hooking and contraction.

Defined cases: links with a null end and links to itself join nothing; repeated links count once;
other columns are not read. An empty table has no component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.store import Scratch, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label: the smallest node reached.

    Each round hooks every vertex to its smallest neighbour and replaces vertices by what
    they are hooked to, so the number of vertices at least halves; a star of any size takes
    two rounds. Every round is written to the shared folder, and goes when the labels are
    written. Links to itself count as none.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.keep(links.where("a <> b").select("a", "b"), "components-links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = scratch.keep(nodes.select("node", F.col("node").alias("label")), "components-labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("least")).select(
            "label", F.least("label", "least").alias("to")
        )
        hook = scratch.keep(hook, "components-hooks")
        labels = scratch.keep(
            labels.join(hook, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            ),
            "components-labels",
        )
        a = hook.select(F.col("label").alias("a"), F.col("to").alias("to_a"))
        b = hook.select(F.col("label").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"),
                                                       F.col("to_b").alias("b"))
        edges = scratch.keep(moved.where("a <> b").distinct(), "components-links")
    labels = stored(labels, "components")
    scratch.clear()
    return labels
