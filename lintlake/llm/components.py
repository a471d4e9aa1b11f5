"""Connected components of a link table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import counted, drop_folder, materialize


#: A table of more rows than this is never broadcast, however small its files: labels repeat, so that they hardly take room in Parquet.
LARGE = 50_000


def _joined(rows: DataFrame, known: DataFrame, side: str, root: str, large: bool, how: str = "inner") -> DataFrame:
    """rows with the label of the node in column side as column root. A large table doesn't go through the driver as a broadcast."""
    to = known.select(F.col("node").alias(side), F.col("label").alias(root))
    return rows.join(to.hint("merge") if large else to, side, how)


def _between(edges: DataFrame, known: DataFrame, large: bool, how: str = "inner") -> DataFrame:
    """edges rewritten between the labels of their ends, without those inside a group."""
    rows = _joined(_joined(edges, known, "a", "a_root", large, how), known, "b", "b_root", large, how)
    rows = rows.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """links: columns a and b (long). Returns node, label: the smallest node that each linked node reaches.

    known: what an earlier call returned; links then come to those of that call, and only what joins two of its groups is worked on. Its table is used up.
    Nodes without links don't appear. In a round each node hooks onto its least neighbour if that is smaller, the trees are
    flattened by pointer jumping, and links are rewritten between the roots; links inside a tree go, so the link table shrinks
    with every round. All tables stand in the shared folder, and what ends a loop is counted while they are written, so a step is one job for the
    driver to plan and remember. An empty table gives none.
    """
    edges = links.select("a", "b").filter("a <> b")
    edges, left = counted(edges if known is None else _between(edges, known, True, "left"), "links")
    found = known
    while left or found is None:
        large = 2 * left > LARGE
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels, deep = counted(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels", F.col("node") != F.col("label"))
        while deep:
            further = _joined(labels, labels, "label", "further", large).select("node", "label", "further")
            before, (labels, deep) = labels, counted(further, "labels", F.col("label") != F.col("further"))
            labels = labels.select("node", F.col("further").alias("label"))
            drop_folder(before)
        if found is None:
            found = labels
        else:
            more = _joined(found, labels, "label", "further", large, "left").select("node", F.coalesce("further", "label").alias("label"))
            if found is known:
                more = more.unionByName(labels.join(known.select("node").hint("merge"), "node", "left_anti"))
            before, found = found, materialize(more, "labels")
            drop_folder(before)
        before, (edges, left) = edges, counted(_between(edges, labels, large), "links")
        drop_folder(before)
    drop_folder(edges)
    return found
