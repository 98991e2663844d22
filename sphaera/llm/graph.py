"""Connected components of links, never collected to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialise


def binary(node: str | Column) -> Column:
    """A long as 8 bytes, the kind of key that join_counted takes."""
    return F.unhex(F.lpad(F.hex(node), 16, "0"))


def _join(rows: DataFrame, key: str, groups: DataFrame, value: str, size: str, total: int, spread: Column) -> DataFrame:
    """rows with the value of their key, null where it has none; a key may hold any share of the rows."""
    keyed = groups.select(binary(key).alias("__node"), value, size)
    return join_counted(rows.withColumn("__node", binary(key)), keyed, "__node", size, total, spread).drop("__node", size)


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in links (a, b): the smallest node of its component.

    Each round points every node to its smallest neighbour (or itself), follows
    those pointers once more and contracts the links to the nodes pointed to.
    The smallest node of a component always points to itself, so it is what is
    left; the number of links falls at least by half in practice, and all tables
    are written to the shared folder between rounds. Nodes with very many links (hubs) meet
    them by broadcast, so no task gets all of a hub's.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    total = edges.count()
    while total:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("up"), F.count("*").alias("n")), "neighbours")
        # at most a node's neighbours and itself point to it
        tops = up.select(F.col("a").alias("up"), F.col("up").alias("to"), (F.col("n") + 1).alias("size"))
        to = materialise(_join(up, "up", tops, "to", "size", up.count(), F.col("a")).select(F.col("a").alias("label"), "to", "n"), "pointers")
        sizes = labels.groupBy("label").agg(F.count("*").alias("size")).join(to.select("label", "to"), "label")
        moved = _join(labels, "label", sizes, "to", "size", labels.count(), F.col("node"))
        labels = materialise(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        at = to.select(F.col("label").alias("a"), F.col("to").alias("new_a"), "n")
        bt = to.select(F.col("label").alias("b"), F.col("to").alias("new_b"), "n")
        ends = _join(_join(edges, "a", at, "new_a", "n", total, F.col("b")), "b", bt, "new_b", "n", total, F.col("a")).filter("new_a <> new_b")
        edges = materialise(ends.select(F.greatest("new_a", "new_b").alias("a"), F.least("new_a", "new_b").alias("b")).distinct(), "links")
        total = edges.count()
    return labels
