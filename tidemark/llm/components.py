"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    Each round every label that has a smaller neighbour moves to the smallest one, then to where that one moved;
    edges whose ends share a label are dropped. Edges shrink geometrically for node names in random order. A hub's
    edges meet its label in a join whose sides are both plain shuffles, which Spark splits where they are skewed.
    """
    # loops only name nodes
    table = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    ends = table.select(F.col("hi").alias("node")).union(table.select(F.col("lo").alias("node")))
    labels = cut(ends.groupBy("node").agg(F.min("node").alias("label")), "labels")
    live = table.filter("hi != lo")
    while not live.isEmpty():
        moves = cut(live.groupBy(F.col("hi").alias("from")).agg(F.min("lo").alias("to")), "moves")
        jump = moves.select(F.col("from").alias("to"), F.col("to").alias("next"))
        # smallest neighbour's own move: half the way of a chain
        to = cut(moves.join(jump, "to", "left").select("from", F.coalesce("next", "to").alias("to")), "jumps")
        move = lambda d, c: d.join(to.select(F.col("from").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        before = labels, table
        labels = cut(move(labels, "label"), "labels")
        # edges are mapped like labels, so what was linked stays linked
        both = move(move(live, "hi"), "lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        live = table = cut(both.filter("hi != lo").distinct(), "edges")
        drop(moves, to, *before)
    drop(table)
    return labels
