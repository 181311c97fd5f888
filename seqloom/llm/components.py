"""Connected components of a distributed edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (x, y), all long; root is the same within a
    component and is one of its nodes.

    Nodes should be hashes: with such names every round contracts a constant share of the
    nodes, whatever the graph's shape, so the rounds grow with the logarithm of its size.
    Each round every node points to its smallest neighbour (or itself), pointers jump once,
    and edges between different targets go on; the edge of a node to its neighbour is among
    them, so nothing that was connected comes apart.  Edges and pointers stay distributed;
    only their number is read by the driver.
    """
    edges = stored(links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        step = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select("node", F.least("node", "near").alias("to"))
        step = stored(step, "pointers")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = stored(step.join(jump, "to").select("node", F.col("next").alias("to")), "jumps")
        rounds.append(step)
        a = step.select(F.col("node").alias("x"), F.col("to").alias("p"))
        b = step.select(F.col("node").alias("y"), F.col("to").alias("q"))
        moved = edges.join(a, "x").join(b, "y").where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        edges = stored(moved.distinct(), "edges")
    if not rounds:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    # The last round's targets are roots; earlier rounds follow theirs.
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for step in reversed(rounds[:-1]):
        up = step.join(roots.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        roots = stored(up, "roots")
    return roots
