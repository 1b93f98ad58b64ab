"""Connected components of an edge list, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.session import checkpoint


def _jumped(moves: DataFrame, rows: int) -> DataFrame:
    """(node, to) with ``to`` at the end of its chain."""
    while True:
        far = moves.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumped = checkpoint(moves.join(far, "to").select("node", "to", "far"), rows)
        moves = jumped.select("node", F.col("far").alias("to"))
        if jumped.filter("far <> to").isEmpty():
            return moves


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of its component.

    In each round every node points to its smallest neighbour, pointers jump (doubling their reach) until they end at nodes
    without a smaller neighbour, and the graph is contracted to these: edges inside a contracted node vanish and
    equal ones merge, so edges shrink from round to round and a large dense group in the first. What is left of the
    edges, the pointers and the nodes' places are written to the shared checkpoint folder. Edges may repeat and
    may be loops; null ends are left out. Edges are counted in each round, so that what is left of them lies in no more files than it fills.
    """
    ends = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull()).toDF("u", "v", "ok")
    left = checkpoint(ends.filter("ok").select("u", "v").distinct())
    places = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("root", F.col("node"))
    nodes, left = 2 * left.count(), left.filter("u <> v")
    while edges_left := left.count():
        near = left.union(left.select("v", "u")).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to"))
        moves = _jumped(checkpoint(near, 2 * edges_left), 2 * edges_left)
        mu, mv = moves.toDF("u", "fu"), moves.toDF("v", "fv")
        places = checkpoint(places.join(moves.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), nodes)
        moved = left.join(mu, "u").join(mv, "v").select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v"))
        left = checkpoint(moved.filter("u <> v").distinct(), edges_left)
    return places
