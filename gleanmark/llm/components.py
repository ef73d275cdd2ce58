"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.common import materialise


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b: long); component is the least id reachable.

    A round lets every vertex follow its least neighbour, doubles these steps, and puts the
    vertices' ends in their place in all edges; edges that become loops or repeat others go. The
    edges shrink until none is left; only their count reaches the driver. Edges with a null end and loops are left out.
    """
    rest = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(most_rounds):
        if not rest.take(1):
            break
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("to"))
        for _jump in range(2):
            up = parent.select(F.col("id").alias("to"), F.col("to").alias("further"))
            parent = parent.join(up, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
        parent = materialise(parent, "parents")
        if labels is None:
            labels = parent.select("id", F.col("to").alias("component"))
        else:
            moved = parent.select(F.col("id").alias("component"), "to")
            labels = materialise(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        a, b = (parent.select(F.col("id").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = rest.join(a, "a").join(b, "b").where("a_to <> b_to")
        rest = materialise(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("the components aren't complete")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    return labels
