"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votespan.llm.common import discard, stash


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, label) of an undirected edge table (a, b): ``label`` is the smallest vertex reachable.

    Each round every vertex points to the smallest vertex around it, pointers are doubled until
    they reach a vertex that points to itself, and edges are drawn anew between those.  The
    vertices at least halve from round to round, and a chain of pointers takes as many doublings
    as its length has binary digits.  A vertex with very many edges is folded before the shuffle.
    """
    left = stash(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(most):
        ends = left.select(F.col("a").alias("v"), F.col("a").alias("to")).unionByName(
            left.select(F.col("b").alias("v"), F.col("a").alias("to")))
        near = stash(ends.groupBy("v").agg(F.min("to").alias("to")), "near")
        taken = _followed(near, most)
        if labels is None:
            labels = taken
        else:
            moved = taken.select(F.col("v").alias("w"), F.col("label").alias("next"))
            labels = stash(labels.join(moved, F.col("label") == F.col("w"), "left").select(
                "v", F.coalesce("next", "label").alias("label")), "labels")
        to_a, to_b = (taken.select(F.col("v").alias(f"v{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
        drawn = left.join(to_a, F.col("a") == F.col("va")).join(to_b, F.col("b") == F.col("vb")).where("la <> lb")
        rest = stash(drawn.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        discard(left)
        left = rest
        if left.isEmpty():
            return labels
    raise ValueError("the components did not settle")


def _followed(pointers: DataFrame, most: int) -> DataFrame:
    """(v, label) from pointers (v, to): where they end."""
    now = pointers.withColumnRenamed("to", "label")
    for _ in range(most):
        further = now.select(F.col("v").alias("w"), F.col("label").alias("next"))
        then = stash(now.join(further, F.col("label") == F.col("w")).select(
            "v", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "taken")
        now = then.select("v", "label")
        if then.where("moved").isEmpty():
            return now
    raise ValueError("the pointers did not end")
