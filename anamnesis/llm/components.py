"""Connected components by alternating large and small stars, each round a few joins on written edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import discard, materialize

#: Edges that one task takes.
EDGES = 50_000


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component. edges: (a, b), both long.

    No list of neighbours is ever gathered: each round takes minima with map-side combination and joins them back."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark == state or not mark.n:
            break
        state = mark
        # A round over few edges is one of many small stages: as few tasks as the edges need, never more than before.
        tasks = 1 + mark.n // EDGES
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        discard(last, large)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    out.scratch_path = now.scratch_path
    return out
