"""Repeated property paths: the distinct pairs that one or more steps connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.storage import written


def closure(edges: DataFrame, seeds: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """Distinct pairs (a, b) with a path of one or more edges (a, b) from a to b.

    With seeds (one column, a): only from there, semi-naively, one step a round, and no further once target, if there is one, is met. Without: paths are joined with paths, so rounds grow
    with the logarithm of the longest path. Each round's pairs are written, so plans stay flat and lost executors repeat little.
    """
    edges = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "path-edges")
    if seeds is not None:
        seen = delta = written(edges.join(seeds.select(F.col("a").alias("_seed")).distinct(), F.col("a") == F.col("_seed"), "left_semi"), "paths")
        step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    else:
        seen = delta = edges
        step = None
    while delta.head(1) and not (target is not None and delta.where(F.col("b") == target).head(1)):
        ahead = step if step is not None else seen.select(F.col("a").alias("b"), F.col("b").alias("c"))
        found = delta.join(ahead, "b").select("a", F.col("c").alias("b"))
        if step is None and delta is not seen:  # what is new may also come second
            found = found.union(seen.select("a", F.col("b").alias("m")).join(delta.select(F.col("a").alias("m"), F.col("b").alias("c")), "m").select("a", F.col("c").alias("b")))
        delta = written(found.distinct().join(seen, ["a", "b"], "left_anti"), "paths")
        seen = seen.union(delta)
    return seen
