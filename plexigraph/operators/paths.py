"""Shortest paths, breadth-first depth, directed components, and graph simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexigraph.operators.transforms import symmetrize, vertices
from plexigraph.plans.fixpoint import Superstep, VertexProgram, run_program
from plexigraph.session import materialize


def cc(edges: DataFrame, directed: bool = True, stats: list[Superstep] | None = None) -> DataFrame:
    """(id, label): the smallest id from which a vertex can be reached (itself included).

    Labels move along edges; with ``directed=False`` both ways, which gives weak components.
    """
    e = edges.select("src", "dst") if directed else symmetrize(edges)
    state = vertices(edges).select("id", F.col("id").alias("value"))
    out = run_program(VertexProgram(lambda v, w: v), state, e.withColumn("weight", F.lit(0)), stats=stats)
    return out.withColumnRenamed("value", "label")


def sssp(edges: DataFrame, source: Column | None = None, weighted: bool = True, stats: list[Superstep] | None = None) -> DataFrame:
    """(id, dist): least distance from any source; null where none reaches.  Sources: id mod 100 = 1 unless given."""
    source = F.col("id") % 100 == 1 if source is None else source
    weight = F.col("weight") if weighted and "weight" in edges.columns else F.lit(1).cast("long")
    e = edges.select("src", "dst", weight.alias("weight"))
    kind = e.schema["weight"].dataType
    state = vertices(edges).select("id", F.when(source, F.lit(0).cast(kind)).alias("value"))
    return run_program(VertexProgram(lambda v, w: v + w), state, e, stats=stats).withColumnRenamed("value", "dist")


def bfs_depth(edges: DataFrame, mod: int) -> DataFrame:
    """(id, dist): hops, in either direction, from the nearest id that ``mod`` divides."""
    return sssp(symmetrize(edges), F.col("id") % mod == 0, weighted=False)


def simulation(nodes: DataFrame, edges: DataFrame, pattern_nodes: DataFrame, pattern_edges: DataFrame) -> DataFrame:
    """(p, v): the greatest relation with equal attributes in which every pattern edge p -> q is answered by some v -> w with (q, w).

    ``nodes`` and ``pattern_nodes``: (id, attr).  Pairs leave until none does.
    """
    pairs = pattern_nodes.select(F.col("id").alias("p"), "attr").join(nodes.select(F.col("id").alias("v"), "attr"), "attr").select("p", "v")
    pairs = materialize(pairs, "sim")
    pe = pattern_edges.select(F.col("src").alias("p"), F.col("dst").alias("q")).distinct()
    de = edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).distinct()
    n = pairs.count()
    while True:
        needs = pairs.join(pe, "p")
        right = pairs.select(F.col("p").alias("q"), F.col("v").alias("w"))
        met = de.join(right, "w").select("v", "q").distinct()
        fails = needs.join(met, ["v", "q"], "left_anti").select("p", "v").distinct()
        pairs = materialize(pairs.join(fails, ["p", "v"], "left_anti"), "sim")
        left = pairs.count()
        if left == n:
            return pairs
        n = left
