"""Two PageRanks, un-normalised (ranks add up to about the number of vertices)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexigraph.operators.transforms import degrees
from plexigraph.plans.fixpoint import EdgeTable
from plexigraph.session import bucketed, discard


def pagerank(edges: DataFrame, mode: str = "cpu", max_iter: int = 200, eps: float | None = None, damping: float = 0.85, n: int | None = None, every: int = 5, stats: list | None = None) -> DataFrame:
    """(id, pr) after ``max_iter`` rounds, or when no rank moves by more than ``eps``.

    cpu: vertices without in-edges stay at 1, and what dangling vertices hold is lost.
    gpu: all vertices are updated, and what dangling vertices hold is shared by all ``n`` (default: those with edges).
    Edges lie in buckets by source and ranks in buckets by id, so a round shuffles the contributions alone.
    """
    table = EdgeTable(edges.select("src", "dst"))
    d = bucketed(degrees(edges).select("id", "out_degree", "in_degree"), table.n, ["id"], "degrees")
    n = d.count() if n is None else n
    ranks = d.select("id", "out_degree", "in_degree", F.lit(1.0).alias("pr"), F.lit(1.0).alias("old"))
    held: DataFrame | None = None
    for k in range(max_iter):
        share = ranks.where("out_degree > 0").select("id", (F.col("pr") / F.col("out_degree")).alias("share"))
        sent = table.out_of(share).groupBy(F.col("dst").alias("to")).agg(F.sum("share").alias("acc"))
        lost = F.lit(0.0)
        if mode == "gpu":
            # one number a round; its own job, so that the state must be a table
            lost = F.lit((ranks.where("out_degree = 0").agg(F.sum("pr")).first()[0] or 0.0) / max(1, n))
        new = F.lit(1 - damping) + damping * (F.coalesce("acc", F.lit(0.0)) + lost)
        if mode == "cpu":
            new = F.when(F.col("in_degree") == 0, F.lit(1.0)).otherwise(new)
        ranks = ranks.join(sent, F.col("id") == F.col("to"), "left").select("id", "out_degree", "in_degree", new.alias("pr"), F.col("pr").alias("old"))
        if eps is not None or (k + 1) % every == 0 or mode == "gpu":
            ranks = bucketed(ranks, table.n, ["id"], "ranks")
            if held is not None:
                discard(held)
            held = ranks
        if eps is not None:
            moved = ranks.agg(F.max(F.abs(F.col("pr") - F.col("old")))).first()[0]
            if stats is not None:
                stats.append((k, moved))
            if moved is None or moved <= eps:
                break
    return ranks.select("id", "pr")
