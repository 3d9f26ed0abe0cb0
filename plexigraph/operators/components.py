"""Connected components of an undirected graph by minimum label, for graphs of any size."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexigraph.session import discard, materialize


def weak_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``edges``: (src, dst).  Returns (id, label): the smallest id that each vertex reaches in either direction.

    Each round takes the smallest label among the neighbours (partial minima before the shuffle) and then
    jumps to the label's own label, so long chains halve instead of moving one step.  Every round's
    labels are written to the shared folder; both sides of each join are tables, so that adaptive
    execution can split a vertex with very many edges.  Runs until no label moves; raises if ``max_rounds``
    is given and not enough.
    """
    both = edges.where("src <> dst").select("src", "dst")
    both = materialize(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    labels = materialize(both.select(F.col("src").alias("id")).union(loops).distinct().select("id", F.col("id").alias("label")), "labels")
    for step in count():
        if step == max_rounds:
            raise RuntimeError(f"labels still move after {max_rounds} rounds")
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["id"] == near["src"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("id").alias("root"), F.col("label").alias("top"))
        jumped = materialize(hooked.join(up, hooked["label"] == up["root"]).select("id", F.least("label", "top").alias("label"), "old"), "labels")
        moved = jumped.where("label <> old").limit(1).count()
        for t in (hooked, labels):
            discard(t)
        labels = jumped
        if not moved:
            break
    discard(both)
    return labels.select("id", "label")
