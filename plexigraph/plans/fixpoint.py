"""Vertex programs: supersteps of messages along edges until nothing changes.

Only vertices that changed in the last superstep send (the frontier).  Edges lie in buckets by source, written
once, so that no superstep shuffles them; messages to a vertex are combined by a partial aggregate before their
shuffle.  The state lies in buckets by id and is not rewritten each superstep: what changes is written as a small
table, and folded into the state when those tables have grown.  All tables are in the shared folder, so lineage
stays short and a lost executor costs a task.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexigraph.session import bucketed, discard, materialize, shuffle_width


@dataclass(frozen=True)
class VertexProgram:
    """``message(value, weight)`` along an edge; ``combine`` the messages of a vertex; ``better(new, old)`` decides a change."""

    message: Callable[[Column, Column], Column]
    combine: Callable[[Column], Column] = F.min
    better: Callable[[Column, Column], Column] = field(default=lambda new, old: old.isNull() | (new < old))


@dataclass(frozen=True)
class Superstep:
    """What one superstep did: vertices that sent, messages along edges, vertices that got some, vertices that changed, seconds."""

    step: int
    senders: int
    messages: int
    receivers: int
    active: int
    seconds: float


class EdgeTable:
    """Edges in buckets by source.  If a vertex has over ``hub`` edges, by (src, salt): its edges are spread over several salts, all others have salt 0."""

    def __init__(self, edges: DataFrame, hub: int = 100_000, n: int | None = None) -> None:
        self.n = shuffle_width(edges.sparkSession) if n is None else n
        sizes = edges.groupBy("src").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hub)
        self.hubs = materialize(sizes.select(F.col("src").alias("hub_id"), F.ceil(F.col("c") / hub).cast("int").alias("salts")), "hubs")
        self.split = not self.hubs.isEmpty()
        if self.split:
            edges = edges.join(self.hubs, F.col("src") == F.col("hub_id"), "left")
            edges = edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")).drop("hub_id", "salts")
        self.table = bucketed(edges, self.n, ["src", "salt"] if self.split else ["src"], "edges")

    def out_of(self, front: DataFrame) -> DataFrame:
        """``front`` (id and others) joined with the edges that leave its vertices: the edges are not shuffled."""
        if not self.split:
            return front.join(self.table, F.col("id") == F.col("src"))
        front = front.join(self.hubs, F.col("id") == F.col("hub_id"), "left")
        front = front.withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hub_id", "salts")
        return front.join(self.table, (F.col("id") == F.col("src")) & (F.col("at") == F.col("salt"))).drop("at", "salt")

    def discard(self) -> None:
        discard(self.table)
        discard(self.hubs)


class State:
    """(id, value) of all vertices: a base in buckets by id, and the changes since."""

    def __init__(self, base: DataFrame, n: int, fold: int = 8) -> None:
        self.n, self.fold = n, fold
        self.base = bucketed(base.select("id", "value"), n, ["id"], "state")
        self.changes: list[DataFrame] = []

    def _latest(self) -> DataFrame:
        tagged = [t.select(F.col("id").alias("cid"), F.struct(F.lit(k).alias("k"), F.col("value").alias("v")).alias("x")) for k, t in enumerate(self.changes)]
        return reduce(DataFrame.unionAll, tagged).groupBy("cid").agg(F.max("x.k").alias("k"), F.max_by("x.v", "x.k").alias("cv"))

    def current(self) -> DataFrame:
        if not self.changes:
            return self.base
        c = self._latest()
        return self.base.join(c, F.col("id") == F.col("cid"), "left").select("id", F.when(F.col("k").isNotNull(), F.col("cv")).otherwise(F.col("value")).alias("value"))

    def beside(self, got: DataFrame) -> DataFrame:
        """``got`` (id, new), a row an id, with the vertex's ``value``."""
        old = self.base.select(F.col("id").alias("bid"), F.col("value").alias("bv"))
        rows = got.join(old, F.col("id") == F.col("bid")).drop("bid")
        if not self.changes:
            return rows.withColumnRenamed("bv", "value")
        rows = rows.join(self._latest(), F.col("id") == F.col("cid"), "left")
        return rows.select("id", "new", F.when(F.col("k").isNotNull(), F.col("cv")).otherwise(F.col("bv")).alias("value"))

    def change(self, table: DataFrame) -> None:
        """``table``: a materialized (id, value) of vertices that changed; earlier ones may go now."""
        if len(self.changes) >= self.fold:
            old = [self.base, *self.changes]
            self.base, self.changes = bucketed(self.current(), self.n, ["id"], "state"), []
            for t in old:
                discard(t)
        self.changes.append(table)


def run_program(program: VertexProgram, state: DataFrame, edges: DataFrame, max_steps: int | None = None, stats: list[Superstep] | None = None) -> DataFrame:
    """``state``: (id, value), value null where nothing has arrived.  ``edges``: (src, dst, weight).  Returns the fixpoint.

    Runs until nothing changes; raises if ``max_steps`` is given and not enough.
    ``stats`` gets a :class:`Superstep` for each superstep, which costs an aggregate over its messages.
    """
    table = EdgeTable(edges.select("src", "dst", "weight"))
    held = State(state, table.n)
    front = held.base.where(F.col("value").isNotNull())
    for step in count():
        if step == max_steps:
            raise RuntimeError(f"no fixpoint after {max_steps} supersteps")
        began = time.time()
        sent = table.out_of(front.select("id", "value")).select(F.col("dst").alias("to"), program.message(F.col("value"), F.col("weight")).alias("new"))
        got = sent.groupBy("to").agg(program.combine("new").alias("new")).select(F.col("to").alias("id"), "new")
        hit = F.col("new").isNotNull() & program.better(F.col("new"), F.col("value"))
        changed = materialize(held.beside(got).where(hit).select("id", F.col("new").alias("value")), "changed")
        active = changed.count()
        if stats is not None:
            n = sent.agg(F.count(F.lit(1)).alias("m"), F.count_distinct("to").alias("r")).first()
            stats.append(Superstep(step, front.count(), n["m"], n["r"], active, time.time() - began))
        if not active:
            break
        held.change(changed)
        front = changed
    table.discard()
    return held.current()
