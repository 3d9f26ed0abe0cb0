"""Vertex-cut partitioning: greedy balanced assignment, replicas, masters, routes, metrics, repair.

The greedy assignment is sequential by nature: each edge's score needs the state after the one before.
It runs as one Python task over the sorted edges, with k bits a vertex of state; at scale take
:func:`bulk_sync` (rounds of edges in parallel), :func:`ebv_two_level` (parts in parallel) or
:func:`dst_owner` (no state at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexigraph.operators.transforms import degree_order, merge_hierarchical, vertices
from plexigraph.plans.fixpoint import State
from plexigraph.plans.prefix import numbered, prefix_sums
from plexigraph.session import materialize, shuffle_width


def _greedy(edges: list[tuple[int, int]], n: int, m: int, k: int, alpha: float, beta: float, gama: float = 0.0, per_node: int = 1, share: bool = False) -> list[int]:
    """Part of each edge in turn: the highest score, the lowest part of equals.

    A part loses 1 for each end that it lacks (and gets ``gama`` back if its node has that end; with ``share``
    in proportion to the node's replicas), and loses its load of edges and of vertices.
    """
    full = max(1, m // k)
    load, count = [0] * k, [0] * k
    has: dict[int, int] = {}
    node: dict[int, list[int]] = {}
    out = []
    none = [0] * max(1, -(-k // per_node))
    for u, v in edges:
        hu, hv = has.get(u, 0), has.get(v, 0)
        nu, nv = node.get(u, none), node.get(v, none)
        best, top = 0, None
        for j in range(k):
            w = 0.0
            for h, own in ((hu, nu), (hv, nv)):
                if not h >> j & 1:
                    c = own[j // per_node]
                    if gama and c:
                        w += gama * c / per_node if share else gama
                    w -= 1
            w = w - alpha * load[j] / full - beta * count[j] / n * k
            if top is None or w > top:
                best, top = j, w
        out.append(best)
        load[best] += 1
        for x in (u, v):
            if not has.get(x, 0) >> best & 1:
                has[x] = has.get(x, 0) | 1 << best
                count[best] += 1
                node.setdefault(x, list(none))[best // per_node] += 1
    return out


def ebv(edges: DataFrame, k: int = 4, alpha: float = 1.0, beta: float = 1.0, gama: float = 0.0, per_node: int = 1, share: bool = False) -> DataFrame:
    """(idx, src, dst, part): edges in order of degree sum, each to the part of the highest score."""
    n = vertices(edges).count()
    order = degree_order(edges).select("idx", "src", "dst")
    m = order.count()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(frames), ignore_index=True)
        if len(every):
            every["part"] = _greedy(list(zip(every["src"].tolist(), every["dst"].tolist(), strict=True)), n, m, k, alpha, beta, gama, per_node, share)
            every["part"] = every["part"].astype("int32")
            yield every

    return order.coalesce(1).sortWithinPartitions("idx").mapInPandas(assign, "idx long, src long, dst long, part int")


def ebv_hierarchical(assigned: DataFrame, inner: int = 2, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Each part of an earlier partition ``assigned`` (src, dst, part) cut again by the greedy assignment, in parallel: part * inner + the inner part.

    ``idx`` is the edge's place within its outer part.  An outer part must fit one task.
    """

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        d = pd.concat([frame["src"], frame["dst"]]).value_counts()
        frame = frame.assign(degsum=frame["src"].map(d) + frame["dst"].map(d)).sort_values(["degsum", "src", "dst"], ignore_index=True)
        own = _greedy(list(zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True)), len(d), len(frame), inner, alpha, beta)
        return pd.DataFrame({"src": frame["src"], "dst": frame["dst"], "part": (frame["outer"] * inner + pd.Series(own)).astype("int32"), "idx": range(1, len(frame) + 1)})

    rows = assigned.select("src", "dst", F.col("part").cast("int").alias("outer"))
    return rows.groupBy("outer").applyInPandas(split, "src long, dst long, part int, idx long")


def ebv_two_level(edges: DataFrame, outer: int = 4, inner: int = 2, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """:func:`ebv_hierarchical` over parts by destination, which need no state."""
    return ebv_hierarchical(dst_owner(edges, outer), inner, alpha, beta)


def _batches(top: int, size: int = 10, most: int | None = 1000) -> Iterator[tuple[int, int]]:
    """(start, size): each size 1.3 times the one before, at most ``most``."""
    start = 0
    while start < top:
        yield start, size
        start += size
        size = _grown(size, most)


def _grown(size: int, most: int | None) -> int:
    return int(size * 1.3) if most is None else min(int(size * 1.3), most)


def _slices(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank, pos): the edges whose number (by src, dst, from 0) leaves ``rank``, in order of the slice's own degree sums."""
    rows = numbered(edges.select("src", "dst"), "i", [F.col("src"), F.col("dst")], 0).select("src", "dst", F.pmod("i", F.lit(k)).cast("int").alias("rank"))
    rows = materialize(rows, "slices")
    ends = rows.select("rank", F.explode(F.array("src", "dst")).alias("id")).groupBy("rank", "id").agg(F.count(F.lit(1)).alias("d"))
    u, v = ends.toDF("rank", "src", "du"), ends.toDF("rank", "dst", "dv")
    sums = rows.join(u, ["rank", "src"]).join(v, ["rank", "dst"]).select("src", "dst", "rank", (F.col("du") + F.col("dv")).alias("d"))
    placed = prefix_sums(sums, F.col("rank"), F.lit(1), [F.col("d"), F.col("src"), F.col("dst")], "places")
    return placed.select("__row.src", "__row.dst", "__row.rank", F.col("__before").alias("pos"))


def _with_masks(batch: DataFrame, state: State) -> DataFrame:
    """``batch`` with the masks of parts that hold src (mu) and dst (mv)."""
    ends = batch.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit(None).cast("long").alias("new"))
    held = materialize(state.beside(ends).select("id", F.coalesce("value", F.lit(0)).alias("m")), "masks")
    u, v = held.toDF("src", "mu"), held.toDF("dst", "mv")
    return batch.join(u, "src").join(v, "dst")


def _lacks(mask: str, j: int) -> Column:
    return F.getbit(F.col(mask), F.lit(j)) == 0


def _grow(state: State, ends: DataFrame, k: int) -> list[int]:
    """Adds ``ends`` (id, part) to the state.  Returns how many vertices are new to each part."""
    got = ends.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, part)")).alias("new"))
    rows = state.beside(got).select("id", F.coalesce("value", F.lit(0)).alias("old"), F.col("new").bitwiseOR(F.coalesce("value", F.lit(0))).alias("value"))
    changed = materialize(rows.where("old <> value"), "grown")
    counts = changed.agg(*[F.coalesce(F.sum((F.getbit("value", F.lit(j)) - F.getbit("old", F.lit(j))).cast("long")), F.lit(0)) for j in range(k)]).first()
    state.change(changed)
    return list(counts)


def _chooser(k: int, own: list[float], loads: list[list[int]], counts: list[list[int]], n: int, alpha: float, beta: float):
    """One rank's choices of hosts in a round, each counted at once: a function of its edges with their masks."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", ignore_index=True)
        r = int(frame["part"].iloc[0])
        own_load, own_count, hosts = loads[r], counts[r], []
        for mu, mv in zip(frame["mu"].tolist(), frame["mv"].tolist(), strict=True):
            best, top = -1, None
            for j in range(k):
                if j == r:
                    continue
                w = -float(not mu >> j & 1) - float(not mv >> j & 1) - alpha * own_load[j] / max(1.0, own[r]) - beta * own_count[j] / n * k
                if top is None or w > top:
                    best, top = j, w
            own_load[best] += 1
            own_count[best] += (not mu >> best & 1) + (not mv >> best & 1)
            hosts.append(best)
        return frame.assign(host_part=pd.Series(hosts, dtype="int32"))[["src", "dst", "part", "host_part", "mu", "mv"]]

    return choose


def bulk_sync(edges: DataFrame, k: int = 4, alpha: float = 1.0, beta: float = 1.0, fault_weight: float = 0.0, backup: bool = False, max_batch: int | None = 1000) -> DataFrame:
    """k ranks (at most 62) that assign their slices of the edges in rounds, each round against the state after the last.

    Rank r owns the edges whose number (by src, dst, from 0) leaves r, sorted by the slice's own degree sums.
    Returns src, dst, part and host_part: the rank that holds a second copy (null without ``backup``).

    The state is a table of the parts that hold each vertex, in buckets; a round joins its edges with it, scores
    them in parallel and adds what is new; the driver holds 2 k loads.  Rounds grow by 1.3 up to ``max_batch`` edges
    a rank; without it they go on growing, so that a graph of any size takes a few dozen.  The backup pass counts
    each choice at once, so there a rank's edges of a round run in one task.
    """
    n, slices = vertices(edges).count(), materialize(_slices(edges, k), "sliced")
    sizes = {r["rank"]: r["n"] for r in slices.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
    m, own = sum(sizes.values()), [float(sizes.get(r, 0)) for r in range(k)]
    state = State(vertices(edges).select("id", F.lit(0).cast("long").alias("value")), shuffle_width(edges.sparkSession))
    load, count, parts, size = [0] * k, [0] * k, [], 10
    slice_size = F.element_at(F.array(*map(F.lit, own)), F.col("rank") + 1)
    for step, (start, size) in enumerate(_batches(m // k + 1, 10, max_batch)):
        batch = _with_masks(slices.where((F.col("pos") >= start) & (F.col("pos") < start + size)), state)
        scores = []
        for j in range(k):
            w = F.lit(0.0)
            for mask in ("mu", "mv"):
                once = F.when(F.bit_count(mask) == 1, F.lit(fault_weight)).otherwise(0.0) if fault_weight else F.lit(0.0)
                w = F.when(_lacks(mask, j), w - 1 + once).otherwise(w)
            w = w - F.lit(alpha * load[j]) / slice_size - F.lit(beta * count[j] / n * k)
            scores.append(F.when(F.col("rank") == j, w + 0.1).otherwise(w))
        every = F.array(*scores)
        best = (F.array_position(every, F.array_max(every)) - 1).cast("int")
        assigned = materialize(batch.select("src", "dst", best.alias("part"), "rank", "pos", F.lit(step).alias("step")), "assigned")
        for r in assigned.groupBy("part").count().collect():
            load[r["part"]] += r["count"]
        new = _grow(state, assigned.select(F.explode(F.array("src", "dst")).alias("id"), "part"), k)
        count = [a + b for a, b in zip(count, new, strict=True)]
        parts.append(assigned)
    if not parts:
        return edges.sparkSession.createDataFrame([], "src long, dst long, part int, host_part int")
    held = reduce(DataFrame.unionAll, parts)
    if not backup or k < 2:
        return held.select("src", "dst", "part", F.lit(None).cast("int").alias("host_part"))
    # a part's edges in the order in which they came
    placed = prefix_sums(held, F.col("part"), F.lit(1), [F.col("step"), F.col("rank"), F.col("pos")], "held")
    held = materialize(placed.select("__row.src", "__row.dst", "__row.part", F.col("__before").alias("pos")), "held")
    loads, counts, out = [list(load) for _ in range(k)], [list(count) for _ in range(k)], []
    # round sizes go on from where the first pass has left them
    for start, size in _batches(max(load), _grown(size, max_batch), max_batch):
        batch = _with_masks(held.where((F.col("pos") >= start) & (F.col("pos") < start + size)), state)

        sent = materialize(batch.groupBy("part").applyInPandas(_chooser(k, own, [list(x) for x in loads], [list(x) for x in counts], n, alpha, beta), "src long, dst long, part int, host_part int, mu long, mv long"), "sent")
        fresh = F.sum((F.expr("1 - getbit(mu, host_part)") + F.expr("1 - getbit(mv, host_part)")).cast("long"))
        for r in sent.groupBy("part", "host_part").agg(F.count(F.lit(1)).alias("e"), fresh.alias("v")).collect():  # k * k rows
            loads[r["part"]][r["host_part"]] += r["e"]
            counts[r["part"]][r["host_part"]] += r["v"]
        _grow(state, sent.select(F.explode(F.array("src", "dst")).alias("id"), F.col("host_part").alias("part")), k)
        out.append(sent.select("src", "dst", "part", "host_part"))
    return reduce(DataFrame.unionAll, out)


def dst_owner(edges: DataFrame, k: int = 4) -> DataFrame:
    """Each edge to its destination's owner, dst mod k."""
    return edges.select("src", "dst", F.pmod("dst", F.lit(k)).cast("int").alias("part"))


def by_vertex_part(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Each edge to the part that ``owner`` (id, part) gives its destination.  Raises if either end has no owner."""
    own = owner.select("id", "part")
    rows = edges.select("src", "dst").join(own.select(F.col("id").alias("dst"), "part"), "dst", "left")
    rows = rows.join(own.select(F.col("id").alias("src"), F.col("part").alias("home")), "src", "left")
    missing = F.raise_error(F.concat(F.lit("no part for an end of edge "), F.col("src").cast("string"), F.lit(" "), F.col("dst").cast("string")))
    return rows.select("src", "dst", F.when(F.col("part").isNull() | F.col("home").isNull(), missing).otherwise(F.col("part")).cast("int").alias("part"))


def by_vertex_routes(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(id, part, master_part) of the vertices that :func:`by_vertex_part` puts on two parts or more; the master is the vertex's own part.

    Raises if a vertex's own part holds none of its edges.
    """
    r = replicas(by_vertex_part(edges, owner)).drop("first")
    home = owner.select("id", F.col("part").alias("home"))
    every = Window.partitionBy("id")
    r = r.join(home, "id").withColumn("size", F.count(F.lit(1)).over(every)).withColumn("held", F.max((F.col("part") == F.col("home")).cast("int")).over(every))
    lost = F.raise_error(F.concat(F.lit("part of vertex "), F.col("id").cast("string"), F.lit(" holds none of its edges")))
    return r.where("size > 1").select("id", "part", F.when(F.col("held") == 1, F.col("home")).otherwise(lost).cast("int").alias("master_part"))


def replicas(assigned: DataFrame) -> DataFrame:
    """(id, part, first): who holds each vertex, and since which place in the edge order (src before dst).

    ``assigned`` may bring its order as ``idx``; else (src, dst) orders it.
    """
    if "idx" not in assigned.columns:
        assigned = numbered(assigned, "idx", [F.col("src"), F.col("dst")])
    ends = assigned.select(F.col("src").alias("id"), "part", (2 * F.col("idx")).alias("at")).unionAll(assigned.select("dst", "part", 2 * F.col("idx") + 1))
    return ends.groupBy("id", "part").agg(F.min("at").alias("first"))


def replica_histogram(assigned: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """(replicas, n) for 0 .. k; ``n`` vertices in all count isolated ones as 0."""
    sizes = replicas(assigned).groupBy("id").agg(F.count(F.lit(1)).alias("replicas")).groupBy("replicas").agg(F.count(F.lit(1)).alias("c"))
    every = assigned.sparkSession.range(k + 1).select(F.col("id").alias("replicas"))
    out = every.join(sizes, "replicas", "left").select("replicas", F.coalesce("c", F.lit(0)).alias("n"))
    if n is None:
        return out
    held = replicas(assigned).select("id").distinct().count()
    return out.select("replicas", F.when(F.col("replicas") == 0, F.lit(n - held).cast("long")).otherwise(F.col("n")).alias("n"))


def metrics(assigned: DataFrame, k: int) -> DataFrame:
    """One row: edge_imbalance, vertex_imbalance, replication."""
    load = assigned.groupBy("part").agg(F.count(F.lit(1)).alias("e"))
    r = replicas(assigned)
    held = r.groupBy("part").agg(F.count(F.lit(1)).alias("v"))
    both = load.join(held, "part", "full").agg((F.max("e") / F.sum("e") * k).alias("edge_imbalance"), (F.max("v") / F.sum("v") * k).alias("vertex_imbalance"), F.sum("v").alias("s"))
    n = r.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return both.crossJoin(F.broadcast(n)).select("edge_imbalance", "vertex_imbalance", (F.col("s") / F.col("n")).alias("replication"))  # one row each


def _elected(r: DataFrame, master: Column) -> DataFrame:
    """(id, part, first, master_part) of the vertices with two replicas or more; ``master`` is over all rows of an id."""
    every = Window.partitionBy("id")
    out = r.withColumn("size", F.count(F.lit(1)).over(every)).where("size > 1")
    return out.withColumn("all", F.sort_array(F.collect_list("part").over(every))).withColumn("master_part", master).drop("all", "size")


def master_mod(assigned: DataFrame) -> DataFrame:
    """(id, part, master_part): of the ascending replicas the one at id mod their number."""
    return _elected(replicas(assigned), F.element_at("all", (F.col("id") % F.col("size") + 1).cast("int"))).drop("first")


def backup_masters(assigned: DataFrame) -> DataFrame:
    """(id, master_part, backup_part): the backup is at id mod (number - 1) of the replicas without the master."""
    size = F.size("all")
    m, b = F.col("id") % size, F.col("id") % (size - 1)
    lists = replicas(assigned).groupBy("id").agg(F.sort_array(F.collect_list("part")).alias("all")).where(size > 1)
    at = F.when(b >= m, b + 1).otherwise(b)
    return lists.select("id", F.element_at("all", (m + 1).cast("int")).alias("master_part"), F.element_at("all", (at + 1).cast("int")).alias("backup_part"))


def master_last(assigned: DataFrame) -> DataFrame:
    """(id, part, master_part): the replica that came last."""
    return _elected(replicas(assigned), F.max_by("part", "first").over(Window.partitionBy("id"))).drop("first")


def master_dense(assigned: DataFrame, per_node: int = 2) -> DataFrame:
    """(id, part, master_part): the last replica on a node that holds the most replicas of the vertex."""
    node = F.floor(F.col("part") / per_node)
    r = replicas(assigned).withColumn("on_node", F.count(F.lit(1)).over(Window.partitionBy("id", node)))
    return _elected(r, F.max_by("part", F.struct("on_node", "first")).over(Window.partitionBy("id"))).drop("first", "on_node")


def master_near_hash(assigned: DataFrame, per_node: int = 2) -> DataFrame:
    """(id, part, master_part): the ascending replica at id mod their number if its node holds the most replicas, else the least part on such a node."""
    every = Window.partitionBy("id")
    r = replicas(assigned).withColumn("on_node", F.count(F.lit(1)).over(Window.partitionBy("id", F.floor(F.col("part") / per_node))))
    r = r.withColumn("most", F.max("on_node").over(every))
    dense = F.array_sort(F.collect_list(F.when(F.col("on_node") == F.col("most"), F.col("part"))).over(every))
    first = F.element_at("all", (F.col("id") % F.col("size") + 1).cast("int"))
    out = r.withColumn("dense", dense).withColumn("size", F.count(F.lit(1)).over(every)).where("size > 1").withColumn("all", F.sort_array(F.collect_list("part").over(every)))
    return out.select("id", "part", F.when(F.array_contains("dense", first), first).otherwise(F.element_at("dense", 1)).alias("master_part"))


def induced_partition(assigned: DataFrame, active: DataFrame, per_node: int = 2) -> tuple[DataFrame, DataFrame]:
    """Edges of ``assigned`` with both ends in ``active`` (id), and their routes (id, part, master_part) derived again."""
    keep = active.select("id").distinct()
    rows = assigned.join(keep, assigned["src"] == keep["id"], "left_semi").join(keep, assigned["dst"] == keep["id"], "left_semi")
    return rows, master_near_hash(rows, per_node)


def import_external(assigned: DataFrame, idmap: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A partition made elsewhere: edges (src, dst, part) with a loop for each vertex on its master, and routes (id, part, master_part).

    ``assigned``: idx (order of the file), src, dst, part.  ``idmap``: (a, b), id a is called b here; raises for an id that it
    lacks.  The master is the replica at id mod their number, in the order in which they first appear.
    """
    rows = assigned.select("idx", "src", "dst", "part")
    if idmap is not None:
        for end in ("src", "dst"):
            m = idmap.select(F.col("a").alias("was"), F.col("b").alias("now"))
            lost = F.raise_error(F.concat(F.lit("no new id for "), F.col(end).cast("string")))
            rows = rows.join(m, F.col(end) == F.col("was"), "left").withColumn(end, F.when(F.col("now").isNull(), lost).otherwise(F.col("now"))).drop("was", "now")
    r = replicas(rows)
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "part"))), lambda x: x["part"])
    masters = r.groupBy("id").agg(order.alias("all")).select("id", "all", F.element_at("all", (F.col("id") % F.size("all") + 1).cast("int")).alias("master_part"))
    loops = masters.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("master_part").alias("part"))
    edges = rows.where("src <> dst").select("src", "dst", "part").unionAll(loops)
    routes = masters.where(F.size("all") > 1).select("id", F.explode("all").alias("part"), "master_part")
    return edges, routes


def merged_partition(edges: DataFrame, inner: int = 8, per_node: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partitions of partitions (outer, inner_part, idx, src, dst) as one: edges (src, dst, part, idx), routes by the densest node, metrics."""
    rows = merge_hierarchical(edges, inner)
    k = (rows.agg(F.max("part")).first()[0] or 0) + 1
    # files are read in turn, a line of each
    order = numbered(rows, "at", [F.col("idx"), F.col("part")]).select("src", "dst", "part", F.col("at").alias("idx"))
    return rows, master_dense(order, per_node), metrics(order, k)


def master_back_rows(elected: DataFrame, backups: DataFrame) -> DataFrame:
    """(id, crashed_part, host_part, mirrors): what the backup master keeps of the master's list, without itself."""
    m = master_routes(elected).join(backups.select("id", "backup_part"), "id")
    return m.select("id", F.col("master_part").alias("crashed_part"), F.col("backup_part").alias("host_part"), F.array_remove("mirrors", F.col("backup_part")).alias("mirrors"))


def mirror_routes(elected: DataFrame) -> DataFrame:
    """(id, part, master_part) of the mirrors alone."""
    return elected.where("part <> master_part").select("id", "part", "master_part")


def master_routes(elected: DataFrame) -> DataFrame:
    """(id, master_part, mirrors): the master's sorted list of mirror parts."""
    return mirror_routes(elected).groupBy("id", "master_part").agg(F.sort_array(F.collect_list("part")).alias("mirrors"))


def connections(elected: DataFrame) -> DataFrame:
    """(part, connections): one for each mirror a part is or serves."""
    m = mirror_routes(elected)
    return m.select("part").unionAll(m.select("master_part")).groupBy("part").agg(F.count(F.lit(1)).alias("connections"))


def inner_outer(elected: DataFrame, per_node: int = 2) -> DataFrame:
    """(part, inner_connect, outer_connect): as :func:`connections`, by whether both parts share a node."""
    m = mirror_routes(elected).withColumn("same", F.floor(F.col("part") / per_node) == F.floor(F.col("master_part") / per_node))
    both = m.select("part", "same").unionAll(m.select("master_part", "same"))
    return both.groupBy("part").agg(F.sum(F.col("same").cast("long")).alias("inner_connect"), F.sum((~F.col("same")).cast("long")).alias("outer_connect"))


def repair(elected: DataFrame, backups: DataFrame, dead: int) -> DataFrame:
    """Routes (id, part, master_part) after part ``dead`` is lost.

    Its mirrors leave; vertices it was master of turn to their backup master, which is a mirror no more;
    vertices left with one replica have no route.
    """
    b = backups.select("id", "backup_part")
    r = elected.where(F.col("part") != dead).join(b, "id")
    r = r.select("id", "part", F.when(F.col("master_part") == dead, F.col("backup_part")).otherwise(F.col("master_part")).alias("master_part"))
    return mirror_routes(r)
