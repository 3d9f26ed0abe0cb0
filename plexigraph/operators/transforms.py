"""Edge list transforms: cleaning, degrees, adjacency, converters, induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexigraph.plans.prefix import numbered, prefix_sums, running


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def dedup(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def add_self_loops(edges: DataFrame) -> DataFrame:
    """One loop for every vertex, besides what is there."""
    v = vertices(edges)
    return edges.select("src", "dst").unionAll(v.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree); parallel edges count."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def total_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("id", (F.col("out_degree") + F.col("in_degree")).alias("degree"))


def with_degree_sum(edges: DataFrame) -> DataFrame:
    """Adds ``degsum``: the two ends' total degrees."""
    d = total_degree(edges)
    u, v = d.select(F.col("id").alias("src"), F.col("degree").alias("du")), d.select(F.col("id").alias("dst"), F.col("degree").alias("dv"))
    return edges.join(u, "src").join(v, "dst").select("src", "dst", (F.col("du") + F.col("dv")).alias("degsum"))


def degree_order(edges: DataFrame) -> DataFrame:
    """Edges numbered from 1 by (degree sum, src, dst); the last two settle ties that an unstable sort leaves open."""
    return numbered(with_degree_sum(edges), "idx", [F.col(c) for c in ("degsum", "src", "dst")])


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, n, targets): sorted target list of every vertex, an empty one too; parallel edges stay."""
    own = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("t"))
    t = F.coalesce("t", F.array().cast("array<bigint>"))
    return vertices(edges).join(own, "id", "left").select("id", F.size(t).cast("long").alias("n"), F.array_join(t.cast("array<string>"), " ").alias("targets"))


def csr(edges: DataFrame) -> DataFrame:
    """(id, offset, n): where each vertex's targets begin in one array sorted by (src, dst)."""
    n = degrees(edges).select("id", F.col("out_degree").alias("n"))
    return running(n, "offset", F.col("n"), [F.col("id")]).select("id", "offset", "n")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is in the list too."""
    e = dedup(edges)
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(r, ["src", "dst"], "left_semi")


def first_reverse(indexed: DataFrame) -> DataFrame:
    """``indexed``: (idx, src, dst).  The first edge whose reverse came before it or is it; no row if none."""
    a, b = indexed.alias("a"), indexed.alias("b")
    hit = a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.idx") >= F.col("b.idx")))
    return hit.agg(F.min(F.struct("a.idx", "a.src", "a.dst")).alias("x")).where("x is not null").select("x.*")


def metis_lines(edges: DataFrame) -> DataFrame:
    """(id, line): neighbours of each vertex, both directions, no loops, from 1 on, ascending; ids are 0 .. n - 1."""
    s = symmetrize(no_loops(edges))
    own = s.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: (x + 1).cast("string")), " ").alias("line"))
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    ids = edges.sparkSession.range(0 if n is None else n + 1)
    return ids.join(own, "id", "left").select("id", F.coalesce("line", F.lit("")).alias("line"))


def metis_header(edges: DataFrame) -> DataFrame:
    """(n, m): vertices and undirected edges."""
    s = symmetrize(no_loops(edges))
    return s.agg(F.lit((edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1).cast("long").alias("n"), F.floor(F.count(F.lit(1)) / 2).cast("long").alias("m"))


def induced(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges with both ends in ``active`` (id)."""
    keep = active.select("id").distinct()
    return edges.join(keep, edges["src"] == keep["id"], "left_semi").join(keep, edges["dst"] == keep["id"], "left_semi")


def split_vector(n: DataFrame, train: DataFrame, valid: DataFrame, test: DataFrame) -> DataFrame:
    """1, 2 or 3 for the ids of the three lists, 0 for others; of an id in several the last list holds."""
    lists = [x.select("id", F.lit(k).alias("split")) for k, x in ((1, train), (2, valid), (3, test))]
    s = lists[0].union(lists[1]).union(lists[2]).groupBy("id").agg(F.max("split").alias("split"))
    return n.join(s, "id", "left").select("id", F.coalesce("split", F.lit(0)).alias("split"))


def merge_hierarchical(edges: DataFrame, inner: int = 8) -> DataFrame:
    """``edges``: (outer, inner_part, idx, src, dst).  part = outer * inner + inner_part, interleaved by the index inside each file."""
    return edges.select("src", "dst", (F.col("outer") * inner + F.col("inner_part")).alias("part"), "idx")


def visited(state: DataFrame, value: str = "active") -> DataFrame:
    """How many vertices are active."""
    return state.agg(F.coalesce(F.sum((F.col(value) != 0).cast("long")), F.lit(0)).alias("n"))


def local_ids(members: DataFrame) -> DataFrame:
    """``members``: (id, part).  Adds ``local``: the vertex's place among its part's, by id, from 0 on."""
    placed = prefix_sums(members.select("id", "part").distinct(), F.col("part"), F.lit(1), [F.col("id")], "local")
    return placed.select("__row.id", "__row.part", F.col("__before").alias("local"))


def localize(local: DataFrame, vector: DataFrame) -> DataFrame:
    """A vector by vertex (id, value) as each part sees it: (part, local, value)."""
    return local.join(vector, "id").select("part", "local", "value")
