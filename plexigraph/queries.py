"""The graph queries, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexigraph.functions import attribute, clean
from plexigraph.operators import gcn, pagerank, partition, paths, sets, transforms
from plexigraph.plans.fixpoint import Superstep
from plexigraph.plans.prefix import numbered, prefix_sums
from plexigraph.sources import files, graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

G_MULTI = """gm AS (SELECT src, dst, weight FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS dst,
    1 + o_orderkey % 7 AS weight FROM orders) WHERE dst IS NOT NULL)"""
G_CUST = G_MULTI + ", e AS (SELECT src, dst, min(weight) AS weight FROM gm WHERE src <> dst GROUP BY src, dst)"
V = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
DEG = "d AS (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id)"
PART = """a AS (SELECT src, dst, (dst % 4)::INT AS part, row_number() OVER (ORDER BY src, dst) AS idx FROM e),
    r AS (SELECT id, part, min(f) AS first FROM (SELECT src AS id, part, 2 * idx AS f FROM a UNION ALL SELECT dst, part, 2 * idx + 1 FROM a) GROUP BY id, part),
    s AS (SELECT id, list_sort(list(part)) AS p, len(list(part)) AS n, arg_max(part, first) AS last FROM r GROUP BY id HAVING count(*) > 1)"""
M_MOD = "m AS (SELECT r.id, r.part, p[id % n + 1] AS master_part FROM r JOIN s USING (id))"
EMB = """x AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS x, label, CASE WHEN vec_id % 10 < 6 THEN 1 WHEN vec_id % 10 < 8 THEN 2 ELSE 3 END AS split FROM embeddings),
    n AS (SELECT count(*) AS n FROM x), e AS (SELECT id AS src, (7 * id + 1) % n AS dst FROM x, n UNION SELECT id, (13 * id + 5) % n FROM x, n UNION SELECT id, id FROM x)"""
COEF = DEG + ", c AS (SELECT src, dst, 1 / sqrt(u.out_degree * w.in_degree) AS coef FROM e JOIN d u ON u.id = src JOIN d w ON w.id = dst)"


def _weights(name: str, n: int, m: int) -> str:
    return f"{name} AS (SELECT i, j, (((i * 31 + j * 17) % 101) - 50) / 500.0::DOUBLE AS w FROM range({n}) a(i), range({m}) b(j))"


FORWARD = f"""{EMB}, {COEF}, {_weights("w1", 64, 8)}, {_weights("w2", 8, 10)},
    l AS (SELECT id, i, x[i + 1] AS x FROM x, range(64) t(i)),
    p1 AS (SELECT id, j, sum(x * w) AS x FROM l JOIN w1 USING (i) GROUP BY id, j),
    h AS (SELECT dst AS id, j, sum(x * coef) AS x FROM p1 JOIN c ON c.src = p1.id GROUP BY dst, j),
    p2 AS (SELECT id, w2.j, sum(greatest(x, 0) * w) AS x FROM h JOIN w2 ON w2.i = h.j GROUP BY id, w2.j),
    z AS (SELECT dst AS id, j, sum(x * coef) AS x FROM p2 JOIN c ON c.src = p2.id GROUP BY dst, j)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + "\n"


# ---- edge lists


@query(_with(G_MULTI) + "SELECT src, dst, weight FROM gm WHERE src <> dst")
def edges_no_loops(spark, sf):
    return transforms.no_loops(graphs.g_multi(spark, sf))


@query(_with(G_MULTI) + "SELECT DISTINCT src, dst FROM gm")
def edges_dedup(spark, sf):
    return transforms.dedup(graphs.g_multi(spark, sf))


@query(_with(G_CUST, V) + "SELECT src, dst FROM e UNION ALL SELECT id, id FROM v")
def add_self_loops(spark, sf):
    return transforms.add_self_loops(graphs.g_cust(spark, sf))


@query(_with(G_CUST) + "SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def symmetrize(spark, sf):
    return transforms.symmetrize(graphs.g_cust(spark, sf))


@query(_with(G_CUST, V) + "SELECT id, count(dst) AS n, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS targets FROM v LEFT JOIN e ON src = id GROUP BY id")
def adjacency(spark, sf):
    return transforms.adjacency(graphs.g_cust(spark, sf))


@query(_with(G_CUST, V) + 'SELECT id, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", n FROM (SELECT id, count(dst) AS n FROM v LEFT JOIN e ON src = id GROUP BY id)')
def csr_offsets(spark, sf):
    return transforms.csr(graphs.g_cust(spark, sf))


G_USER = "u AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND dst <> src)"


@query(_with(G_USER) + "SELECT a.src, a.dst FROM u a JOIN u b ON a.src = b.dst AND a.dst = b.src")
def reverse_edges(spark, sf):
    return transforms.reverse_edges(graphs.g_user(spark, sf))


@query(_with(G_USER, "i AS (SELECT row_number() OVER (ORDER BY src, dst) AS idx, src, dst FROM u)") + "SELECT a.idx, a.src, a.dst FROM i a JOIN i b ON a.src = b.dst AND a.dst = b.src AND a.idx >= b.idx ORDER BY 1 LIMIT 1")
def first_reverse_edge(spark, sf):
    return transforms.first_reverse(numbered(graphs.g_user(spark, sf), "idx", [F.col("src"), F.col("dst")]))


@query(_with(G_CUST, "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)") + "SELECT id, coalesce(string_agg((dst + 1)::VARCHAR, ' ' ORDER BY dst), '') AS line FROM range((SELECT max(greatest(src, dst)) + 1 FROM e)) t(id) LEFT JOIN b ON src = id GROUP BY id")
def metis_input(spark, sf):
    return transforms.metis_lines(graphs.g_cust(spark, sf))


@query(_with(G_CUST, "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)") + "SELECT (SELECT max(greatest(src, dst)) + 1 FROM e) AS n, count(*) // 2 AS m FROM b")
def metis_header(spark, sf):
    return transforms.metis_header(graphs.g_cust(spark, sf))


@query(_with(G_CUST, DEG) + "SELECT * FROM d")
def degrees(spark, sf):
    return transforms.degrees(graphs.g_cust(spark, sf))


@query(_with(G_CUST, DEG) + "SELECT id, out_degree + in_degree AS degree FROM d")
def total_degree(spark, sf):
    return transforms.total_degree(graphs.g_cust(spark, sf))


ORDER = "o AS (SELECT src, dst, (u.out_degree + u.in_degree + w.out_degree + w.in_degree) AS degsum FROM e JOIN d u ON u.id = src JOIN d w ON w.id = dst), oi AS (SELECT src, dst, degsum, row_number() OVER (ORDER BY degsum, src, dst) AS idx FROM o)"


@query(_with(G_CUST, DEG, ORDER) + "SELECT * FROM oi")
def edge_degree_order(spark, sf):
    return transforms.degree_order(graphs.g_cust(spark, sf))


@query(_with(G_CUST) + "SELECT src, dst FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0")
def induced_subgraph(spark, sf):
    g = graphs.g_cust(spark, sf)
    return transforms.induced(g.select("src", "dst"), transforms.vertices(g).where("id % 3 <> 0"))


@query("SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 10 IN (8, 9) THEN 3 WHEN vec_id % 10 IN (6, 7) THEN 2 WHEN vec_id % 10 < 5 THEN 1 ELSE 0 END AS split FROM embeddings")
def split_vector(spark, sf):
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"))
    return transforms.split_vector(ids, ids.where("id % 10 < 5"), ids.where("id % 10 in (6, 7)"), ids.where("id % 10 in (8, 9)"))


@query("SELECT vec_id::BIGINT AS id, array_to_string(list_transform(embedding, lambda v: printf('%.8f ', v::DOUBLE)), '') AS line FROM embeddings")
def features_text(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return files.features_text(x)


@query(_with(G_CUST) + "SELECT src, dst, ((src % 4) * 2 + dst % 2)::INT AS part, row_number() OVER (PARTITION BY src % 4, dst % 2 ORDER BY src, dst) AS idx FROM e")
def merge_hierarchical(spark, sf):
    g = graphs.g_cust(spark, sf).select("src", "dst", (F.col("src") % 4).cast("int").alias("outer"), (F.col("dst") % 2).cast("int").alias("inner_part"))
    placed = prefix_sums(g, F.col("outer") * 2 + F.col("inner_part"), F.lit(1), [F.col("src"), F.col("dst")])
    g = placed.select("__row.*", (F.col("__before") + 1).alias("idx"))
    return transforms.merge_hierarchical(g, 2)


@query("SELECT sum(i)::BIGINT AS total FROM range((SELECT count(*) FROM orders)) t(i)")
def range_sum(spark, sf):
    return spark.range(spark.read.parquet(f"{sf}/orders.parquet").count()).agg(F.sum("id").alias("total"))


# ---- paths and components


CC = """cc(id, label) USING KEY (id) AS (SELECT id, id FROM v UNION
    SELECT c.id, n.label FROM (SELECT dst AS id, min(cc.label) AS label FROM cc JOIN {e} ON src = cc.id GROUP BY dst) n JOIN recurring.cc c ON c.id = n.id WHERE n.label < c.label)"""
SP = """sp(id, dist) USING KEY (id) AS (SELECT id, CASE WHEN {source} THEN 0::BIGINT END FROM v UNION
    SELECT c.id, n.dist FROM (SELECT dst AS id, min(sp.dist + {w}) AS dist FROM sp JOIN {e} ON src = sp.id WHERE sp.dist IS NOT NULL GROUP BY dst) n
    JOIN recurring.sp c ON c.id = n.id WHERE c.dist IS NULL OR n.dist < c.dist)"""
BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(_with(G_CUST, V, CC.format(e="e"), recursive=True) + "SELECT * FROM cc")
def cc_directed(spark, sf):
    return paths.cc(graphs.g_cust(spark, sf))


@query(_with("e AS (SELECT (1000 + n_regionkey)::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation UNION ALL SELECT 10000 + s_suppkey, s_nationkey FROM supplier)", V, BOTH, CC.format(e="b"), recursive=True) + "SELECT * FROM cc")
def cc_weak(spark, sf):
    from plexigraph.operators.components import weak_components

    return weak_components(graphs.g_tree(spark, sf))


@query(_with(G_CUST, V, BOTH, SP.format(source="id % 50 = 0", w="1", e="b"), recursive=True) + "SELECT * FROM sp")
def bfs_depth(spark, sf):
    return paths.bfs_depth(graphs.g_cust(spark, sf), 50)


@query(_with(G_CUST, V, SP.format(source="id % 100 = 1", w="1", e="e"), recursive=True) + "SELECT * FROM sp")
def sssp_multi(spark, sf):
    return paths.sssp(graphs.g_cust(spark, sf), weighted=False)


@query(_with(G_CUST, V, SP.format(source="id = (SELECT min(src) FROM e)", w="1", e="e"), recursive=True) + "SELECT * FROM sp")
def sssp_single(spark, sf):
    g = graphs.g_cust(spark, sf)
    return paths.sssp(g, F.col("id") == F.lit(g.agg(F.min("src")).first()[0]), weighted=False)


@query(_with(G_CUST, V, SP.format(source="id % 100 = 1", w="weight", e="e"), recursive=True) + "SELECT * FROM sp")
def sssp_weighted(spark, sf):
    return paths.sssp(graphs.g_cust(spark, sf))


def _steps_sql(rounds: int = 16) -> str:
    """Changes of each superstep of the directed components, unrolled; on larger graphs than the rounds allow the sum of changes tells."""
    parts = [G_CUST, V, "p0 AS (SELECT id, id AS label FROM v)"]
    for k in range(1, rounds + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT p.id, least(p.label, coalesce(n.label, p.label)) AS label FROM p{k - 1} p LEFT JOIN (SELECT dst AS id, min(label) AS label FROM e JOIN p{k - 1} ON p{k - 1}.id = src GROUP BY dst) n ON n.id = p.id)")
        senders = "(SELECT id FROM v)" if k == 1 else f"(SELECT a.id FROM p{k - 1} a JOIN p{k - 2} b ON a.id = b.id AND a.label <> b.label)"
        parts.append(f"s{k} AS (SELECT {k - 1} AS step, (SELECT count(*) FROM {senders}) AS senders, (SELECT count(*) FROM e WHERE src IN {senders}) AS messages, (SELECT count(DISTINCT dst) FROM e WHERE src IN {senders}) AS receivers, (SELECT count(*) FROM p{k} a JOIN p{k - 1} b ON a.id = b.id AND a.label <> b.label) AS active)")
    return _with(*parts) + "SELECT step::INT AS step, senders, messages, receivers, active FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, rounds + 1)) + ") WHERE senders > 0"


@query(_steps_sql())
def superstep_stats(spark, sf):
    """What each superstep of the directed components did."""
    stats: list[Superstep] = []
    paths.cc(graphs.g_cust(spark, sf), stats=stats)
    return spark.createDataFrame([(x.step, x.senders, x.messages, x.receivers, x.active) for x in stats], "step int, senders long, messages long, receivers long, active long")


@query(_with(G_CUST, V, CC.format(e="e"), recursive=True) + "SELECT count(*) FILTER (label <> id) AS n FROM cc")
def visited_count(spark, sf):
    """Vertices whose label has moved."""
    labels = paths.cc(graphs.g_cust(spark, sf))
    return transforms.visited(labels.select("id", (F.col("label") != F.col("id")).cast("int").alias("active")))


@query(_with(G_CUST, V) + "SELECT p.p, v.id AS v FROM (VALUES (1::BIGINT, 1), (2, 2)) p(p, attr) JOIN v ON v.id % 100 = p.attr WHERE p.p = 2 OR EXISTS (SELECT 1 FROM e WHERE src = v.id AND dst % 100 = 2)")
def graph_simulation(spark, sf):
    g = graphs.g_cust(spark, sf)
    nodes = transforms.vertices(g).withColumn("attr", attribute(F.col("id")))
    return paths.simulation(nodes, g, spark.createDataFrame([(1, 1), (2, 2)], "id long, attr int"), spark.createDataFrame([(1, 2)], "src long, dst long"))


def _rank_sql(gpu: bool, rounds: int = 10) -> str:
    parts = [G_CUST, DEG, "n AS (SELECT count(*)::DOUBLE AS n FROM d)", "p0 AS (SELECT id, 1.0::DOUBLE AS pr FROM d)"]
    for k in range(rounds):
        lost = f"(SELECT coalesce(sum(pr), 0) FROM p{k} JOIN d USING (id) WHERE out_degree = 0) / (SELECT n FROM n)" if gpu else "0.0::DOUBLE"
        rank = f"0.15::DOUBLE + 0.85::DOUBLE * (coalesce(acc, 0) + {lost})"
        rank = rank if gpu else f"CASE WHEN in_degree = 0 THEN 1.0::DOUBLE ELSE {rank} END"
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT d.id, {rank} AS pr FROM d LEFT JOIN (SELECT dst AS id, sum(pr / out_degree) AS acc FROM e JOIN p{k} ON p{k}.id = src JOIN d ON d.id = src GROUP BY dst) USING (id))")
    return _with(*parts) + f"SELECT id, round(pr, 6) + 0.0::DOUBLE AS pr FROM p{rounds}"


@query(_rank_sql(False))
def pagerank_cpu_k10(spark, sf):
    return pagerank.pagerank(graphs.g_cust(spark, sf), "cpu", 10).select("id", clean(F.col("pr")).alias("pr"))


@query(_rank_sql(True))
def pagerank_gpu_k10(spark, sf):
    return pagerank.pagerank(graphs.g_cust(spark, sf), "gpu", 10).select("id", clean(F.col("pr")).alias("pr"))


# ---- partitioning


def _greedy_sql(alpha: str, beta: str, gama: float = 0, k: int = 4, share: bool = False, edges: str = G_CUST) -> str:
    if share:  # in proportion to the node's replicas
        bonus = lambda x: f" + {gama} * ((CASE WHEN list_contains(has[(j // 2) * 2 + 1], {x}) THEN 1 ELSE 0 END) + (CASE WHEN list_contains(has[(j // 2) * 2 + 2], {x}) THEN 1 ELSE 0 END)) / 2.0"
    else:
        bonus = lambda x: f" + CASE WHEN list_contains(has[(j // 2) * 2 + 1], {x}) OR list_contains(has[(j // 2) * 2 + 2], {x}) THEN {gama} ELSE 0.0 END"
    lack = lambda x: f"(CASE WHEN list_contains(has[j + 1], {x}) THEN 0.0 ELSE -1.0" + (bonus(x) if gama else "") + " END)::DOUBLE"
    score = f"({lack('u')} + {lack('w')} - {alpha}::DOUBLE * load[j + 1] / full_ - {beta}::DOUBLE * cnt[j + 1] / n * {k})"
    return _with(
        edges, DEG, ORDER, f"k AS (SELECT greatest(1, (SELECT count(*) FROM e) // {k}) AS full_, (SELECT count(*) FROM d)::DOUBLE AS n)",
        f"""g(idx, src, dst, part, load, cnt, has) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INT, list_value({", ".join(["0::BIGINT"] * k)}), list_value({", ".join(["0::BIGINT"] * k)}), list_value({", ".join(["[]::BIGINT[]"] * k)})
        UNION ALL SELECT idx, u, w, part, list_transform(load, lambda x, i: CASE WHEN i = part + 1 THEN x + 1 ELSE x END),
            list_transform(cnt, lambda x, i: CASE WHEN i = part + 1 THEN x + (CASE WHEN list_contains(has[part + 1], u) THEN 0 ELSE 1 END) + (CASE WHEN u = w OR list_contains(has[part + 1], w) THEN 0 ELSE 1 END) ELSE x END),
            list_transform(has, lambda x, i: CASE WHEN i = part + 1 THEN list_distinct(x || [u, w]) ELSE x END)
        FROM (SELECT oi.idx, oi.src AS u, oi.dst AS w, g.load, g.cnt, g.has, (list_position(s, list_max(s)) - 1)::INT AS part
              FROM (SELECT g.idx AS gi, load, cnt, has, oi.src AS u, oi.dst AS w, list_transform(range({k}), lambda j: {score}) AS s FROM g JOIN oi ON oi.idx = g.idx + 1, k) q JOIN oi ON oi.idx = q.gi + 1 JOIN g ON g.idx = q.gi))""",
        recursive=True,
    ) + "SELECT idx, src, dst, part FROM g WHERE idx > 0"


@query(_greedy_sql("1.0", "1.0"))
def ebv_assign(spark, sf):
    return partition.ebv(graphs.g_cust(spark, sf), 4, 1.0, 1.0)


@query(_greedy_sql("0.01", "0.01"))
def ebv_sequential(spark, sf):
    return partition.ebv(graphs.g_cust(spark, sf), 4, 0.01, 0.01)


@query(_greedy_sql("1.0", "1.0", 0.5))
def ebv_node_aware(spark, sf):
    return partition.ebv(graphs.g_cust(spark, sf), 4, 1.0, 1.0, gama=0.5, per_node=2)


@query(_greedy_sql("1.0", "1.0", 0.5, share=True))
def ebv_node_share(spark, sf):
    return partition.ebv(graphs.g_cust(spark, sf), 4, 1.0, 1.0, gama=0.5, per_node=2, share=True)


def _two_level_sql(outer: int = 4, inner: int = 2) -> str:
    own = [_greedy_sql("1.0", "1.0", k=inner, edges=G_MULTI + f", e AS (SELECT src, dst, min(weight) AS weight FROM gm WHERE src <> dst AND dst % {outer} = {i} GROUP BY src, dst)") for i in range(outer)]
    return " UNION ALL ".join(f"SELECT src, dst, ({i * inner} + part)::INT AS part, idx FROM ({x})" for i, x in enumerate(own))


@query(_two_level_sql())
def ebv_two_level(spark, sf):
    return partition.ebv_two_level(graphs.g_cust(spark, sf))


@query()
def ebv_bulk_sync(spark, sf):
    return partition.bulk_sync(graphs.g_cust(spark, sf)).drop("host_part")


@query()
def ebv_backup(spark, sf):
    return partition.bulk_sync(graphs.g_cust(spark, sf), fault_weight=0.5, backup=True)


def _assigned(spark, sf):
    return partition.dst_owner(graphs.g_cust(spark, sf))


@query(_with(G_CUST) + "SELECT src, dst, (dst % 4)::INT AS part FROM e")
def part_dst_owner(spark, sf):
    return _assigned(spark, sf)


@query(_with(G_CUST) + "SELECT src, dst, ((dst * 7) % 5)::INT AS part FROM e")
def part_by_vertex(spark, sf):
    g = graphs.g_cust(spark, sf)
    return partition.by_vertex_part(g, transforms.vertices(g).withColumn("part", (F.col("id") * 7 % 5).cast("int")))


@query(_with(G_CUST, V, "l AS (SELECT src, dst, (dst * 7 % 5)::INT AS part FROM e UNION ALL SELECT id, id, (id * 7 % 5)::INT FROM v)", "r AS (SELECT src AS id, part FROM l UNION SELECT dst, part FROM l)") + "SELECT id, part, (id * 7 % 5)::INT AS master_part FROM r WHERE id IN (SELECT id FROM r GROUP BY id HAVING count(*) > 1)")
def part_by_vertex_routes(spark, sf):
    g = transforms.add_self_loops(graphs.g_cust(spark, sf))
    return partition.by_vertex_routes(g, transforms.vertices(g).withColumn("part", (F.col("id") * 7 % 5).cast("int")))


@query(_with(G_CUST, PART) + "SELECT id, part, first FROM r")
def replica_sets(spark, sf):
    return partition.replicas(_assigned(spark, sf))


@query(_with(G_CUST, PART) + "SELECT t.k AS replicas, count(q.id) AS n FROM range(5) t(k) LEFT JOIN (SELECT id, count(*) AS c FROM r GROUP BY id) q ON q.c = t.k GROUP BY t.k")
def replica_histogram(spark, sf):
    return partition.replica_histogram(_assigned(spark, sf), 4)


@query(_with(G_CUST, PART) + """SELECT round(edge_imbalance, 6) AS edge_imbalance, round(vertex_imbalance, 6) AS vertex_imbalance, round(replication, 6) AS replication FROM
    (SELECT max(c) / sum(c) * 4 AS edge_imbalance FROM (SELECT count(*) AS c FROM a GROUP BY part)), (SELECT max(c) / sum(c) * 4 AS vertex_imbalance, sum(c) / (SELECT count(DISTINCT id) FROM r) AS replication FROM (SELECT count(*) AS c FROM r GROUP BY part))""")
def part_metrics(spark, sf):
    m = partition.metrics(_assigned(spark, sf), 4)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(_with(G_CUST, PART, M_MOD) + "SELECT * FROM m")
def master_mod(spark, sf):
    return partition.master_mod(_assigned(spark, sf))


@query(_with(G_CUST, PART) + "SELECT id, p[id % n + 1] AS master_part, p[CASE WHEN id % (n - 1) >= id % n THEN id % (n - 1) + 2 ELSE id % (n - 1) + 1 END] AS backup_part FROM s")
def master_backup(spark, sf):
    return partition.backup_masters(_assigned(spark, sf))


@query(_with(G_CUST, PART) + "SELECT r.id, r.part, s.last AS master_part FROM r JOIN s USING (id)")
def master_last(spark, sf):
    return partition.master_last(_assigned(spark, sf))


@query(_with(G_CUST, PART) + """SELECT r.id, r.part, x.part AS master_part FROM r JOIN s USING (id) JOIN
    (SELECT id, part FROM (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY c DESC, first DESC) AS k FROM (SELECT *, count(*) OVER (PARTITION BY id, part // 2) AS c FROM r)) WHERE k = 1) x ON x.id = r.id""")
def master_dense_node(spark, sf):
    return partition.master_dense(_assigned(spark, sf), 2)


@query(_with(G_CUST, PART, M_MOD) + "SELECT * FROM m WHERE part <> master_part")
def mirror_routes(spark, sf):
    return partition.mirror_routes(partition.master_mod(_assigned(spark, sf)))


@query(_with(G_CUST, PART, M_MOD) + "SELECT id, master_part, string_agg(part::VARCHAR, ' ' ORDER BY part) AS mirrors FROM m WHERE part <> master_part GROUP BY 1, 2")
def master_routes(spark, sf):
    r = partition.master_routes(partition.master_mod(_assigned(spark, sf)))
    return r.withColumn("mirrors", F.array_join(F.col("mirrors").cast("array<string>"), " "))


@query(_with(G_CUST, PART, M_MOD) + "SELECT part, count(*) AS connections FROM (SELECT part FROM m WHERE part <> master_part UNION ALL SELECT master_part FROM m WHERE part <> master_part) GROUP BY part")
def connections(spark, sf):
    return partition.connections(partition.master_mod(_assigned(spark, sf)))


@query(_with(G_CUST, PART, M_MOD, "b AS (SELECT part, part // 2 = master_part // 2 AS same FROM m WHERE part <> master_part UNION ALL SELECT master_part, part // 2 = master_part // 2 FROM m WHERE part <> master_part)") + "SELECT part, count(*) FILTER (same) AS inner_connect, count(*) FILTER (NOT same) AS outer_connect FROM b GROUP BY part")
def inner_outer(spark, sf):
    return partition.inner_outer(partition.master_mod(_assigned(spark, sf)), 2)


@query(_with(G_CUST, PART, M_MOD, "b AS (SELECT id, p[CASE WHEN id % (n - 1) >= id % n THEN id % (n - 1) + 2 ELSE id % (n - 1) + 1 END] AS backup_part FROM s)") + "SELECT * FROM (SELECT id, part, CASE WHEN master_part = 1 THEN backup_part ELSE master_part END AS master_part FROM m JOIN b USING (id) WHERE part <> 1) WHERE part <> master_part")
def route_repair(spark, sf):
    a = _assigned(spark, sf)
    return partition.repair(partition.master_mod(a), partition.backup_masters(a), 1)


# ---- graph convolution


def _emb(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    k = F.col("vec_id") % 10
    x = t.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    labels = t.select(F.col("vec_id").cast("long").alias("id"), "label", F.when(k < 6, 1).when(k < 8, 2).otherwise(3).alias("split"))
    return x, labels, gcn.coefficients(graphs.g_emb(spark, sf))


def _long(x: DataFrame, digits: int = 6) -> DataFrame:
    return x.select("id", F.posexplode("x").alias("j", "v")).select("id", F.col("j").cast("long").alias("j"), clean(F.col("v"), digits).alias("x"))


_Z = "SELECT id, j, round(x, 6) + 0.0::DOUBLE AS x FROM "
_W = [gcn.fixed_weights(64, 8), gcn.fixed_weights(8, 10)]


@query(_with(EMB, COEF) + "SELECT src, dst, round(coef, 6) AS coef FROM c")
def gcn_coef(spark, sf):
    return _emb(spark, sf)[2].select("src", "dst", F.round("coef", 6).alias("coef"))


@query(_with(EMB, COEF) + "SELECT dst AS id, j, round(sum(x[j + 1] * coef), 6) + 0.0::DOUBLE AS x FROM c JOIN x ON x.id = src, range(64) t(j) GROUP BY dst, j")
def gcn_graphsum(spark, sf):
    x, _, coef = _emb(spark, sf)
    return _long(gcn.graph_sum(coef, x, 64))


@query(_with(EMB, COEF) + "SELECT src AS id, j, round(sum(x[j + 1] * coef), 6) + 0.0::DOUBLE AS x FROM c JOIN x ON x.id = dst, range(64) t(j) GROUP BY src, j")
def gcn_graphsum_bwd(spark, sf):
    x, _, coef = _emb(spark, sf)
    return _long(gcn.graph_sum(coef, x, 64, backward=True))


@query("WITH " + FORWARD + _Z + "p1")
def gcn_matmul(spark, sf):
    return _long(gcn.matmul(_emb(spark, sf)[0], _W[0]))


@query("WITH " + FORWARD + "SELECT i, j, round(sum(l.x * h.x), 4) + 0.0::DOUBLE AS g FROM l JOIN h USING (id) GROUP BY i, j")
def gcn_matmul_bwd(spark, sf):
    x, _, coef = _emb(spark, sf)
    g = gcn.matmul_weight_grad(x, gcn.graph_sum(coef, gcn.matmul(x, _W[0]), 8), (64, 8))
    return spark.createDataFrame([(i, j, float(round(g[i, j], 4)) + 0.0) for i in range(64) for j in range(8)], "i long, j long, g double")


@query("WITH " + FORWARD + "SELECT id, j, round(greatest(x, 0), 6) + 0.0::DOUBLE AS x FROM h")
def gcn_relu(spark, sf):
    x, _, coef = _emb(spark, sf)
    return _long(gcn.relu(gcn.graph_sum(coef, gcn.matmul(x, _W[0]), 8)))


@query("WITH " + FORWARD + _Z + "z")
def gcn_forward(spark, sf):
    x, _, coef = _emb(spark, sf)
    return _long(gcn.forward(coef, x, _W)[1])


_LOSS = ", mx AS (SELECT id, max(x) AS top FROM z GROUP BY id), se AS (SELECT id, sum(exp(x - top)) AS s FROM z JOIN mx USING (id) GROUP BY id), t AS (SELECT x.id, label, z.x AS own FROM x JOIN z ON z.id = x.id AND z.j = x.label WHERE split = {s})"


@query("WITH " + FORWARD + _LOSS.format(s=1) + "SELECT id, round(ln(s) - (own - top), 6) + 0.0::DOUBLE AS loss FROM t JOIN mx USING (id) JOIN se USING (id)")
def gcn_xent(spark, sf):
    x, labels, coef = _emb(spark, sf)
    return gcn.cross_entropy(gcn.forward(coef, x, _W)[1], gcn.truth(labels, 1)).select("id", clean(F.col("loss")).alias("loss"))


@query("WITH " + FORWARD + _LOSS.format(s=1) + "SELECT z.id, z.j, round(CASE WHEN split = 1 THEN exp(z.x - top) / s - CASE WHEN z.j = label THEN 1 ELSE 0 END ELSE 0 END, 6) + 0.0::DOUBLE AS x FROM z JOIN mx USING (id) JOIN se USING (id) JOIN x ON x.id = z.id")
def gcn_xent_grad(spark, sf):
    x, labels, coef = _emb(spark, sf)
    return _long(gcn.cross_entropy_grad(gcn.forward(coef, x, _W)[1], gcn.truth(labels, 1)))


@query("WITH " + FORWARD + _LOSS.format(s=2) + "SELECT round(avg(ln(s) - (own - top)), 6) AS loss, round(avg(CASE WHEN top <= own THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM t JOIN mx USING (id) JOIN se USING (id)")
def gcn_accuracy(spark, sf):
    x, labels, coef = _emb(spark, sf)
    return gcn.evaluate(gcn.forward(coef, x, _W)[1], gcn.truth(labels, 2)).select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def _as_weights(spark, sf) -> DataFrame:
    """The vectors as one weight matrix in long form."""
    return _emb(spark, sf)[0].select("id", F.posexplode("x").alias("j", "w")).select("id", F.col("j").cast("long").alias("j"), "w")


@query(f"WITH {EMB}, l AS (SELECT id, j, x[j + 1] AS w FROM x, range(64) t(j)) SELECT round(0.0005::DOUBLE * sum(w * w) / 2, 6) AS penalty FROM l")
def gcn_l2(spark, sf):
    return gcn.l2_table(_as_weights(spark, sf)).select(F.round("penalty", 6).alias("penalty"))


@query(f"""WITH {EMB}, l AS (SELECT id, j, x[j + 1] AS w, w * 3 + 0.01::DOUBLE + 0.0005::DOUBLE * w AS g, 0.1::DOUBLE * w AS m0, w * w AS v0 FROM x, range(64) t(j)),
    s AS (SELECT id, j, w, 0.9::DOUBLE * m0 + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * v0 + 0.001::DOUBLE * g * g AS v FROM l)
    SELECT id, j, round(w - 0.01::DOUBLE * sqrt(1 - pow(0.999::DOUBLE, 4)) / (1 - pow(0.9::DOUBLE, 4)) * m / (sqrt(v) + 1e-8), 6) + 0.0::DOUBLE AS w, round(m, 6) + 0.0::DOUBLE AS m, round(v, 6) + 0.0::DOUBLE AS v FROM s""")
def gcn_adam_step(spark, sf):
    """The fourth step, from given moments."""
    w = _as_weights(spark, sf).select("id", "j", "w", (F.col("w") * 3 + 0.01).alias("g"), (F.col("w") * 0.1).alias("m"), (F.col("w") * F.col("w")).alias("v"))
    return gcn.adam_table(w, 4).select("id", "j", *[clean(F.col(c)).alias(c) for c in ("w", "m", "v")])


@query("WITH q AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT id, x, list_min(x) AS low, list_max(x) AS high FROM q) SELECT id, j, CASE WHEN high > low THEN floor((x[j + 1] - low) / (high - low) * 255 + 0.5) ELSE 0 END::INT AS q FROM m, range(64) t(j)")
def gcn_quantize(spark, sf):
    return gcn.quantize(_emb(spark, sf)[0]).select("id", F.posexplode("q").alias("j", "q")).select("id", F.col("j").cast("long").alias("j"), "q")


@query("""WITH q AS (SELECT vec_id::BIGINT AS id, list_transform(embedding::DOUBLE[], lambda v: round(v, 1)) AS c, embedding::DOUBLE[] AS x FROM embeddings),
    m AS (SELECT id, x, c, list_max(list_transform(range(1, 65), lambda i: abs(x[i] - c[i]))) > list_max(list_transform(x, lambda v: abs(v))) * 0.1::DOUBLE AS sent FROM q)
    SELECT id, j, CASE WHEN sent THEN x[j + 1] ELSE c[j + 1] END AS x, sent FROM m, range(64) t(j)""")
def gcn_cached_sync(spark, sf):
    x = _emb(spark, sf)[0]
    out = gcn.cached_sync(x, x.select("id", F.transform("x", lambda v: F.round(v, 1)).alias("x")), 0.1)
    return out.select("id", F.posexplode("x").alias("j", "x"), "sent").select("id", F.col("j").cast("long").alias("j"), "x", "sent")


def _train_sql(epochs: int = 3) -> str:
    """Forward, backward and Adam, unrolled."""
    parts = [EMB, COEF, "l AS (SELECT id, i, x[i + 1] AS x FROM x, range(64) t(i))"]
    for name, n, m in (("w1", 64, 8), ("w2", 8, 10)):
        parts.append(f"{name}_1 AS (SELECT i, j, (((i * 31 + j * 17) % 101) - 50) / 500.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range({n}) a(i), range({m}) b(j))")
    for e in range(1, epochs + 1):
        step = f"0.01::DOUBLE * sqrt(1 - pow(0.999::DOUBLE, {e})) / (1 - pow(0.9::DOUBLE, {e}))"
        parts += [
            f"p1_{e} AS MATERIALIZED (SELECT id, j, sum(x * w) AS x FROM l JOIN w1_{e} USING (i) GROUP BY id, j)",
            f"h_{e} AS MATERIALIZED (SELECT dst AS id, j, sum(x * coef) AS x FROM p1_{e} p JOIN c ON c.src = p.id GROUP BY dst, j)",
            f"p2_{e} AS MATERIALIZED (SELECT id, w.j, sum(greatest(x, 0) * w) AS x FROM h_{e} h JOIN w2_{e} w ON w.i = h.j GROUP BY id, w.j)",
            f"z_{e} AS MATERIALIZED (SELECT dst AS id, j, sum(x * coef) AS x FROM p2_{e} p JOIN c ON c.src = p.id GROUP BY dst, j)",
            f"mx_{e} AS (SELECT id, max(x) AS top FROM z_{e} GROUP BY id)",
            f"se_{e} AS (SELECT id, top, sum(exp(x - top)) AS s FROM z_{e} JOIN mx_{e} USING (id) GROUP BY id, top)",
            f"r_{e} AS (SELECT {e} AS epoch, avg(ln(s) - (z.x - top)) + (SELECT 0.0005::DOUBLE * sum(w * w) / 2 FROM w1_{e}) AS loss, avg(CASE WHEN top <= z.x THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM x JOIN z_{e} z ON z.id = x.id AND z.j = x.label JOIN se_{e} s ON s.id = x.id WHERE split = 1)",
            f"gz_{e} AS (SELECT z.id, z.j, CASE WHEN split = 1 THEN exp(z.x - top) / s - CASE WHEN z.j = label THEN 1 ELSE 0 END ELSE 0 END AS x FROM z_{e} z JOIN se_{e} s ON s.id = z.id JOIN x ON x.id = z.id)",
            f"g2_{e} AS MATERIALIZED (SELECT src AS id, j, sum(x * coef) AS x FROM gz_{e} g JOIN c ON c.dst = g.id GROUP BY src, j)",
            f"d2_{e} AS (SELECT h.j AS i, g.j, sum(greatest(h.x, 0) * g.x) AS g FROM h_{e} h JOIN g2_{e} g USING (id) GROUP BY h.j, g.j)",
            f"b_{e} AS (SELECT g.id, w.i AS j, sum(g.x * w.w) AS x FROM g2_{e} g JOIN w2_{e} w ON w.j = g.j GROUP BY g.id, w.i)",
            f"g1_{e} AS MATERIALIZED (SELECT src AS id, j, sum(x * coef) AS x FROM (SELECT b.id, b.j, CASE WHEN h.x > 0 THEN b.x ELSE 0 END AS x FROM b_{e} b JOIN h_{e} h ON h.id = b.id AND h.j = b.j) b JOIN c ON c.dst = b.id GROUP BY src, j)",
            f"d1_{e} AS (SELECT i, g.j, sum(l.x * g.x) AS g FROM l JOIN g1_{e} g USING (id) GROUP BY i, g.j)",
        ]
        for k, decay in ((1, " + 0.0005::DOUBLE * w"), (2, "")):
            moments = f"SELECT i, j, w, 0.9::DOUBLE * m + 0.1::DOUBLE * (g{decay}) AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * (g{decay}) * (g{decay}) AS v FROM w{k}_{e} JOIN d{k}_{e} USING (i, j)"
            parts.append(f"w{k}_{e + 1} AS MATERIALIZED (SELECT i, j, w - {step} * m / (sqrt(v) + 1e-8) AS w, m, v FROM ({moments}))")
    return _with(*parts) + " UNION ALL ".join(f"SELECT epoch::INT AS epoch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM r_{e}" for e in range(1, epochs + 1))


@query(_train_sql())
def gcn_train(spark, sf):
    """(epoch, loss, accuracy) of three epochs from fixed weights."""
    x, labels, coef = _emb(spark, sf)
    rows = gcn.train(coef, x, labels, list(_W), 3, validate=None)[1]
    return spark.createDataFrame([(e, round(loss, 6), round(accuracy, 6)) for e, loss, accuracy in rows], "epoch int, loss double, accuracy double")


def _sparse(spark, sf) -> tuple[DataFrame, DataFrame]:
    x, _, coef = _emb(spark, sf)
    a = coef.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("coef").alias("x"))
    return a, x.select(F.col("id").alias("i"), F.posexplode("x").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), "x")


@query(_with(EMB, COEF) + "SELECT src AS i, j, round(sum(coef * x[j + 1]), 6) + 0.0::DOUBLE AS x FROM c JOIN x ON x.id = dst, range(64) t(j) GROUP BY src, j")
def sparse_matmul(spark, sf):
    return gcn.sparse_matmul(*_sparse(spark, sf)).select("i", "j", clean(F.col("x")).alias("x"))


@query(_with(EMB, COEF) + "SELECT dst AS i, j, round(sum(coef * x[j + 1]), 6) + 0.0::DOUBLE AS x FROM c JOIN x ON x.id = src, range(64) t(j) GROUP BY dst, j")
def sparse_matmul_bwd(spark, sf):
    return gcn.sparse_matmul_grad(*_sparse(spark, sf)).select("i", "j", clean(F.col("x")).alias("x"))


@query("WITH " + FORWARD + "SELECT h.id, h.j, round(CASE WHEN h.x > 0 THEN p1.x ELSE 0 END, 6) + 0.0::DOUBLE AS x FROM h JOIN p1 ON p1.id = h.id AND p1.j = h.j")
def gcn_relu_bwd(spark, sf):
    x, _, coef = _emb(spark, sf)
    grad = gcn.matmul(x, _W[0])
    return _long(gcn.relu_grad(grad, gcn.graph_sum(coef, grad, 8)))


@query("""WITH q AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT id, x, list_min(x) AS low, list_max(x) AS high FROM q)
    SELECT id, j, round(low + (high - low) * (CASE WHEN high > low THEN floor((x[j + 1] - low) / (high - low) * 255 + 0.5) ELSE 0 END) / 255, 6) + 0.0::DOUBLE AS x FROM m, range(64) t(j)""")
def gcn_dequantize(spark, sf):
    return _long(gcn.dequantize(gcn.quantize(_emb(spark, sf)[0])))


@query()
def gcn_dropout(spark, sf):
    """Vectors of which a fifth is dropped, by a hash of id and place."""
    return _long(gcn.dropout(_emb(spark, sf)[0], 0.2))


@query()
def gcn_delay_rates(spark, sf):
    """(window, layer, direction, rate) of ten epochs with cached sync over four parts."""
    x, labels, coef = _emb(spark, sf)
    rounds: list[tuple[int, int, str, int, int]] = []
    gcn.train(coef.withColumn("part", F.pmod("src", F.lit(4)).cast("int")), x, labels, list(_W), 10, validate=None, cached=True, rounds=rounds)
    return gcn.delay_rates(spark.createDataFrame(rounds, "epoch int, layer int, direction string, rows long, sent long"))


# ---- more of partitions and sets


_LOCAL = "r AS (SELECT DISTINCT id, part FROM (SELECT src AS id, (dst % 4)::INT AS part FROM e UNION ALL SELECT dst, (dst % 4)::INT FROM e))"


@query(_with(G_CUST, DEG, _LOCAL, "l AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS local FROM r)") + "SELECT part, local, out_degree AS value FROM l JOIN d USING (id)")
def degree_localised(spark, sf):
    local = transforms.local_ids(partition.replicas(_assigned(spark, sf)))
    return transforms.localize(local, transforms.degrees(graphs.g_cust(spark, sf)).select("id", F.col("out_degree").alias("value")))


@query(_with(G_CUST, _LOCAL) + "SELECT x.part AS a, y.part AS b, count(*) AS shared FROM r x JOIN r y ON x.id = y.id AND x.part < y.part GROUP BY 1, 2")
def part_overlaps(spark, sf):
    return sets.part_overlaps(partition.replicas(_assigned(spark, sf)))


_BACKUP = "b AS (SELECT id, p[CASE WHEN id % (n - 1) >= id % n THEN id % (n - 1) + 2 ELSE id % (n - 1) + 1 END] AS backup_part FROM s)"


@query(_with(G_CUST, PART, M_MOD, _BACKUP) + "SELECT id, master_part AS part FROM m UNION SELECT id, backup_part FROM b")
def back_nodes(spark, sf):
    a = _assigned(spark, sf)
    return sets.back_nodes(partition.master_mod(a), partition.backup_masters(a))


@query(_with(G_CUST) + "SELECT src, dst, (dst % 4)::INT AS part FROM e UNION ALL SELECT src, dst, ((dst + 1) % 4)::INT FROM e")
def edges_with_backup(spark, sf):
    a = _assigned(spark, sf)
    return sets.with_backup(a, a.select("src", "dst", ((F.col("part") + 1) % 4).alias("host_part")))


@query(_with(G_CUST, PART, M_MOD, _BACKUP) + "SELECT id, master_part AS crashed_part, backup_part AS host_part, array_to_string(list_filter(p, lambda x: x <> master_part AND x <> backup_part), ' ') AS mirrors FROM (SELECT DISTINCT id, master_part FROM m) JOIN b USING (id) JOIN s USING (id)")
def master_back_rows(spark, sf):
    a = _assigned(spark, sf)
    r = partition.master_back_rows(partition.master_mod(a), partition.backup_masters(a))
    return r.withColumn("mirrors", F.array_join(F.col("mirrors").cast("array<string>"), " "))


_NEAR = """c AS (SELECT *, count(*) OVER (PARTITION BY id, part // 2) AS on_node FROM r), w AS (SELECT *, max(on_node) OVER (PARTITION BY id) AS most FROM c),
    q AS (SELECT id, list_sort(list(part)) AS p, list_sort(list(part) FILTER (on_node = most)) AS dense FROM w GROUP BY id HAVING count(*) > 1),
    near AS (SELECT id, CASE WHEN list_contains(dense, p[id % len(p) + 1]) THEN p[id % len(p) + 1] ELSE dense[1] END AS master_part FROM q)"""


@query(_with(G_CUST, "a AS (SELECT src, dst, (dst % 4)::INT AS part FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0)", "r AS (SELECT src AS id, part FROM a UNION SELECT dst, part FROM a)", _NEAR) + "SELECT r.id, r.part, near.master_part FROM r JOIN near USING (id)")
def induced_routes(spark, sf):
    a = _assigned(spark, sf)
    return partition.induced_partition(a, transforms.vertices(a).where("id % 3 <> 0"))[1]


_EXTERNAL = """x AS (SELECT idx, src + 7 AS src, dst + 7 AS dst, part FROM (SELECT src, dst, (dst % 4)::INT AS part, row_number() OVER (ORDER BY src, dst) AS idx FROM e)),
    r AS (SELECT id, part, min(f) AS first FROM (SELECT src AS id, part, 2 * idx AS f FROM x UNION ALL SELECT dst, part, 2 * idx + 1 FROM x) GROUP BY id, part),
    s AS (SELECT id, list(part ORDER BY first) AS p FROM r GROUP BY id)"""


def _external(spark, sf):
    a = numbered(_assigned(spark, sf), "idx", [F.col("src"), F.col("dst")])
    ids = transforms.vertices(a)
    return partition.import_external(a, ids.select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")))


@query(_with(G_CUST, _EXTERNAL) + "SELECT src, dst, part FROM x UNION ALL SELECT id, id, p[id % len(p) + 1] FROM s")
def external_edges(spark, sf):
    return _external(spark, sf)[0]


@query(_with(G_CUST, _EXTERNAL) + "SELECT id, unnest(p) AS part, p[id % len(p) + 1] AS master_part FROM s WHERE len(p) > 1")
def external_routes(spark, sf):
    return _external(spark, sf)[1]


_MERGED = """f AS (SELECT src, dst, ((src % 4) * 2 + dst % 2)::INT AS part, row_number() OVER (PARTITION BY src % 4, dst % 2 ORDER BY src, dst) AS idx FROM e),
    a AS (SELECT src, dst, part, row_number() OVER (ORDER BY idx, part) AS idx FROM f),
    r AS (SELECT id, part, min(f) AS first FROM (SELECT src AS id, part, 2 * idx AS f FROM a UNION ALL SELECT dst, part, 2 * idx + 1 FROM a) GROUP BY id, part)"""


def _merged(spark, sf):
    g = graphs.g_cust(spark, sf).select("src", "dst", (F.col("src") % 4).cast("int").alias("outer"), (F.col("dst") % 2).cast("int").alias("inner_part"))
    placed = prefix_sums(g, F.col("outer") * 2 + F.col("inner_part"), F.lit(1), [F.col("src"), F.col("dst")])
    return partition.merged_partition(placed.select("__row.*", (F.col("__before") + 1).alias("idx")), 2)


@query(_with(G_CUST, _MERGED) + """SELECT r.id, r.part, x.part AS master_part FROM r JOIN (SELECT id FROM r GROUP BY id HAVING count(*) > 1) USING (id) JOIN
    (SELECT id, part FROM (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY c DESC, first DESC) AS k FROM (SELECT *, count(*) OVER (PARTITION BY id, part // 2) AS c FROM r)) WHERE k = 1) x ON x.id = r.id""")
def merged_routes(spark, sf):
    return _merged(spark, sf)[1]


@query(_with(G_CUST, _MERGED) + """SELECT round(edge_imbalance, 6) AS edge_imbalance, round(vertex_imbalance, 6) AS vertex_imbalance, round(replication, 6) AS replication FROM
    (SELECT max(c) / sum(c) * 8 AS edge_imbalance FROM (SELECT count(*) AS c FROM a GROUP BY part)), (SELECT max(c) / sum(c) * 8 AS vertex_imbalance, sum(c) / (SELECT count(DISTINCT id) FROM r) AS replication FROM (SELECT count(*) AS c FROM r GROUP BY part))""")
def merged_metrics(spark, sf):
    m = _merged(spark, sf)[2]
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])
