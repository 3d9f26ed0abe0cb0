"""Hand graphs, simulators and properties for the graph library."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexigraph.operators import gcn, pagerank, partition, paths, sets, transforms
from plexigraph.operators.components import weak_components
from plexigraph.sources import files

H1 = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 3)]


def frame(spark, edges):
    return spark.createDataFrame([(*e, 1) for e in edges], "src long, dst long, weight long")


def values(df):
    return {r[0]: tuple(r)[1:] if len(r) > 2 else r[1] for r in df.collect()}


def test_degrees_and_order(spark):
    g = frame(spark, H1)
    assert values(transforms.degrees(g)) == {0: (1, 1), 1: (1, 1), 2: (2, 1), 3: (0, 2), 4: (1, 0)}
    assert values(transforms.total_degree(g)) == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1}
    assert [tuple(r) for r in transforms.degree_order(g).orderBy("idx").select("src", "dst").collect()] == [(4, 3), (0, 1), (1, 2), (2, 0), (2, 3)]


def test_components(spark):
    g = frame(spark, H1)
    assert values(paths.cc(g)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert set(values(paths.cc(g, directed=False)).values()) == {0}
    assert set(values(weak_components(g)).values()) == {0}


def test_paths(spark):
    g = frame(spark, H1)
    assert values(paths.sssp(g)) == {0: 2, 1: 0, 2: 1, 3: 2, 4: None}
    assert values(paths.sssp(g, F.col("id") == 0)) == {0: 0, 1: 1, 2: 2, 3: 3, 4: None}


def test_pagerank_fixpoints(spark):
    g = frame(spark, H1)
    cpu = values(pagerank.pagerank(g, "cpu", 60, eps=1e-7))
    assert [cpu[i] for i in range(5)] == pytest.approx([0.386669, 0.478669, 0.556868, 1.236669, 1.0], abs=1e-5)
    gpu = values(pagerank.pagerank(g, "gpu", 12))
    assert sum(gpu.values()) == pytest.approx(5)


def test_ebv(spark):
    g = frame(spark, H1)
    parts = partition.ebv(g, 2)
    assert [r["part"] for r in parts.orderBy("idx").collect()] == [0, 1, 1, 1, 0]
    m = partition.metrics(parts, 2).first()
    assert (m["edge_imbalance"], m["vertex_imbalance"], m["replication"]) == pytest.approx((1.2, 1.0, 1.2))
    assert values(partition.replica_histogram(parts, 2)) == {0: 0, 1: 4, 2: 1}
    assert [tuple(r) for r in partition.mirror_routes(partition.master_mod(parts)).collect()] == [(2, 1, 0)]


def test_random_graph(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(40), rng.randrange(40), rng.randrange(1, 9)) for _ in range(90)})
    g = spark.createDataFrame(edges, "src long, dst long, weight long")
    ids = {x for e in edges for x in e[:2]}
    best = {i: 0 for i in ids if i % 100 == 1}
    heap = [(0, i) for i in best]
    while heap:
        d, i = heapq.heappop(heap)
        for u, v, w in edges:
            if u == i and d == best[i] and d + w < best.get(v, 1 << 30):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    assert values(paths.sssp(g)) == {i: best.get(i) for i in ids}
    for made in (partition.bulk_sync(g, 3, backup=True), partition.ebv_two_level(g, 2, 2), partition.ebv(g, 3, gama=0.5, per_node=2, share=True)):
        rows = made.collect()
        assert sorted((r["src"], r["dst"]) for r in rows) == sorted(e[:2] for e in edges)
        if "host_part" in made.columns:
            assert all(r["host_part"] not in (None, r["part"]) for r in rows)
    r = partition.master_mod(partition.dst_owner(g, 3)).collect()
    assert all(sum(x["part"] == x["master_part"] for x in r if x["id"] == i) == 1 for i in {x["id"] for x in r})


def test_simulation(spark):
    nodes = spark.createDataFrame([(i, i % 100) for i in (1, 2, 101, 3)], "id long, attr int")
    edges = spark.createDataFrame([(1, 2), (101, 3)], "src long, dst long")
    p = spark.createDataFrame([(0, 1), (1, 2)], "id long, attr int")
    assert sorted(tuple(r) for r in paths.simulation(nodes, edges, p, spark.createDataFrame([(0, 1)], "src long, dst long")).collect()) == [(0, 1), (1, 2)]


def test_gradient(spark):
    """The weights' gradient against differences of the summed loss."""
    rng = np.random.default_rng(1)
    g = frame(spark, [*H1, *((i, i) for i in range(5))])
    x = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(5)], "id long, x array<double>")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(5)], "id long, label int, split int")
    coef = gcn.coefficients(g).cache()
    w = [gcn.glorot(3, 2, 1), gcn.glorot(2, 2, 2)]
    loss = lambda ws: gcn.cross_entropy(gcn.forward(coef, x, ws)[1], gcn.truth(labels, 1)).agg(F.sum("loss")).first()[0]
    logits = gcn.forward(coef, x, w)
    g2 = gcn.graph_sum(coef, gcn.cross_entropy_grad(logits[1], gcn.truth(labels, 1)), 2, backward=True)
    dw2 = gcn.matmul_weight_grad(gcn.relu(logits[0]), g2, (2, 2))
    step = np.zeros((2, 2))
    step[0, 1] = 1e-5
    assert dw2[0, 1] == pytest.approx((loss([w[0], w[1] + step]) - loss([w[0], w[1] - step])) / 2e-5, abs=1e-5)


def test_files(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("0 1\r\n1 1 2.5\n\n2 0\n")
    assert sorted(tuple(r) for r in files.read_edges(spark, str(tmp_path / "edges.txt"), drop_self_loops=True).collect()) == [(0, 1, 1.0), (2, 0, 1.0)]
    (tmp_path / "deg.txt").write_text("3\n1\n4\n")
    assert values(files.read_positional(spark, str(tmp_path / "deg.txt"))) == {0: 3, 1: 1, 2: 4}
    (tmp_path / "feat.csv").write_text("1,2\n3,4.5\n")
    assert values(files.read_features(spark, str(tmp_path / "feat.csv"))) == {0: [1.0, 2.0], 1: [3.0, 4.5]}
    (tmp_path / "p.txt").write_text("0 5 2 1 2\n1 6 0\n2 7 0\n")
    nodes, edges = files.read_pattern(spark, str(tmp_path / "p.txt"))
    assert values(nodes) == {0: 5, 1: 6, 2: 7} and sorted(tuple(r) for r in edges.collect()) == [(0, 1), (0, 2)]
    d = tmp_path / "part"
    d.mkdir()
    (d / "G.0").write_text("0 1\n")
    (d / "G.1").write_text("2 1 3\n")
    (d / "Master.0").write_text("1 1 \n")
    (d / "Mirror.1").write_text("1 0\n")
    got = files.read_partition(spark, str(d))
    assert got["edges"].count() == 2 and got["masters"].first()["mirrors"] == [1] and got["mirrors"].first()["master_part"] == 0


def test_caps_are_not_silent(spark):
    from plexigraph.operators.components import weak_components
    from plexigraph.plans.fixpoint import VertexProgram, run_program

    path = spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "src long, dst long, weight long")
    state = spark.createDataFrame([(i, 0 if i == 0 else None) for i in range(7)], "id long, value long")
    hops = VertexProgram(lambda value, weight: value + weight)
    with pytest.raises(RuntimeError):
        run_program(hops, state, path, max_steps=3)
    with pytest.raises(RuntimeError):
        weak_components(path, max_rounds=1)
    assert {r["id"]: r["value"] for r in run_program(hops, state, path).collect()} == {i: i for i in range(7)}
    assert {r["label"] for r in weak_components(path).collect()} == {0}


def above(plan: str, what: str) -> list[str]:
    """The lines of the operators above the one that holds ``what``."""
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    at = next(i for i, x in enumerate(lines) if what in x)
    out, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if x.strip() and depth(x) < d:
            out.append(x)
            d = depth(x)
    return out


def test_edges_are_not_shuffled(spark):
    from plexigraph.plans.fixpoint import EdgeTable, State

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = frame(spark, H1)
        table = EdgeTable(g)
        front = spark.createDataFrame([(0, 0), (4, 1)], "id long, value long")
        plan = table.out_of(front)._jdf.queryExecution().executedPlan().toString()
        way = above(plan, "plexigraph_edges")
        assert any("SortMergeJoin" in x for x in way) and not any("Exchange" in x for x in way)
        state = State(front, table.n)
        got = spark.createDataFrame([(0, 5)], "id long, new long").groupBy("id").agg(F.min("new").alias("new"))
        way = above(state.beside(got)._jdf.queryExecution().executedPlan().toString(), "plexigraph_state")
        assert any("SortMergeJoin" in x for x in way) and not any("Exchange" in x for x in way)
        table.discard()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hubs_and_folding(spark):
    """A vertex of many edges is split, and the state is folded several times; the results stay."""
    from plexigraph.plans.fixpoint import EdgeTable, State, Superstep, VertexProgram, run_program

    g = spark.createDataFrame([(0, i, 1) for i in range(1, 50)] + [(i, i + 1, 1) for i in range(49, 70)], "src long, dst long, weight long")
    table = EdgeTable(g, hub=4)
    assert table.split and table.table.where("src = 0").select("salt").distinct().count() > 5
    out = table.out_of(spark.createDataFrame([(0, 7), (60, 8)], "id long, value long")).collect()
    assert sorted((r["src"], r["dst"], r["value"]) for r in out) == [(0, i, 7) for i in range(1, 50)] + [(60, 61, 8)]
    stats: list[Superstep] = []
    state = transforms.vertices(g).select("id", F.when(F.col("id") == 0, F.lit(0).cast("long")).alias("value"))
    got = run_program(VertexProgram(lambda v, w: v + w), state, g, stats=stats)
    assert values(got) == {i: 0 if i == 0 else max(1, i - 48) for i in range(71)}
    assert len(stats) == 23 and stats[0].messages == 49 and stats[0].senders == 1 and stats[-1].active == 0
    held = State(spark.createDataFrame([(1, None), (2, 5)], "id long, value long"), 3, fold=2)
    from plexigraph.session import materialize

    for k in range(5):
        held.change(materialize(spark.createDataFrame([(1, k)], "id long, value long"), "t"))
    assert values(held.current()) == {1: 4, 2: 5} and len(held.changes) <= 2


def test_prefix_sums(spark):
    from plexigraph.plans.prefix import numbered, prefix_sums, running

    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(6), rng.randrange(100), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, before long, `a.b` long, __k long").repartition(5)
    got = prefix_sums(df, F.col("g"), F.col("before"), [F.col("`a.b`"), F.col("__k")]).collect()
    want = {}
    for name in "ab":
        total = 0
        for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[2:]):
            want[r[3]] = total
            total += r[1]
    assert {r["__row"]["__k"]: r["__before"] for r in got} == want
    assert sorted((r["n"], r["__k"]) for r in numbered(df, "n", [F.col("__k")]).collect()) == [(k + 1, k) for k in range(500)]
    assert {r["__k"]: r["s"] for r in running(df, "s", F.col("before"), [F.col("__k")]).collect()} == {k: sum(r[1] for r in rows[:k]) for k in range(500)}
    assert prefix_sums(df.limit(0), F.col("g"), F.col("before"), [F.col("__k")]).count() == 0


def test_partition_round_trip(spark, tmp_path):
    rng = random.Random(5)
    g = spark.createDataFrame(sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(80)}), "src long, dst long")
    a = partition.dst_owner(g, 3)
    routes, backups = partition.master_mod(a), partition.backup_masters(a)
    files.write_partition(a, routes, str(tmp_path / "p"), backups)
    got = files.read_partition(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, got["edges"].select("src", "dst", "part").collect())) == sorted(map(tuple, a.collect()))
    assert set(got["edges"].select("weight").distinct().first()) == {1.0}
    want = {(r["id"], r["master_part"]): r["mirrors"] for r in partition.master_routes(routes).collect()}
    assert {(r["id"], r["part"]): r["mirrors"] for r in got["masters"].collect()} == want
    b = values(backups.select("id", "backup_part"))
    assert {tuple(r) for r in got["mirrors"].collect()} == {(r["id"], r["part"], r["master_part"], b[r["id"]]) for r in partition.mirror_routes(routes).collect()}
    assert {tuple(r) for r in got["vertices"].collect()} == {tuple(r) for r in partition.replicas(a).select("id", "part").collect()}
    back = a.select("src", "dst", F.col("part").alias("crashed_part"), ((F.col("part") + 1) % 3).alias("host_part"))
    rows = partition.master_back_rows(routes, backups)
    files.write_backup(back, str(tmp_path / "b"), rows)
    edges, lists = files.read_backup(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, back.collect()))
    assert {(r["id"], r["crashed_part"], r["host_part"], tuple(r["mirrors"])) for r in lists.collect()} == {(r["id"], r["crashed_part"], r["host_part"], tuple(r["mirrors"])) for r in rows.collect()}
    empty = tmp_path / "none"
    empty.mkdir()
    assert all(t.count() == 0 for t in files.read_partition(spark, str(empty)).values())


def test_first_rows_and_weights(spark, tmp_path):
    (tmp_path / "G.0").write_text("0 1 2.5\n1 0\n")
    (tmp_path / "Master.0").write_text("1 2 3 \r\n1 4\n")
    (tmp_path / "Mirror.2").write_text("1 0 3\n1 5\n")
    got = files.read_partition(spark, str(tmp_path))
    assert got["masters"].collect() == [(1, 0, [2, 3])] and got["mirrors"].collect() == [(1, 2, 0, 3)]
    assert sorted(r["weight"] for r in got["edges"].collect()) == [1.0, 2.5]
    assert {r["weight"] for r in files.read_partition(spark, str(tmp_path), weights=False)["edges"].collect()} == {1.0}


def test_result_lines(spark, tmp_path):
    d = spark.createDataFrame([(1, 0), (2, None), (3, 7)], "id long, dist long")
    files.write_lines(files.sssp_lines(d), str(tmp_path / "s"))
    read = lambda p: sorted(r["value"] for r in spark.read.text(str(p)).collect())
    assert read(tmp_path / "s") == ["1\t0", "3\t7"]
    files.write_lines(files.label_lines(spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "id long, label long")), str(tmp_path / "l"))
    assert read(tmp_path / "l") == ["1\t1", "2\t1"]
    files.write_lines(files.rank_lines(spark.createDataFrame([(1, 1.5)], "id long, pr double")), str(tmp_path / "r"))
    assert read(tmp_path / "r") == ["1\t1.500000E+00"]


def test_features_text(spark):
    """Digits are those of C's printf: of the value itself, ties to even."""
    import duckdb
    import __spark_entry__

    rows = [(0, [0.103515625, 0.166015625, -0.103515625, 2.0**-9, 3 * 2.0**-9]), (1, []), (2, None), (3, [1.0, None, -0.0]), (4, [None]), (5, [float("inf"), -float("inf"), float("nan"), 2.0**121, 1e-45, 0.1])]
    rows += [(6 + k, [(k * 64 + j) / 512 - 3 for j in range(64)]) for k in range(50)]
    got = dict(map(tuple, files.features_text(spark.createDataFrame(rows, "id long, x array<double>").repartition(3)).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == dict(con.execute(__spark_entry__.oracle_sql()["features_text"]).fetchall())
    assert got[0].startswith("0.10351562 0.16601562 -0.10351562 0.00195312 0.00585938 ") and got[4] is None and got[3] == "1.00000000 -0.00000000 "


def test_labels_model_and_imports(spark, tmp_path):
    (tmp_path / "l.txt").write_text("4\n5\n6\n")
    (tmp_path / "s.txt").write_text("1\n0\n3\n")
    assert sorted(map(tuple, files.read_labels(spark, str(tmp_path / "l.txt"), str(tmp_path / "s.txt")).collect())) == [(0, 4, 1), (1, 5, 0), (2, 6, 3)]
    (tmp_path / "short.txt").write_text("1\n")
    with pytest.raises(Exception, match="line"):
        files.read_labels(spark, str(tmp_path / "l.txt"), str(tmp_path / "short.txt")).collect()
    w = [gcn.glorot(3, 2, 1), gcn.glorot(2, 4, 2)]
    files.save_model(spark, w, str(tmp_path / "m"))
    assert all((a == b).all() for a, b in zip(files.load_model(spark, str(tmp_path / "m")), w, strict=True))
    (tmp_path / "dne.txt").write_text("6 3\n0 1 0\n1 2 1\n2 0 2\n0 2 1\n")
    (tmp_path / "ids.txt").write_text("0 10\n1 11\n2 12\n")
    rows = files.read_external_partition(spark, str(tmp_path / "dne.txt"), header=True)
    edges, routes = partition.import_external(rows, files.read_idmap(spark, str(tmp_path / "ids.txt")))
    # replicas in order of appearance: 10: 0, 2, 1; 11: 0, 1; 12: 1, 2
    assert sorted(map(tuple, edges.collect())) == sorted([(10, 11, 0), (11, 12, 1), (12, 10, 2), (10, 12, 1), (10, 10, 2), (11, 11, 1), (12, 12, 1)])
    assert {tuple(r) for r in routes.collect()} == {(10, 0, 2), (10, 1, 2), (10, 2, 2), (11, 0, 1), (11, 1, 1), (12, 1, 1), (12, 2, 1)}
    for i, j, text in ((0, 0, "1 2\n3 4\n"), (0, 1, "5 6\n"), (1, 0, "7 8\n")):
        (tmp_path / "h" / str(i)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "h" / str(i) / f"G.{j}").write_text(text)
    files_rows = files.read_hierarchical(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, files_rows.collect())) == [(0, 0, 1, 1, 2), (0, 0, 2, 3, 4), (0, 1, 1, 5, 6), (1, 0, 1, 7, 8)]
    merged, _, m = partition.merged_partition(files_rows, 2)
    assert sorted((r["src"], r["part"]) for r in merged.collect()) == [(1, 0), (3, 0), (5, 1), (7, 2)] and m.first()["replication"] == 1.0
    with pytest.raises(Exception, match="no part"):
        partition.by_vertex_part(frame(spark, [(0, 1)]), spark.createDataFrame([(1, 0)], "id long, part int")).collect()


def test_sets(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2, 2], [2, 3]))
    assert sorted(r["id"] for r in sets.union(a, b).collect()) == [1, 2, 3]
    assert sets.has_intersection(a, b) and not sets.has_intersection(a, b.where("id > 2"))
    local = transforms.local_ids(spark.createDataFrame([(7, 0), (5, 0), (7, 1)], "id long, part int"))
    assert sorted(map(tuple, local.collect())) == [(5, 0, 0), (7, 0, 1), (7, 1, 0)]


def simulated_ranks(edges, k, fault, backup):
    """k ranks in rounds, each as its own list of replies: who asks, who answers, who counts."""
    n = len({x for e in edges for x in e})
    every = sorted(edges)
    own = []
    for r in range(k):
        mine = every[r::k]
        deg = {}
        for e in mine:
            for x in e:
                deg[x] = deg.get(x, 0) + 1
        own.append(sorted(mine, key=lambda e: (deg[e[0]] + deg[e[1]], e)))
    has, got, rep = [set() for _ in range(k)], [[] for _ in range(k)], {}
    at, size = 0, 10
    while at < len(every) // k + 1:
        edge_count, vertex_count, replies = [len(x) for x in got], [len(x) for x in has], [set(x) for x in has]
        seen = dict(rep)
        for r in range(k):
            for e in own[r][at : at + size]:
                score = []
                for j in range(k):
                    lack = [x for x in e if x not in replies[j]]
                    s = sum(-1 + (fault if seen.get(x, 0) == 1 else 0) for x in lack) - edge_count[j] / len(own[r]) - vertex_count[j] / n * k
                    score.append(s + (0.1 if j == r else 0))
                got[score.index(max(score))].append(e)
        for j in range(k):
            for e in got[j][edge_count[j] :]:
                for x in e:
                    if x not in has[j]:
                        has[j].add(x)
                        rep[x] = rep.get(x, 0) + 1
        at += size
        size = min(int(size * 1.3), 1000)
    if not backup:
        return sorted((u, v, j, None) for j in range(k) for u, v in got[j])
    out, at = [], 0
    loads, sizes = [[len(x) for x in got] for _ in range(k)], [[len(x) for x in has] for _ in range(k)]
    while at < max(map(len, got)):
        replies, sent = [set(x) for x in has], []
        for r in range(k):
            for e in got[r][at : at + size]:
                score = {j: -sum(x not in replies[j] for x in e) - loads[r][j] / len(own[r]) - sizes[r][j] / n * k for j in range(k) if j != r}
                best = min(j for j in score if score[j] == max(score.values()))
                loads[r][best] += 1
                sizes[r][best] += sum(x not in replies[best] for x in e)
                sent.append((best, e))
                out.append((*e, r, best))
        for j, e in sent:
            has[j] |= set(e)
        at += size
        size = min(int(size * 1.3), 1000)
    return sorted(out)


@pytest.mark.parametrize("backup", [False, True])
def test_ranks(spark, backup):
    rng = random.Random(11)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(700)})
    fault = 0.5 if backup else 0.0
    got = partition.bulk_sync(spark.createDataFrame(edges, "src long, dst long"), 4, fault_weight=fault, backup=backup)
    assert sorted(tuple(r) for r in got.collect()) == simulated_ranks(edges, 4, fault, backup)


def test_dropout(spark):
    x = spark.createDataFrame([(i, [1.0 + i, -2.0, 0.0, 3.0]) for i in range(500)], "id long, x array<double>")
    grad = spark.createDataFrame([(i, [1.0] * 4) for i in range(500)], "id long, x array<double>")
    kept, back = values(gcn.dropout(x, 0.2)), values(gcn.dropout_grad(grad, 0.2))
    assert np.mean([v != 0 for row in back.values() for v in row]) == pytest.approx(0.8, abs=0.03)
    for i in range(500):
        assert kept[i] == pytest.approx([(a / 0.8 if b else 0.0) for a, b in zip([1.0 + i, -2.0, 0.0, 3.0], back[i])])
        assert set(back[i]) <= {0.0, 1.25}
    assert gcn.dropout(x) is x


def test_golden_product(spark):
    """Rows start at 0, 3, 4, 7 and end at 9."""
    a = [(r, c, float(v)) for r, c, v in zip([0, 0, 0, 1, 2, 2, 2, 3, 3], [0, 2, 3, 1, 0, 2, 3, 1, 3], range(1, 10))]
    b = [(i, j, float(4 * j + i + 1)) for j in range(3) for i in range(4)]
    got = {(r["i"], r["j"]): r["x"] for r in gcn.sparse_matmul(*(spark.createDataFrame(m, "i long, j long, x double") for m in (a, b))).collect()}
    assert [got[i, j] for j in range(3) for i in range(4)] == [19, 8, 51, 52, 43, 24, 123, 120, 67, 40, 195, 188]
    dense = np.zeros((4, 4))
    for i, j, v in a:
        dense[i, j] = v
    grad = np.arange(12.0).reshape(4, 3)
    back = gcn.sparse_matmul_grad(spark.createDataFrame(a, "i long, j long, x double"), spark.createDataFrame([(i, j, float(grad[i, j])) for i in range(4) for j in range(3)], "i long, j long, x double"))
    want = dense.T @ grad
    assert {(r["i"], r["j"]): r["x"] for r in back.collect()} == {(i, j): want[i, j] for i in range(4) for j in range(3)}


def test_training_control(spark):
    """Cached sums without an error bound train as plain ones; schedule, average and bound follow their rules."""
    rng = np.random.default_rng(2)
    g = frame(spark, sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))} | {(i, i) for i in range(12)}))
    x = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(12)], "id long, x array<double>")
    labels = spark.createDataFrame([(i, i % 2, 1 + i % 2) for i in range(12)], "id long, label int, split int")
    coef = gcn.coefficients(g)
    parts = coef.withColumn("part", F.pmod("src", F.lit(3)).cast("int"))
    w = [gcn.glorot(3, 2, 1), gcn.glorot(2, 2, 2)]
    log: list[gcn.Epoch] = []
    rounds: list = []
    plain = gcn.train(coef, x, labels, list(w), 3, log=log)[1]
    cached = gcn.train(parts, x, labels, list(w), 3, validate=None, cached=True, rounds=rounds)[1]
    assert len(rounds) == 12 and [r[3] for r in rounds[:4]] == [r[4] for r in rounds[:4]]  # the first step is full
    assert any(r[4] < r[3] for r in rounds)
    assert cached[0] == pytest.approx(plain[0]) and all(e.val_loss is not None for e in log)
    assert log[1].mean_accuracy == pytest.approx(0.95 * 0.05 * log[0].accuracy + 0.05 * log[1].accuracy)
    s = gcn.SyncSchedule()
    full = []
    for _ in range(12):
        full.append((s.forward_full(), s.backward_full()))
        s.advance()
    assert [k for k, f in enumerate(full) if f[0]] == [0, 5] and [k for k, f in enumerate(full) if f[1]] == [0, 10]
    p = gcn.Progress()
    for a in (0.9, 0.9, 0.01):
        p.update(a)
    assert p.error == pytest.approx(0.09)
    rates = gcn.delay_rates(spark.createDataFrame([(e, 0, "forward", 10, 10 if e == 1 else 5) for e in range(1, 11)], "epoch int, layer int, direction string, rows long, sent long")).collect()
    assert [tuple(r) for r in rates] == [(0, 0, "forward", pytest.approx(55 / 90))]


def test_hierarchical(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(150)})
    assigned = spark.createDataFrame([(u, v, (u + v) % 3) for u, v in edges], "src long, dst long, part int")
    got = {(r["src"], r["dst"]): r["part"] for r in partition.ebv_hierarchical(assigned, 2).collect()}
    for o in range(3):
        mine = spark.createDataFrame([e for e in edges if sum(e) % 3 == o], "src long, dst long")
        for r in partition.ebv(mine, 2).collect():
            assert got[r["src"], r["dst"]] == o * 2 + r["part"]


def test_streams(spark, tmp_path):
    from plexigraph.streaming import stream_degrees, stream_loads

    for k, rows in enumerate(([(0, 1), (1, 2)], [(2, 0), (2, 3), (4, 3)])):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    edges = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for name, stream, want in (("degrees", stream_degrees(edges), {0: 2, 1: 2, 2: 3, 3: 2, 4: 1}), ("loads", stream_loads(edges, 2), {0: 2, 1: 3})):
        query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert values(spark.table(name)) == want
