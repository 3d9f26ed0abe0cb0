"""Text files of the graph tools: edge lists, partitions with their routes, degree vectors, features, patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.plans.prefix import numbered, prefix_sums


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each line's tokens; carriage returns and empty tokens are dropped."""
    line = F.regexp_replace("value", "\r", "")
    return spark.read.text(path).select(F.filter(F.split(line, r"\s+"), lambda x: x != "").alias("t"), F.col("_metadata.file_path").alias("file")).where("size(t) > 0")


def read_edges(spark: SparkSession, path: str, drop_self_loops: bool = False, sep: str | None = None) -> DataFrame:
    """``u v [weight]`` a line (or by ``sep``); a missing weight is 1.0.  Loops may be dropped at the scan."""
    rows = _tokens(spark, path) if sep is None else spark.read.text(path).select(F.split("value", sep).alias("t"))
    weight = F.coalesce(F.try_element_at("t", F.lit(3)).cast("double"), F.lit(1.0))
    edges = rows.select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), weight.alias("weight"))
    return edges.where("src <> dst") if drop_self_loops else edges


def _part(file: str = "file") -> Column:
    """The number at the end of a file's name (``G.3``)."""
    return F.regexp_extract(file, r"\.(\d+)$", 1).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _lines(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(t, part, at): tokens of ``kind.i`` or of ``kind/part=i``, and a number that grows along a file's lines.  No rows where neither is there."""
    line = F.filter(F.split(F.regexp_replace("value", "\r", ""), r"\s+"), lambda x: x != "")
    if _exists(spark, f"{folder}/{kind}"):
        rows = spark.read.schema("value string, part int").text(f"{folder}/{kind}").select(line.alias("t"), F.col("part"), F.monotonically_increasing_id().alias("at"))
    else:
        try:
            rows = spark.read.text(f"{folder}/{kind}.*")
        except AnalysisException:
            return spark.createDataFrame([], "t array<string>, part int, at long")
        rows = rows.select(line.alias("t"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).select("t", _part().alias("part"), "at")
    return rows.where("size(t) > 0")


def _first_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows that share (id, part), the first line's."""
    first = F.min_by(F.struct(*columns), "at").alias("x")
    return rows.groupBy("id", "part").agg(first).select("id", "part", *[F.col(f"x.{c}").alias(c) for c in columns])


def read_partition(spark: SparkSession, folder: str, weights: bool = True) -> dict[str, DataFrame]:
    """``G``, ``Master`` and ``Mirror`` by part: edges, masters (id, part, mirrors), mirrors (id, part, master_part, backup_part), vertices.

    Files may be ``G.i`` or as :func:`write_partition` leaves them.  A missing weight is 1.0, and all are without ``weights``.
    Of several rows for a vertex in one part's Master or Mirror the first counts.
    """
    g = _lines(spark, folder, "G")
    weight = F.coalesce(F.try_element_at("t", F.lit(3)).cast("double"), F.lit(1.0)) if weights else F.lit(1.0)
    edges = g.select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), weight.alias("weight"), "part")
    m = _lines(spark, folder, "Master")
    masters = _first_rows(m.select(F.col("t")[0].cast("long").alias("id"), "part", F.slice("t", 2, 1 << 20).cast("array<int>").alias("mirrors"), "at"), ["mirrors"])
    r = _lines(spark, folder, "Mirror")
    r = r.select(F.col("t")[0].cast("long").alias("id"), "part", F.col("t")[1].cast("int").alias("master_part"), F.try_element_at("t", F.lit(3)).cast("int").alias("backup_part"), "at")
    mirrors = _first_rows(r, ["master_part", "backup_part"])
    vertices = edges.select(F.col("src").alias("id"), "part").union(edges.select("dst", "part")).union(masters.select("id", "part")).union(mirrors.select("id", "part")).distinct()
    return {"edges": edges, "masters": masters, "mirrors": mirrors, "vertices": vertices}


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.partitionBy(*by).mode("overwrite").text(path)


def write_partition(edges: DataFrame, routes: DataFrame, folder: str, backups: DataFrame | None = None) -> None:
    """One folder a part: ``G/part=i`` (``u v``), ``Master/part=i`` (``v w1 w2``), ``Mirror/part=i`` (``v master [backup]``).

    ``routes``: id, part, master_part.  ``backups``: id, backup_part.
    """
    _write(edges.select(F.concat_ws(" ", "src", "dst").alias("value"), "part"), f"{folder}/G", "part")
    mirrors = routes.where("part <> master_part")
    named = mirrors if backups is None else mirrors.join(backups.select("id", "backup_part"), "id", "left")
    _write(named.select(F.concat_ws(" ", "id", "master_part", *([] if backups is None else ["backup_part"])).alias("value"), "part"), f"{folder}/Mirror", "part")
    lists = mirrors.groupBy("id", F.col("master_part").alias("part")).agg(F.sort_array(F.collect_set("part")).alias("w"))
    _write(lists.select(F.concat_ws(" ", "id", F.array_join(F.col("w").cast("array<string>"), " ")).alias("value"), "part"), f"{folder}/Master", "part")


def write_backup(edges: DataFrame, folder: str, master_back: DataFrame | None = None) -> None:
    """What hosts keep for parts that may crash: ``G_back`` (``u v``) and ``Master_back`` (``v w1 w2``), a folder for each pair.

    ``edges``: src, dst, crashed_part, host_part.  ``master_back``: id, crashed_part, host_part, mirrors.
    """
    pair = ("crashed_part", "host_part")
    _write(edges.select(F.concat_ws(" ", "src", "dst").alias("value"), *pair), f"{folder}/G_back", *pair)
    if master_back is not None:
        _write(master_back.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.col("mirrors").cast("array<string>"), " ")).alias("value"), *pair), f"{folder}/Master_back", *pair)


def read_backup(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_backup` left: edges (src, dst, crashed_part, host_part) and rows (id, crashed_part, host_part, mirrors)."""

    def lines(kind: str) -> DataFrame:
        if not _exists(spark, f"{folder}/{kind}"):
            return spark.createDataFrame([], "t array<string>, crashed_part int, host_part int")
        rows = spark.read.schema("value string, crashed_part int, host_part int").text(f"{folder}/{kind}")
        return rows.select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"), "crashed_part", "host_part").where("size(t) > 0")

    pair = ("crashed_part", "host_part")
    edges = lines("G_back").select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), *pair)
    return edges, lines("Master_back").select(F.col("t")[0].cast("long").alias("id"), *pair, F.slice("t", 2, 1 << 20).cast("array<int>").alias("mirrors"))


def read_hierarchical(spark: SparkSession, folder: str) -> DataFrame:
    """``folder/i/G.j``: (outer, inner_part, idx, src, dst), idx the line's number within its file, from 1 on."""
    rows = spark.read.text(f"{folder}/*/G.*").select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = rows.where("size(t) > 1").select(F.regexp_extract("file", r"(\d+)/G\.\d+$", 1).cast("int").alias("outer"), _part().alias("inner_part"), F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), "at")
    rows = rows.where("outer is not null")
    placed = prefix_sums(rows, F.col("outer") * (1 << 20) + F.col("inner_part"), F.lit(1), [F.col("at")], "lines")
    return placed.select("__row.outer", "__row.inner_part", (F.col("__before") + 1).alias("idx"), "__row.src", "__row.dst")


def read_positional(spark: SparkSession, path: str, kind: str = "long", name: str = "value") -> DataFrame:
    """One value a line, the line's number is the id: degree vectors, labels, splits, vertex partitions.

    Lines are numbered by (file, place in it), files by name, with prefix sums: no task sees them all.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.trim("value").alias("line"))
    placed = numbered(rows, "id", [F.col("f"), F.col("b"), F.col("m")], 0)
    return placed.select("id", F.col("line").cast(kind).alias(name))


def read_labels(spark: SparkSession, labels: str, splits: str) -> DataFrame:
    """(id, label, split) of two files with a number a line; raises if they differ in length."""
    a, b = read_positional(spark, labels, "int", "label"), read_positional(spark, splits, "int", "split")
    uneven = F.raise_error(F.concat(F.lit("label or split missing at line "), F.col("id").cast("string")))
    rows = a.withColumn("has_label", F.lit(True)).join(b.withColumn("has_split", F.lit(True)), "id", "full")
    return rows.select("id", F.when(F.col("has_label").isNull() | F.col("has_split").isNull(), uneven).otherwise(F.col("label")).cast("int").alias("label"), "split")


def save_model(spark: SparkSession, weights: list[np.ndarray], path: str) -> None:
    """(layer, i, j, w) as Parquet."""
    rows = [(k, i, j, float(w[i, j])) for k, w in enumerate(weights) for i in range(w.shape[0]) for j in range(w.shape[1])]
    spark.createDataFrame(rows, "layer int, i int, j int, w double").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> list[np.ndarray]:
    """The weights that :func:`save_model` wrote, which are a model's few matrices."""
    rows = spark.read.parquet(path).collect()
    out = []
    for k in range(max((r["layer"] for r in rows), default=-1) + 1):
        own = [r for r in rows if r["layer"] == k]
        w = np.zeros((max(r["i"] for r in own) + 1, max(r["j"] for r in own) + 1))
        for r in own:
            w[r["i"], r["j"]] = r["w"]
        out.append(w)
    return out


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``x1,x2,...`` a line: (id, x ARRAY<DOUBLE>); all rows must be as wide as the first."""
    rows = read_positional(spark, path, "string", "line").select("id", F.split("line", ",").cast("array<double>").alias("x"))
    widths = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"rows of {widths[0]} to {widths[1]} values")
    return rows


@arrow_udf(T.StringType())
def _fixed(x: pa.Array) -> pa.Array:
    """Java's ``%.8f`` rounds the shortest decimal form, ties away from zero; C's, as here, rounds the value itself, ties to even."""
    lines: list[str | None] = []
    for s in range(0, len(x), 256):
        for row in x.slice(s, 256).to_pylist():
            own = [v for v in row or [] if v is not None]
            lines.append("%.8f " * len(own) % tuple(own) if own or row == [] else None)
    return pa.array(lines, pa.string())


def features_text(features: DataFrame) -> DataFrame:
    """Each value as C's ``%.8f`` and a blank; nulls are left out, and a row of nothing else (or null) has a null line."""
    return features.select("id", _fixed("x").alias("line"))


def read_pattern(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``id attr n t1 .. tn`` a line: nodes (id, attr) and edges (src, dst)."""
    t = _tokens(spark, path)
    nodes = t.select(F.col("t")[0].cast("long").alias("id"), F.col("t")[1].cast("int").alias("attr"))
    edges = t.select(F.col("t")[0].cast("long").alias("src"), F.explode(F.slice("t", F.lit(4), F.greatest(F.col("t")[2].cast("int"), F.lit(0))).cast("array<bigint>")).alias("dst"))
    return nodes, edges


def read_external_partition(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``u v part`` a line: (idx, src, dst, part), idx by the file's order; with ``header`` the first line (two tokens) is dropped."""
    line = F.filter(F.split(F.regexp_replace("value", "\r", ""), r"\s+"), lambda x: x != "")
    t = spark.read.text(path).select(line.alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    t = t.where("size(t) >= 3" if header else "size(t) > 0")
    rows = numbered(t, "idx", [F.col("f"), F.col("b"), F.col("m")])
    return rows.select("idx", F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), F.col("t")[2].cast("int").alias("part"))


def read_idmap(spark: SparkSession, path: str) -> DataFrame:
    """``a b`` a line: (a, b)."""
    return _tokens(spark, path).select(F.col("t")[0].cast("long").alias("a"), F.col("t")[1].cast("long").alias("b"))


def sssp_lines(distances: DataFrame) -> DataFrame:
    """``id\\tdist`` of reached vertices."""
    return distances.where("dist is not null").select(F.concat_ws("\t", "id", "dist").alias("value"))


def label_lines(labels: DataFrame) -> DataFrame:
    """``id\\tlabel``, one row an id."""
    return labels.distinct().select(F.concat_ws("\t", "id", "label").alias("value"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    """``id\\tpr`` with the rank as ``%E``."""
    return ranks.select(F.concat_ws("\t", F.col("id").cast("string"), F.format_string("%E", "pr")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Result lines (value) as text files."""
    lines.write.mode("overwrite").text(path)
