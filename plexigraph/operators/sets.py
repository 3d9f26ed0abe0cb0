"""Sets of vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id) in either set, once."""
    return a.select("id").union(b.select("id")).distinct()


def has_intersection(a: DataFrame, b: DataFrame) -> bool:
    """Whether some id is in both; stops at the first."""
    return not a.select("id").join(b.select("id"), "id", "left_semi").isEmpty()


def part_overlaps(members: DataFrame) -> DataFrame:
    """``members``: (id, part).  (a, b, shared): for each pair of parts a < b that have ids in common, how many.

    Each id brings its sorted list of parts, so the pairs are of parts that meet at one id, never of ids.
    """
    lists = members.select("id", "part").distinct().groupBy("id").agg(F.sort_array(F.collect_list("part")).alias("p")).where(F.size("p") > 1)
    pairs = lists.select(F.explode(F.transform("p", lambda x, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b"))))).alias("q"))
    return pairs.select(F.explode("q").alias("q")).groupBy("q.a", "q.b").agg(F.count(F.lit(1)).alias("shared"))


def back_nodes(masters: DataFrame, backups: DataFrame) -> DataFrame:
    """(id, part): where a vertex is master or backup master.  ``masters``: id, master_part; ``backups``: id, backup_part."""
    held = masters.select("id", F.col("master_part").alias("part"))
    return held.union(backups.select("id", F.col("backup_part").alias("part"))).where("part is not null").distinct()


def with_backup(edges: DataFrame, backup: DataFrame) -> DataFrame:
    """(src, dst, part): a part's own edges and those that it holds for others; duplicates stay.  ``backup``: src, dst, host_part."""
    return edges.select("src", "dst", "part").unionAll(backup.select("src", "dst", F.col("host_part").alias("part")))
