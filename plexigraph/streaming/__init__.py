"""An extension: edges that arrive as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_degrees(edges: DataFrame) -> DataFrame:
    """Running total degrees (id, degree) of a stream of edges; use output mode update or complete."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def stream_loads(edges: DataFrame, k: int = 4) -> DataFrame:
    """Running edges a part of a stream cut by destination owner."""
    return edges.groupBy(F.pmod("dst", F.lit(k)).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("edges"))
