"""Graphs built from the driver's tables; (src, dst) or (src, dst, weight), all BIGINT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexigraph.plans.prefix import prefix_sums
from plexigraph.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive customers of the orders of a month; duplicates and loops stay."""
    orders = _table(spark, sf_dir, "orders")
    month = Window.partitionBy(F.date_trunc("month", "o_orderdate")).orderBy("o_orderkey")
    rows = orders.select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(month).alias("dst"), (1 + F.col("o_orderkey") % 7).alias("weight"))
    return rows.where("dst is not null").select(*[F.col(c).cast("long") for c in ("src", "dst", "weight")])


def g_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`g_multi` without loops, one edge a pair with its least weight."""
    return g_multi(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def g_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to nations and suppliers to nations: one component a region."""
    nation = _table(spark, sf_dir, "nation").select((F.lit(1000) + F.col("n_regionkey")).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    supplier = _table(spark, sf_dir, "supplier").select((F.lit(10000) + F.col("s_suppkey")).cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return nation.union(supplier)


def g_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of successive events of one type.

    A type may hold a large part of all events, so its events are numbered by prefix sums and joined with the next number.
    """
    events = _table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.col("user_id").cast("long").alias("user_id"))
    kind = F.coalesce(F.concat(F.lit("0"), F.col("event_type")), F.lit("1"))
    placed = prefix_sums(events, kind, F.lit(1), [F.col("ts"), F.col("event_id")], "events")
    rows = materialize(placed.select(F.coalesce(F.concat(F.lit("0"), F.col("__row.event_type")), F.lit("1")).alias("kind"), F.col("__row.user_id").alias("src"), F.col("__before").alias("k")), "events")
    then = rows.select(F.col("kind").alias("kind2"), F.col("src").alias("dst"), (F.col("k") - 1).alias("k2"))
    pairs = rows.join(then, (F.col("kind") == F.col("kind2")) & (F.col("k") == F.col("k2")))
    return pairs.where("dst is not null and dst <> src").select("src", "dst").distinct()


def g_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector points to (7 i + 1) mod n, (13 i + 5) mod n and itself."""
    ids = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("src"))
    n = F.lit(ids.count())
    to = F.explode(F.array((7 * F.col("src") + 1) % n, (13 * F.col("src") + 5) % n, F.col("src")))
    return ids.select("src", to.alias("dst")).distinct()
