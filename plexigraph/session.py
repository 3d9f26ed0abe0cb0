"""Session helpers: a default session, and tables that cut lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark removes the shuffle files of a query when it ends, without waiting for the driver's garbage collector.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "plexigraph", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution on; for tests, benches and notebooks (a cluster brings its own)."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PLEXIGRAPH_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent (tests, a laptop) a temporary folder is made and
    registered as the checkpoint folder; it goes when the process ends.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if held:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(held)
        return held
    own = getattr(context, "_plexigraph_dir", None)
    if own is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            own = current.get()
        elif not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            own = tempfile.mkdtemp(prefix="plexigraph-")
            context.setCheckpointDir(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context._plexigraph_dir = own
    return own


def materialize(df: DataFrame, what: str = "table", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.  ``by``: columns with a folder a value.

    A lost executor costs the re-run of a task, never of what came before the table.  The shuffle files
    of the write itself are removed when it ends, since nothing refers to them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by or []).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plexigraph_path = path
    _tables(spark).add(path)
    return out


def bucketed(df: DataFrame, n: int, keys: list[str], what: str = "table") -> DataFrame:
    """As :func:`materialize`, in ``n`` buckets by ``keys``, each one sorted file: joins on the keys neither shuffle nor reorder it."""
    spark = df.sparkSession
    name = f"plexigraph_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._plexigraph_path, out._plexigraph_name = path, name
    _tables(spark).add(path)
    return out


def _tables(spark: SparkSession) -> set[str]:
    """The tables of this application that are still there; what is left at its end goes then."""
    context = spark.sparkContext
    held = getattr(context, "_plexigraph_tables", None)
    if held is None:
        held = context._plexigraph_tables = set()
        atexit.register(_leave, spark)
    return held


def _leave(spark: SparkSession) -> None:
    try:
        discard_all(spark)
    except Exception:  # the session was stopped before
        pass


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _tables(spark).discard(path)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` has made and nobody has discarded: results that read them must have been consumed."""
    for path in list(_tables(spark)):
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` which nothing will read again."""
    path = getattr(df, "_plexigraph_path", None)
    if path is None:
        raise ValueError("not a table that materialize returned")
    if hasattr(df, "_plexigraph_name"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._plexigraph_name}")
    _delete(df.sparkSession, path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
