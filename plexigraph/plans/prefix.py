"""Prefix sums and row numbers over tables of any size, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexigraph.session import materialize, shuffle_width


def prefix_sums(df: DataFrame, group: Column, value: Column, order: list[Column], what: str = "prefix") -> DataFrame:
    """(__row, __before): every row as a struct, and the sum of ``value`` over the rows of its ``group`` that come earlier by ``order``.

    Range partitions in (group, order); a running sum inside each partition (streamed, nothing is gathered);
    the few sums by (group, partition) are summed again and joined back.  A group of any size is spread over
    as many partitions as it fills.  ``group`` and ``value`` must not be null; columns may have any name.
    """
    keys = [group.alias("__g"), *(c.alias(f"__o{i}") for i, c in enumerate(order))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), value.cast("long").alias("__v"), *keys)
    names = [f"__o{i}" for i in range(len(order))]
    held = rows.schema.fields[:3]
    schema = T.StructType([*held, T.StructField("__pid", T.IntegerType()), T.StructField("__run", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).to_numpy(zero_copy_only=False)
            g = b.column(2).dictionary_encode()
            kind = g.indices.to_numpy()
            new = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1])
            upto = np.cumsum(v) - v
            out = upto - np.repeat(upto[new], np.diff(np.append(new, len(v))))
            if last is not None and g[0].as_py() == last:
                out[: new[1] if len(new) > 1 else len(v)] += carry
            last, carry = g[-1].as_py(), int(out[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(v), pid, np.int32)), pa.array(out)], names=[f.name for f in schema.fields])

    n = shuffle_width(df.sparkSession)
    local = materialize(rows.repartitionByRange(n, "__g", *names).sortWithinPartitions("__g", *names).mapInArrow(run, schema), what)
    sums = local.groupBy("__g", "__pid").agg(F.sum("__v").alias("s"))
    earlier = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a group
    offsets = sums.select(F.col("__g").alias("g"), F.col("__pid").alias("p"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("off"))
    out = local.join(offsets, (F.col("__g") == F.col("g")) & (F.col("__pid") == F.col("p")))
    return out.select("__row", (F.col("__run") + F.col("off")).cast("long").alias("__before"))


def running(df: DataFrame, name: str, value: Column, order: list[Column]) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all earlier rows."""
    out = prefix_sums(df, F.lit(0), value, order, name)
    return out.select("__row.*", F.col("__before").alias(name))


def numbered(df: DataFrame, name: str, order: list[Column], start: int = 1) -> DataFrame:
    """``df`` with ``name``: the row's number by ``order``, from ``start`` on."""
    out = prefix_sums(df, F.lit(0), F.lit(1), order, name)
    return out.select("__row.*", (F.col("__before") + start).alias(name))
