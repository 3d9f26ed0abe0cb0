"""Mixing sources to target weights (7).

Every row gets a hash-random key; rows are range-sorted by (source, key), prefix sums of their sizes
are taken in parallel, and each source is cut at its exact budget.  A budget above the source's size
takes whole epochs first and cuts the last one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.llm.common import packed, slices, split_words, text_bytes, unpacked, with_lengths
from plexigraph.plans.prefix import numbered, prefix_sums
from plexigraph.session import materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


@arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    parts = [np.zeros(0, np.int64)]
    for s, e in slices(text, 4 << 20):
        parts.append(split_words(text.slice(s, e - s))[0])
    return pa.array(np.concatenate(parts))


def _group(source: Column) -> Column:
    """A key that is never null and sorts as the source by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes``: (g, source_size), a row a source.  Adds ``target``.

    The sources share ``share`` times all sizes by weight; a target stops at ``most`` times its source's size
    and what is over is shared again among the others, until no target is above its stop.  Each round is
    one aggregate over the sources; none of them come to the driver.
    """
    ranked = numbered(sizes, "rank", [F.col("g")], 0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("g", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("stop")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:
        # stopped: those whose share at the present rate is over the stop; the rate never falls, so the set only grows
        stopped = F.col("w") * F.lit(rate) > F.col("stop")
        fixed, free = ranked.agg(F.sum(F.when(stopped, F.col("stop")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("w")))).first()
        if not free:
            break
        new = (share * total - fixed) / free
        if new <= rate:
            break
        rate = new
    return ranked.select("g", "source_size", F.least(F.col("w") * F.lit(rate), F.col("stop")).alias("target"))


def _placed(rows: DataFrame, share: float, most: float, weights: tuple[float, ...], seed: int) -> DataFrame:
    """``rows``: a table with doc_id, source, size.  (__row, g, source_size, target, taken)."""
    g = _group(F.col("source"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    placed = prefix_sums(rows, g, F.col("size"), [key, F.col("doc_id"), F.col("size")], "mix").withColumn("__g", _group(F.col("__row.source")))
    goal = targets(rows.groupBy(g.alias("g")).agg(F.sum("size").alias("source_size")), share, most, weights)
    out = placed.join(goal, F.col("__g") == F.col("g"))  # a row a source: Spark broadcasts it if it is small
    size = F.col("__row.size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(size, rest - F.col("__before"))).cast("long")
    return out.select("__row", "source_size", "target", (epochs * size + part).cast("long").alias("taken"))


def mix(rows: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """``rows``: doc_id, source, size (not null) and others of any name but these three: adds source_size, target, taken (words the mix takes).

    Taken words of a source add up to its target rounded down.  Reruns agree: keys are hashes of doc_id and
    size, and ties among repeated rows fall among rows equal in doc_id and size.  ``rows`` is read several
    times, so it should be a table.

    Defined cases: a null source is a source of its own, last by rank; a size of 0 takes 0; a null doc_id is a
    value like any other; an empty table gives no rows.
    """
    out = _placed(rows, share, most, weights, seed)
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in rows.columns], "source_size", "target", "taken")


@arrow_udf(T.StringType())
def first_words(text: pa.Array, n: pa.Array) -> pa.Array:
    """The text up to its n-th word."""
    out = []
    for b, k in zip(text_bytes(text), n.to_pylist(), strict=True):
        rest = b.split(None, k)
        cut = len(b) - len(rest[k]) if len(rest) > k else len(b)
        out.append(b[:cut].decode().rstrip(" \t\n\x0b\x0c\r"))
    return pa.array(out, pa.string())


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken twice is two rows, one taken in part is cut.

    Only the document at each source's budget is cut, so that budgets are exact.  Texts are joined to their
    counts by one shuffle on a hash of doc_id, text and source.

    Defined cases: documents without words (null, empty, white space) are not taken; a null doc_id or source is a
    value like any other; of repeated rows, which are equal in doc_id, text and source, each takes its own part,
    and which of them takes which is open; an empty table gives no rows; a text of any length is one row.
    """
    name = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull(), "source", F.col("source").isNull())
    counted = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), name.alias("h"), F.xxhash64("text").alias("th")), "sizes")
    takes = _placed(counted, share, most, weights, 7).where("taken > 0").select("__row.doc_id", "__row.h", "__row.th", "__row.size", "taken")
    once = takes.groupBy("doc_id", "h", "th").agg(F.array_sort(F.collect_list(F.struct("taken", "size"))).alias("__takes"))  # one for each repeat of a row
    once = once.select(F.col("h").alias("__h"), F.col("th").alias("__th"), F.col("doc_id").alias("__id"), "__takes")
    alone = once.where(F.size("__takes") == 1)
    rows = docs.select(packed(docs), name.alias("__name"))
    same = (F.col("__name") == F.col("__h")) & (F.xxhash64("__row.text") == F.col("__th")) & F.col("__row.doc_id").eqNullSafe(F.col("__id"))
    hit = rows.join(alone, same).select("__row", F.element_at("__takes", 1).alias("__t"))
    # rows that occur several times are numbered to take one part each; all others need no sort
    again = rows.join(once.where(F.size("__takes") > 1), same)
    again = again.withColumn("__nth", F.row_number().over(Window.partitionBy("__h", "__th", "__id").orderBy(F.lit(0)))).where(F.col("__nth") <= F.size("__takes"))
    hit = hit.unionAll(again.select("__row", F.element_at("__takes", F.col("__nth")).alias("__t")))
    times = F.sequence(F.lit(0), F.ceil(F.col("__t.taken") / F.col("__t.size")).cast("int") - 1)
    copies = hit.select("__row", "__t", F.explode(times).alias("__e")).select(
        "__row", F.least(F.col("__t.size"), F.col("__t.taken") - F.col("__e") * F.col("__t.size")).alias("__n"), F.col("__t.size").alias("__size")
    )
    whole = unpacked(copies.where("__n = __size"), docs.columns)
    part = copies.where("__n < __size").select("__row", first_words("__row.text", "__n").alias("__cut"))
    return whole.union(unpacked(part, docs.columns, **with_lengths(docs.columns, F.col("__cut"))))
