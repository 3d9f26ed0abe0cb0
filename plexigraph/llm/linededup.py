"""Line dedup (10), native: levelled sorted runs of line hashes.

Every line has a key: the line without ASCII white space at both ends, A-Z lower-cased, held as two 64-bit
hashes.  A store takes batches of documents in falling order of doc_id and holds runs: tables in buckets by key,
each bucket one sorted file, so that merging runs and joining them never shuffles them.  A new batch is
aggregated (partial sums first, so a line in a third of all documents is one row a task) and merge-anti-joined
against the runs.  Keys that no run has are fresh: the batch adds them with the document that keeps the line, the
largest of all, since later batches hold smaller ones.  Known keys only add to the count.  When a level holds
``fanout`` runs, they are merged into one run of the next level.  Only DataFrame operations run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexigraph.llm.common import WHITE, ascii_lower, packed, with_lengths
from plexigraph.session import bucketed, discard, materialize, shuffle_width


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(lines: Column, least: int) -> Column:
    """For each line its key's two hashes, or null if the key is short."""

    def one(x: Column) -> Column:
        k = line_key(x)
        return F.when(F.char_length(k) >= least, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))

    return F.transform(lines, one)


class LineRuns:
    """The levelled store: runs of (a, b, n, last, fresh) in ``n_buckets`` sorted files, written once."""

    def __init__(self, spark: SparkSession, n_buckets: int, fanout: int = 4) -> None:
        self.spark, self.n_buckets, self.fanout, self.levels = spark, n_buckets, fanout, [[]]

    @property
    def runs(self) -> list[DataFrame]:
        """All runs, the earliest first."""
        return [r for level in self.levels[::-1] for r in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several, in the order in which they came; a known key's fresh row may be in a run outside of these.

        Each run's rows are merge-joined with those of all later runs, which add to their counts; what no earlier run
        has stays as it is.  (An aggregate over the union of bucketed tables would do, but Spark 4.1 takes such a
        union for partitioned by the key, which it is not, and gives a key twice.)
        """
        parts = []
        for i, run in enumerate(runs):
            own = reduce(lambda left, earlier: left.join(earlier.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), runs[:i], run)
            for j, later in enumerate(runs[i + 1 :]):
                own = own.join(later.select("a", "b", F.col("n").alias(f"n{j}")).hint("merge"), ["a", "b"], "left")
            more = [F.coalesce(F.col(f"n{j}"), F.lit(0)) for j in range(len(runs) - i - 1)]
            parts.append(own.select("a", "b", reduce(Column.__add__, more, F.col("n")).alias("n"), "last", "fresh"))
        return reduce(DataFrame.unionAll, parts)

    def totals(self) -> DataFrame:
        """All keys seen so far: in how many documents, and the document that keeps the line."""
        return self._merged(self.runs).drop("fresh")

    def add(self, batch: DataFrame) -> None:
        """``batch``: (doc_id, a, b), a key at most once a document, no doc_id larger than any of an earlier batch."""
        own = bucketed(batch.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), self.n_buckets, ["a", "b"], "batch")
        # a key is fresh in one run alone
        seen = [r.where("fresh").select("a", "b").hint("merge") for r in self.runs]
        fresh = reduce(lambda left, run: left.join(run, ["a", "b"], "left_anti"), seen, own).select("a", "b", "n", "last", F.lit(True).alias("fresh"))
        known = [own.join(run, ["a", "b"], "left_semi").select("a", "b", "n", F.lit(None).cast(own.schema["last"].dataType).alias("last"), F.lit(False).alias("fresh")) for run in seen]
        self.levels[0].append(bucketed(reduce(DataFrame.unionAll, known, fresh), self.n_buckets, ["a", "b"], "run"))
        discard(own)
        self._compact()

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels) and len(self.levels[k]) >= self.fanout:
            merged = bucketed(self._merged(self.levels[k]), self.n_buckets, ["a", "b"], f"run{k + 1}")
            for run in self.levels[k]:
                discard(run)
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)
            k += 1


def _marked(at: DataFrame, frequent: DataFrame, total: int, share: int = 1000) -> DataFrame:
    """``at`` (doc_id, h, j, pos, a, b) where its line goes.

    Lines that fill more than 1 / ``share`` of all rows are fewer than ``share``, so those are broadcast; no
    other key is a large part of the join by shuffle.
    """
    goes = F.col("last").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("last"))
    hot = frequent.where(F.col("n") * share > total).select("a", "b", "last")
    rest = frequent.where(F.col("n") * share <= total).select("a", "b", "last")
    by_hot = at.join(F.broadcast(hot), ["a", "b"]).where(goes)
    by_rest = at.join(F.broadcast(hot), ["a", "b"], "left_anti").join(rest, ["a", "b"]).where(goes)
    return by_hot.select("h", "j", "pos").unionAll(by_rest.select("h", "j", "pos"))


def line_dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, n_batches: int = 5, keep: list[str] | None = None, bucket_lines: int = 500_000) -> DataFrame:
    """Drops frequent lines everywhere but in the largest doc_id that holds them.

    A key of at least ``least_chars`` code points found in at least ``least_docs`` documents loses all its
    lines except those of the largest doc_id with it.  The table is taken as about ``n_batches`` batches of
    falling doc_id, which the store gets one after the other; its runs have a bucket for ``bucket_lines`` lines.

    Returns ``keep`` (default: doc_id) and n_lines, n_dropped (long), kept_text.

    Defined cases: a null or empty text is one empty line; a line that occurs twice in a document counts
    once for it; rows count as documents even if they share a doc_id, and all rows with the largest doc_id
    keep the line; a null doc_id counts as a document, smaller than any other; a document may lose all
    its lines and then has an empty text; an empty table gives no rows; a text of any length is one row (its
    lines' hashes are one array); columns of any name pass through ``keep``.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    carried = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*carried, F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.select("*", F.xxhash64("__text").alias("__h")).withColumn("__j", F.xxhash64("__id", "__h"))
    hashed = materialize(rows.select(F.col("__id").alias("doc_id"), F.col("__h").alias("h"), F.col("__j").alias("j"), _hashes(F.split("__text", "\n", -1), least_chars).alias("keys")), "lines")
    parts = [i / n_batches for i in range(1, n_batches)]
    n_keys, cuts = hashed.agg(F.coalesce(F.sum(F.size(F.filter("keys", lambda x: x.isNotNull()))), F.lit(0)), F.percentile_approx("doc_id", parts) if parts else F.lit(None)).first()
    falling = sorted(set(cuts or []), reverse=True)
    store = LineRuns(spark, max(1, -(-n_keys // bucket_lines)))
    for k in range(len(falling) + 1):
        part = F.lit(True)
        if k < len(falling):
            part = F.col("doc_id") > falling[k]
        elif falling:
            part = F.col("doc_id").isNull() | (F.col("doc_id") <= falling[-1])
        if 0 < k < len(falling):
            part = part & (F.col("doc_id") <= falling[k - 1])
        once = hashed.where(part).select("doc_id", F.explode(F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))).alias("k"))
        store.add(once.select("doc_id", "k.a", "k.b"))
    frequent = materialize(store.totals().where(F.col("n") >= least_docs), "frequent")
    for run in store.runs:
        discard(run)
    at = hashed.select("doc_id", "h", "j", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("doc_id", "h", "j", "pos", "k.a", "k.b")
    drops = _marked(at, frequent, n_keys).groupBy(F.col("j").alias("__dj"), F.col("h").alias("__dh")).agg(F.collect_set("pos").alias("__drop"))
    # each text moves once, in as many partitions as the session has (never joined to larger ones), and streams past a
    # hash table of what goes: texts are not sorted; lines are cut again afterwards
    rows = rows.repartition(shuffle_width(spark), "__j", "__h")
    out = rows.join(drops.hint("shuffle_hash"), (F.col("__j") == F.col("__dj")) & (F.col("__h") == F.col("__dh")), "left")
    out = out.select("*", F.split("__text", "\n", -1).alias("__lines"))
    size = F.size("__lines")
    stays = F.array_except(F.sequence(F.lit(0), size - 1), "__drop")
    left = F.array_join(F.transform(stays, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    whole = F.col("__drop").isNull()
    return out.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], size.cast("long").alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_dropped"), F.when(whole, F.col("__text")).otherwise(left).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with the lines of :func:`line_dedup` gone; every row and column stays, text (and n_chars) change.

    Defined cases: those of :func:`line_dedup`; a null text becomes an empty one.
    """
    others = docs.drop("text")
    inner = docs.select(packed(others), "doc_id", "text")
    out = line_dedup(inner, least_chars, least_docs, keep=["__row"])
    changed = with_lengths(docs.columns, F.col("kept_text"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`__row`.`{c}`").alias(c) for c in docs.columns])
