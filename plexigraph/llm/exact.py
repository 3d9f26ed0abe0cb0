"""Exact dedup (3): filters of immutable snapshots screen new digests; positives are checked byte by byte.

A *snapshot* is a table of digests that never changes once written, cut into buckets by digest, with
one static three-wise binary-fuse filter (8-bit fingerprints, about 9 bits a digest) for each bucket.
The digests of a new batch are first grouped among themselves (partial sums before the shuffle, so a
text that fills a third of the rows is one row a task), then each bucket of them meets the filters of
its bucket.  Negatives are new for certain and make the next snapshot.  Positives join the exact bucket, and
the texts of the pairs that match are compared as bytes: those that are equal add to the group that they
matched, the others are new as well.  So every group is in one snapshot, and groups need no regrouping.

Texts are equal if they are identical after lower-casing A-Z only; null counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.llm.common import packed, text_bytes, unpacked
from plexigraph.session import materialize, shuffle_width

_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = x + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * _MIX[0]
        h = (h ^ (h >> np.uint64(33))) * _MIX[1]
        return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Three-wise binary-fuse filter over a fixed set of 64-bit keys: no false negative, 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots in three neighbouring segments."""
        first = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
        mask = np.uint64(segment - 1)
        parts = [h & mask, (h >> np.uint64(13)) & mask, (h >> np.uint64(26)) & mask]
        return np.stack([((first + np.uint64(i)) * np.uint64(segment) + p).astype(np.int64) for i, p in enumerate(parts)])

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels in rounds: all slots that hold one key only go at once.  Another seed if a core remains."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << max(2, min(13, int(np.log(n) / np.log(3.33) + 2.25)))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(2, n)))) + 8
        segments = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            h = _mix(keys, seed * 0x9E3779B9)
            slots = cls._slots(h, segment, segments)
            total = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=total)
            owner = np.zeros(total, np.int64)
            for s in slots:
                np.add.at(owner, s, np.arange(len(keys)))  # a slot with one key left holds that key's index
            order, placed, alive = [], [], np.ones(len(keys), bool)
            single = np.flatnonzero(count == 1)
            while len(single):
                who = owner[single]
                who, at = np.unique(who, return_index=True)
                order.append(who)
                placed.append(single[at])
                alive[who] = False
                for s in slots[:, who]:
                    np.subtract.at(count, s, 1)
                    np.subtract.at(owner, s, who)
                touched = np.unique(slots[:, who])
                single = touched[count[touched] == 1]
            if alive.any():
                size = int(size * 1.05) + 4
                segments = max(1, -(-size // segment) - 2)
                continue
            prints = np.zeros(total, np.uint8)
            marks = (h >> np.uint64(56)).astype(np.uint8) ^ h.astype(np.uint8)
            for who, at in zip(reversed(order), reversed(placed), strict=True):
                x = marks[who] ^ prints[slots[0, who]] ^ prints[slots[1, who]] ^ prints[slots[2, who]]
                prints[at] = x ^ prints[at]
            return cls(seed, segment, segments, prints)
        raise ValueError("no seed gave a filter")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed * 0x9E3779B9)
        a, b, c = self._slots(h, self.segment, self.segments)
        marks = (h >> np.uint64(56)).astype(np.uint8) ^ h.astype(np.uint8)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == marks

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.prints.tobytes()

    @classmethod
    def load(cls, data: bytes) -> FuseFilter:
        return cls(*map(int, np.frombuffer(data, np.int64, 3)), np.frombuffer(data, np.uint8, offset=24))


@arrow_udf(T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.lower()).digest() for x in text_bytes(text)], pa.binary())


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), "<u8")


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))


def grouped(digests: DataFrame) -> DataFrame:
    """One row a digest: ``size`` rows, ``last`` largest doc_id (null if all are null)."""
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("last"))


def build_snapshot(groups: DataFrame, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """Immutable snapshot of grouped digests: exact buckets, and a filter for each bucket."""
    entries = materialize(_bucketed(groups, n_buckets), "snapshot")

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t["bucket"][:1], "filter": pa.array([FuseFilter.build(_keys(t["digest"])).dump()], pa.binary())})

    filters = entries.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
    return entries, materialize(filters, "filters")


def screen(groups: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """Adds ``maybe``: false if the snapshot certainly lacks the digest."""

    def probe(new: pa.Table, old: pa.Table) -> pa.Table:
        if not new.num_rows:
            return new.append_column("maybe", pa.array([], pa.bool_()))
        data = old["filter"][0].as_py() if old.num_rows else None
        maybe = FuseFilter.load(data).holds(_keys(new["digest"])) if data else np.zeros(new.num_rows, bool)
        return new.append_column("maybe", pa.array(maybe))

    new = _bucketed(groups, n_buckets).select("bucket", "digest", "size", "last")
    schema = "bucket int, digest binary, size long, last long, maybe boolean"
    return new.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, schema)


def _needed_filter(need: DataFrame, n_buckets: int, most: int = 32 << 20) -> dict[int, bytes] | None:
    """Fuse filters of the keys ``j``, by bucket, if they take at most ``most`` bytes; else None."""

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t["bucket"][:1], "filter": pa.array([FuseFilter.build(t["j"].to_numpy().view(np.uint64)).dump()], pa.binary())})

    keys = need.select("j", F.pmod("j", F.lit(n_buckets)).cast("int").alias("bucket")).distinct()
    filters = materialize(keys.groupBy("bucket").applyInArrow(build, "bucket int, filter binary"), "needed")
    if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > most:
        return None
    return {r["bucket"]: bytes(r["filter"]) for r in filters.collect()}


def _same_bytes(docs: DataFrame, pairs: DataFrame, n_buckets: int) -> DataFrame:
    """Of ``pairs`` (digest, old, new: doc_ids), those whose texts are the same bytes after lower-casing A-Z.

    Two rows that share a doc_id but not a text are told apart by the digest.  Only texts that a filter of the
    needed doc_ids lets pass are digested again and shuffled; all of them where that filter is too large.
    """
    need = materialize(pairs.select("digest", F.explode(F.array(F.xxhash64("old"), F.xxhash64("new"))).alias("j")).distinct(), "need")
    sent = docs.sparkSession.sparkContext.broadcast(_needed_filter(need, n_buckets))

    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        filters = None if held is None else {k: FuseFilter.load(v) for k, v in held.items()}
        for b in batches:
            j = b.column(0).to_numpy(zero_copy_only=False)
            keep = np.ones(len(j), bool)
            if filters is not None:
                bucket = j % n_buckets  # as pmod: not negative
                keep[:] = False
                for k in np.unique(bucket).tolist():
                    if k in filters:
                        at = np.flatnonzero(bucket == k)
                        keep[at] = filters[k].holds(j[at].view(np.uint64))
            b = b.filter(pa.array(keep))
            low = [x.lower() for x in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in low], pa.binary()), pa.array(low, pa.binary())], ["j", "digest", "b"])

    texts = docs.select(F.xxhash64("doc_id").alias("j"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lowered, "j long, digest binary, b binary")
    # one plan at every size: each text moves once and streams past a hash table of the rows needed, unsorted
    texts = texts.repartition(shuffle_width(docs.sparkSession), "digest", "j")
    found = texts.join(need.hint("shuffle_hash"), ["digest", "j"], "left_semi")
    sides = found.groupBy("digest").agg(F.min("b").alias("x"), F.max("b").alias("y"))
    return sides.where("x = y").select("digest")


def exact_dedup(docs: DataFrame, n_batches: int = 2) -> DataFrame:
    """Groups of equal texts, the table taken as ``n_batches`` batches that arrive one after the other.

    Each batch is screened against the snapshots before it, grouped by itself where it is new, and then
    frozen as a snapshot.  Returns for every row of ``docs``: doc_id, keep_id (largest doc_id of equal
    texts), group_size (long), kept (this row stays), text_sha256.

    Defined cases: a null text is an empty one; rows of a null doc_id count in group_size and are kept
    only if the whole group has none (then keep_id is null and each such row stays); rows repeated with the largest
    doc_id all say kept; an empty table gives no rows; other columns are not read; a text of any length is one
    row and is compared whole.  Raises ArithmeticError if two different texts share a SHA-256 digest.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int")
    digests = materialize(docs.select("doc_id", batch.alias("batch"), text_digest("text").alias("digest")), "digests")
    n_buckets = max(2 * shuffle_width(spark), digests.count() // 100_000)
    snapshots: list[tuple[DataFrame, DataFrame | None]] = []
    added: list[DataFrame] = []
    for k in range(n_batches):
        new = grouped(digests.where(F.col("batch") == k).select("doc_id", "digest"))
        if snapshots:
            new = materialize(new, "batch")
            for entries, filters in snapshots:
                hits = screen(new, filters, n_buckets).where("maybe").select("digest", "size", F.col("last").alias("new"))
                pairs = materialize(hits.join(entries.select("digest", F.col("last").alias("old")), "digest"), "pairs")
                same = materialize(_same_bytes(docs, pairs, n_buckets), "same")
                if not pairs.join(same, "digest", "left_anti").isEmpty():
                    raise ArithmeticError("two different texts share a SHA-256 digest")
                added.append(pairs.join(same, "digest", "left_semi").select("digest", F.col("size").alias("more"), F.col("new").alias("more_last")))
                new = new.join(same, "digest", "left_anti")
        new = new.select("digest", "size", "last")
        snapshots.append(build_snapshot(new, n_buckets) if k + 1 < n_batches else (materialize(new, "snapshot"), None))  # nobody asks the last one
    groups = reduce(DataFrame.unionAll, [entries.select("digest", "size", "last") for entries, _ in snapshots])
    groups = groups.select("digest", F.col("size").alias("group_size"), F.col("last").alias("keep_id"))
    if added:
        more = reduce(DataFrame.unionAll, added).groupBy("digest").agg(F.sum("more").alias("more"), F.max("more_last").alias("more_last"))
        groups = groups.join(more, "digest", "left").select("digest", (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"), F.greatest("keep_id", "more_last").alias("keep_id"))
    out = digests.join(materialize(groups, "groups"), "digest")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, n_batches: int = 2) -> DataFrame:
    """``docs`` without the copies that :func:`exact_dedup` finds; all columns stay as they are.

    Defined cases: those of :func:`exact_dedup`.
    """
    kept = exact_dedup(docs, n_batches).where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct()
    rows = docs.select(packed(docs), text_digest("text").alias("__d"))
    hit = rows.join(kept, rows["__row.doc_id"].eqNullSafe(kept["__id"]) & (rows["__d"] == kept["__digest"]), "left_semi")
    return unpacked(hit, docs.columns)
