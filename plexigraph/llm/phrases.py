"""Phrases cut by rolling-hash triggers, and how they travel: what the two substring operators share.

Every window of ``span`` symbols (bytes or words) has one trigger: the k-gram with the smallest rolling
hash inside it, the leftmost of equals.  A phrase is the stretch that a run of consecutive windows with
the same trigger covers.  So a window lies whole in exactly one phrase, and equal windows, wherever they
stand, have the same trigger at the same offset and meet in the bucket of the trigger's hash.

K-grams that are common in a sample of the corpus count as larger than all others.  So a window has a common
trigger only if it lies whole within common text, where phrases are alike and collapse; the windows at the edge
of a passage that a third of all documents hold have triggers that reach into what follows, and spread.  The
sample sets this order alone: whatever it says, equal windows meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexigraph.llm.common import chunks, text_bytes
from plexigraph.session import materialize, shuffle_width

NULL_ID = np.iinfo(np.int64).max
SPAN_ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
BLOBS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("payload", T.BinaryType())])
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def common_grams(docs: DataFrame, grams: Callable[[list[bytes]], np.ndarray], most: int = 20_000, sample: int = 64 << 20, least: int = 8) -> np.ndarray:
    """Hashes of the at most ``most`` most frequent k-grams of about ``sample`` bytes of text, each ``least`` times in a chunk of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 << 20):
            g, n = np.unique(grams(text_bytes(b.column(0))), return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(g[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["g", "n"])

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // sample))) == 0).select(F.coalesce("text", F.lit("")).alias("text"))
    top = some.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(most)
    return np.array([r["g"] for r in top.collect()], np.int64).view(np.uint64)


def common_table(common: np.ndarray) -> np.ndarray:
    """By the first 20 bits of a hash: does a common k-gram begin so?"""
    table = np.zeros(1 << 20, bool)
    table[(common >> np.uint64(44)).astype(np.int64)] = True
    return table


def ordered(gram: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hashes with common ones above all others."""
    return (gram >> np.uint64(1)) | (table[(gram >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(63))


def cut(gram: np.ndarray, doc: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases as (first window, last window, trigger position), by symbol index.

    gram: hash of the k-gram at each symbol (as many as symbols; those past an end never count);
    doc: the text each symbol belongs to.
    """
    n = len(doc)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none
    width = span - k + 1
    low = (gram[: n - k + 1] & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - k + 1, dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(doc[: n - span + 1] == doc[span - 1 :])
    if not len(at):
        return none, none, none
    t = trigger[at]
    new = np.flatnonzero((np.diff(t) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.append(0, new), np.append(new, len(at)) - 1
    return at[first], at[last], t[first]


def pack(arrays: list[np.ndarray], squeeze: zstandard.ZstdCompressor) -> bytes:
    """Arrays after each other, behind their lengths in bytes."""
    data = [a.tobytes() if isinstance(a, np.ndarray) else a for a in arrays]
    return squeeze.compress(b"".join([np.array([len(data), *map(len, data)], "<i8").tobytes(), *data]))


def unpack(blob: bytes, kinds: list[str | None]) -> list:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(data[at : at + size] if kind is None else np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def blobs(rows: list[tuple[int, int | None, int | None, bytes]]) -> pa.RecordBatch:
    b, i, h, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(i, pa.int64()), pa.array(h, pa.int64()), pa.array(p, pa.binary())], ["bucket", "doc_id", "h", "payload"])


def spread(doc_id: int, h: int, n: int) -> int:
    """The bucket that carries a document's own spans: copies of one text go to different ones."""
    return ((int(doc_id) * 0x9E3779B97F4A7C15 + int(h)) % (1 << 64) >> 24) % n


def span_table(doc: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
    doc = np.asarray(doc, np.int64)
    return pa.table({"doc_id": pa.array(doc, mask=doc == NULL_ID), "h": pa.array(np.asarray(h, np.int64)), "s": pa.array(np.asarray(s, np.int64)), "e": pa.array(np.asarray(e, np.int64))})


def own_spans(t: pa.Table) -> list[pa.Table]:
    """Spans that the parse settled by itself, which passed through the shuffle as they were."""
    out = []
    for i, h, p in zip(t["doc_id"].to_pylist(), t["h"].to_pylist(), t["payload"].to_pylist(), strict=True):
        x = np.frombuffer(p, "<i8").reshape(-1, 2)
        out.append(span_table(np.full(len(x), NULL_ID if i is None else i), np.full(len(x), h), x[:, 0], x[:, 1]))
    return out


def flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same for the next."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def runs_of(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each maximal run of set flags within one owner."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
    return at[np.append(0, new)], at[np.append(new, len(at)) - 1]


def settle(parsed: DataFrame, solve) -> DataFrame:
    """All blobs of a bucket to ``solve``; one row a document: doc_id, h, spans (sorted list of s, e).

    The result is written, which lets the blobs' shuffle go before texts are shuffled to meet it.
    """
    found = parsed.groupBy("bucket").applyInArrow(solve, SPAN_ROWS)
    return materialize(found.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__dh")).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def bucket_count(docs: DataFrame, size: int = 4 << 20) -> int:
    """A bucket for each ``size`` bytes of text, and some for each of the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * shuffle_width(docs.sparkSession), -(-total // size))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans (start, end)."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
