"""SimHash near-dedup at a similarity: Jaccard of 0.8 or more between sets of five-word shingles.

Operator 4's fingerprints over five-word shingles and its generalised pigeonhole find texts that differ in a few
bits; each such pair is verified on its whole sets.  Two texts of similarity 0.8 differ in some ten of 64 bits,
though, where no cut of the bits is selective, so SimHash alone would miss most of them.  What it can't see is
found exactly: all sets are put in one order of shingles, the rare ones first (by counts over all texts); two sets that
similar share a shingle among the first n - ceil(0.8 n) + 1 of each.  First each such shingle's members meet one
hub, the member with the most shared ones, so a dense group of copies gives as many pairs as it has members; then
those still in different components meet all others.  Of what meets, a pair goes on only if what either set holds
behind the shingle is enough, and if so few bits of their parity tables differ.  Both are bounds, which lose no
pair; what passes is verified on its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexigraph.llm.common import chunks, split_words
from plexigraph.llm.phrases import flat, mixed64
from plexigraph.llm.simhash import keep_first, links, majority
from plexigraph.operators.components import weak_components
from plexigraph.session import discard, materialize

SHINGLE = 5
CHUNK = 2 << 20
#: Words of the parity table of a set: bit k is 1 if an odd number of its shingles fall on k.
PARITY = [f"b{k}" for k in range(8)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, how many each text has): all words where there are fewer than five, none without words."""
    from xxhash import xxh64_intdigest

    size, words = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    kinds = np.array([xxh64_intdigest(w, SHINGLE) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = kinds[coded.indices.to_numpy(zero_copy_only=False)] if len(kinds) else np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    count = np.where(size > 0, np.maximum(1, size - SHINGLE + 1), 0)
    at = flat(begin, count)
    last = np.repeat(begin + size, count) - 1
    out = word[at] if len(at) else word
    for k in range(1, SHINGLE):
        inside = at + k <= last
        out = np.where(inside, out * _STEP + word[np.minimum(at + k, len(word) - 1)], out) if len(at) else out
    return mixed64(out), count


def _levels(docs: DataFrame) -> bytes:
    """Of all texts: for each value of a shingle hash's first 24 bits, the level (bits of the count) of the shingles that begin so.

    16 MB whatever the corpus.  It only sets the order in which sets are written, rare shingles first, which decides no pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 24, np.uint32)
        for b in chunks(batches, "text", CHUNK):
            at, n = np.unique(shingles(b.column(0))[0] >> np.uint64(40), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1)
        data = [squeeze.compress(total[k << 16 : (k + 1) << 16].tobytes()) for k in range(256)]
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(data, pa.binary())], ["k", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, np.uint64)
        for p in t["part"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(p.as_py()), "<u4")
        return pa.table({"k": t["k"][:1], "part": pa.array([np.frexp(total.astype(np.float64))[1].astype(np.uint8).tobytes()], pa.binary())})

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    parts = {r["k"]: bytes(r["part"]) for r in texts.mapInArrow(count, "k int, part binary").groupBy("k").applyInArrow(add, "k int, part binary").collect()}
    return b"".join(parts.get(k, bytes(1 << 16)) for k in range(256))


def _sets(texts: pa.Array, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of each text once, in the common order; how many; fingerprints)."""
    g, count = shingles(texts)
    prints = majority(g, count)
    doc = np.repeat(np.arange(len(count)), count)
    late = levels[(g >> np.uint64(40)).astype(np.int64)]
    order = np.lexsort((g, late, doc))
    g, doc = g[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[first], np.bincount(doc[first], minlength=len(count)), prints


def _names(g: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Names each set: equal sets have one name."""
    from xxhash import xxh3_128_digest

    data, ends = g.tobytes(), (8 * np.cumsum(count)).tolist()
    return [xxh3_128_digest(data[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def _parities(g: np.ndarray, count: np.ndarray) -> pa.Array:
    """The parity table of each set."""
    width = 64 * len(PARITY)
    out = np.zeros((len(count), width // 8), np.uint8)
    ends = np.cumsum(count)
    for s in range(0, len(count), 1024):  # 4 MB of counts
        own = g[ends[s] - count[s] : ends[min(s + 1024, len(count)) - 1]]
        doc = np.repeat(np.arange(len(count[s : s + 1024])), count[s : s + 1024])
        held = np.bincount(doc * width + ((own >> np.uint64(16)) % np.uint64(width)).astype(np.int64), minlength=width * len(count[s : s + 1024]))
        out[s : s + 1024] = np.packbits((held & 1).astype(np.uint8).reshape(-1, width), axis=1)
    words = out.view(np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(PARITY))], PARITY)


def _odd(na: Column, x: str, nb: Column, y: str) -> Column:
    """Whether parity tables allow a similarity of 0.8: each bit in which they differ has a shingle that only one set holds, of which there are at most a ninth of both sizes."""
    return 9 * reduce(Column.__add__, (F.bit_count(F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))) for k in PARITY)) <= na + nb


def _first(na: Column, i: Column, nb: Column, j: Column) -> Column:
    """Whether two sets of ``na`` and ``nb`` shingles, whose first common one stands behind i and j others, may have a similarity of 0.8.

    They share no more than is left from there on.  A later common shingle allows less, so a similar pair passes at its first one at least.
    """
    return 9 * F.least(na - i, nb - j) >= 4 * (na + nb)


def _numbered(sets: DataFrame) -> DataFrame:
    """``sets`` (key, ..) with ``id``, a hash of the key under the first seed that gives each its own."""
    n, seed = sets.count(), 0
    while True:
        out = sets.withColumn("id", F.xxhash64(F.lit(seed), "key"))
        if out.agg(F.count_distinct("id")).first()[0] == n:
            return out
        seed += 1


def similar_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, h, label) of every row: rows with one label are joined by links of similarity 0.8 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(_levels(docs))  # 16 MB

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sent.value, np.uint8)
        for b in chunks(batches, "text", CHUNK):
            g, n, prints = _sets(b.column(1), levels)
            size = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            first = g[flat(np.cumsum(n) - n, size)] if len(g) else g
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(first.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_names(g, n), pa.binary()), pa.array(n), pa.array(prints.view(np.int64)), lists, _parities(g, n)], ["doc_id", "h", "key", "n", "fp", "prefix", "bits"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sent.value, np.uint8)
        for b in chunks(batches, "text", CHUNK):
            g, n, _ = _sets(b.column(0), levels)
            ends = np.cumsum(n).tolist()
            own = [g[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            sketches = [np.unique((x & np.uint64(0xFFFF)).astype("<u2")).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(_names(g, n), pa.binary()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(sketches, pa.binary())], ["key", "whole", "sketch"])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, na, nb, sketch of a, of b): shingles in both have a sketch value in both, and as many more may share one as either set has lost."""
        for b in batches:
            na, nb = (b.column(i).to_numpy() for i in (2, 3))
            same, lost = np.empty(len(na), np.int64), np.empty(len(na), np.int64)
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_py(), "<u2") for v in (x, y))
                same[i], lost[i] = len(np.intersect1d(x, y, assume_unique=True)), min(na[i] - len(x), nb[i] - len(y))
            near = pa.array(9 * (same + lost) >= 4 * (na + nb))
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in b.columns[:4]], ["a", "b", "na", "nb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                near.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in b.columns[:4]], ["a", "b", "na", "nb"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    made = materialize(texts.mapInArrow(prefixes, f"doc_id {kind}, h long, key binary, n long, fp long, prefix array<long>, bits struct<{', '.join(f'{k}: long' for k in PARITY)}>"), "prefixes")
    sets = materialize(_numbered(made.select("key", "h", "n", "fp", "prefix", "bits").dropDuplicates(["key"])), "sets")
    rows = materialize(made.select("doc_id", "h", "key"), "names")
    discard(made)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (a, b), the links.  Bounds by the prefixes and by sketches (16 bits a shingle) come first; whole sets move only for what passes both."""
        # how many shingles of their prefixes they share
        x = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
        y = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("both"))
        rest = F.ceil(4 * F.greatest("na", "nb") / 5) - 1  # behind the longer set's prefix
        likely = materialize(pairs.where(9 * (F.col("both") + rest) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb"), "likely")
        used = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
        needed = sets.join(used, "id", "left_semi").select("h", "key", "id")
        made = texts.join(needed.select("h").distinct(), "h", "left_semi").select("text").mapInArrow(whole, "key binary, whole binary, sketch binary").dropDuplicates(["key"])
        full = materialize(made.join(needed, "key").select("id", "whole", "sketch"), "whole")
        near = in_rounds(likely, full.select("id", F.col("sketch").alias("s")), 2, may, "a long, b long, na long, nb long")
        out = in_rounds(near, full.select("id", F.col("whole").alias("s")), 8, compare, "a long, b long, na long, nb long")
        for t in (likely, full, near):
            discard(t)
        return out

    def in_rounds(pairs: DataFrame, side: DataFrame, width: int, test, schema: str) -> DataFrame:
        """The pairs that pass ``test`` with both sides' ``s``.  A side travels with each pair, so no more pairs go at once than such sides fill half of the texts' bytes."""
        size = (pairs.agg(F.sum("na")).first()[0] or 0) * width
        rounds = max(1, -(-2 * size // max(1, total)))
        parts = []
        for k in range(rounds):
            own = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k) if rounds > 1 else pairs
            both = own.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
            parts.append(materialize(both.mapInArrow(test, schema), "passed"))
        if rounds == 1:
            return parts[0]
        out = materialize(reduce(DataFrame.unionAll, parts), "passed")
        for t in parts:
            discard(t)
        return out

    # pairs by fingerprint: sets that share one meet the least of them, and those least ones meet by the pigeonhole
    prints = materialize(sets.groupBy("fp").agg(F.min("id").alias("rep")), "prints")
    near = links(prints.select("fp"))
    same = sets.join(prints, "fp").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    ends = near.join(prints.toDF("src", "a"), "src").join(prints.toDF("dst", "b"), "dst").select("a", "b")
    # pairs by shared shingles
    tokens = sets.select("id", "n", F.posexplode("prefix").alias("at", "tok"))
    often = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = materialize(tokens.join(often, "tok"), "shared")
    weight = shared.groupBy("id").agg(F.sum("df").alias("w"))
    hubs = shared.join(weight, "id").groupBy("tok").agg(F.max(F.struct("w", "id", "n", "at")).alias("hub"))
    met = shared.join(hubs, "tok").where((F.col("id") != F.col("hub.id")) & _first(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"))).select(F.col("id").alias("a"), F.col("hub.id").alias("b"))
    pairs = same.unionAll(ends).unionAll(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = materialize(pairs, "stars")
    found = verified(stars).select("a", "b")

    def placed(table: DataFrame, links: DataFrame) -> DataFrame:
        labels = weak_components(links.toDF("src", "dst"))
        return table.join(labels.toDF("lid", "l"), F.col("id") == F.col("lid"), "left").select(*table.columns, F.coalesce("l", "id").alias("label"))

    held = materialize(placed(shared.select("id", "n", "at", "tok"), found), "parts")
    discard(shared)
    mixed = held.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("tok")
    parts = materialize(held.join(mixed, "tok", "left_semi").join(sets.select("id", "bits"), "id").select("id", "n", "at", "tok", "label", "bits"), "mixed")
    discard(held)
    # the smaller set of a similar pair holds a common shingle in its first ninth, so only those look for others
    x, y = parts.where("9 * at <= n").toDF("a", "na", "i", "tok", "la", "x"), parts.toDF("b", "nb", "j", "tok", "lb", "y")
    order = F.struct("na", "a") < F.struct("nb", "b")
    na, nb = F.col("na"), F.col("nb")
    apart = x.join(y, "tok").where((F.col("la") != F.col("lb")) & order & _first(na, F.col("i"), nb, F.col("j")) & _odd(na, "x", nb, "y"))
    ends = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(ends.join(stars, ["a", "b"], "left_anti"), "apart")
    for t in (stars, parts):
        discard(t)
    more = verified(rest).select("a", "b")
    ids = materialize(placed(sets.select("key", "id"), found.unionAll(more)), "labels")
    for t in (sets, rest, prints):
        discard(t)
    return rows.join(ids, "key").select("doc_id", "h", "label")


def keep_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component of similar texts: that of the smallest doc_id.  All columns stay.

    Defined cases: texts without words (or null) are one set; texts under five words are similar only if their words
    are the same; repeated rows are copies; a component without any doc_id keeps one of its rows; an empty table gives
    no rows; a text of any length is one set, made by itself.
    """
    return keep_first(docs, materialize(similar_labels(docs), "similar_labels"))
