"""SimHash near-dedup (4): generalised pigeonhole over correlated bit groups.

A 64-bit fingerprint is cut into m groups of bits, bits that go together across the corpus into the
same group.  Group i gets a threshold t_i of its own (-1: not probed), with the sum of (t_i + 1) equal
to the allowed distance plus 1: two fingerprints within the distance then agree on some group up to its
threshold.  m and the thresholds come from a dynamic programme over estimated probes and candidates,
from bit counts and bit-pair counts of *all* distinct fingerprints.

Each distinct fingerprint is dealt out by its group values and, for thresholds over 0, by those values
with up to t_i set bits cleared (two values within t_i share such a form).  A group that is too large is
dealt out again by pieces of its other bits.  Rows that meet are verified by their full distance; of the links in one meeting only a spanning forest is kept, so a dense group
gives as many rows as it has members, never all its pairs.  Components follow by minimum label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.llm.common import packed, slices, text_bytes, unpacked
from plexigraph.operators.components import weak_components
from plexigraph.session import materialize, shuffle_width

SHINGLE = 4
SEED = 42


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if set in over half the hashes of the text's shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, b in enumerate(texts):
        words = b.lower().split()
        if not words:
            continue
        line = b" ".join(words)
        at = list(accumulate((len(w) + 1 for w in words), initial=0))
        if len(words) < shingle:
            hashes.append(xxh64_intdigest(line, SEED))
            counts[i] = 1
        else:
            hashes += [xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(at, at[shingle:])]
            counts[i] = len(words) - shingle + 1
    return majority(np.array(hashes, np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the bits that over half of its hashes have; ``hashes`` one text after the other, none: 0."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


@arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """Fingerprints as signed longs, over about 2 MB of text at a time (one long text may be more)."""
    parts = [np.zeros(0, np.uint64)]
    for s, e in slices(text, 2 << 20):
        parts.append(fingerprints(text_bytes(text.slice(s, e - s))))
    return pa.array(np.concatenate(parts).view(np.int64))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and a 64 x 64 table of how many have both bits set: of all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = 0, np.zeros((64, 64), np.float64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for k in range(0, len(x), 1 << 16):
                bits = np.unpackbits(x[k : k + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                pairs += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(pairs.ravel(), n).astype(np.int64))], ["k", "n"])

    rows = fps.select("fp").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(4097)
    for r in rows:
        flat[r["k"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def bit_groups(n: int, pairs: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits: each starts with the lowest free bit and takes the bits most correlated with it."""
    p = np.diag(pairs) / max(1, n)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(pairs / max(1, n) - np.outer(p, p)) / np.outer(dev, dev)
    free, out = list(range(64)), []
    for k in range(m):
        want = len(free) // (m - k)
        own = [free.pop(0)]
        while len(own) < want:
            best = max(free, key=lambda j: (corr[own, j].sum(), -j))
            free.remove(best)
            own.append(best)
        out.append(own)
    return out


def agreement(n: int, pairs: np.ndarray, group: list[int]) -> float:
    """Estimated chance that two fingerprints agree on all bits of a group.

    The chances for single bits and for pairs of bits are exact, by the counts.  They are chained: each bit
    counts given the earlier bit of its group that it goes with most, so bits that always agree count once.
    """
    p11 = pairs / max(1, n)
    p = np.diag(p11)
    one = p * p + (1 - p) * (1 - p)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    two = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
    given = two / np.maximum(one[None, :], 1e-12)  # of the row's bit, given the column's
    out = float(one[group[0]])
    for k in range(1, len(group)):
        out *= float(np.clip(given[group[k], group[:k]].max(), 0.0, 1.0))
    return out


def thresholds(n: int, pairs: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds by dynamic programming; cost: rows dealt out plus 1/20 for each estimated candidate."""
    need = distance + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for g in groups:
        b, same = len(g), agreement(n, pairs, g)
        costs = [0.0]
        for t in range(need):
            dealt = n * sum(comb((b + 1) // 2, k) for k in range(t + 1))
            costs.append(dealt + 0.05 * n * n / 2 * min(1.0, same * sum(comb(b, k) for k in range(t + 1))))
        best = [min(((best[s - x][0] + costs[x], [*best[s - x][1], x - 1]) for x in range(s + 1) if best[s - x][0] < float("inf")), default=(float("inf"), [])) for s in range(need + 1)]
    return best[need]


def plan(n: int, pairs: np.ndarray, distance: int = 4) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each probed group, the cheapest over all m from 1 to distance + 1."""
    options = []
    for m in range(1, distance + 2):
        groups = bit_groups(n, pairs, m)
        cost, ts = thresholds(n, pairs, groups, distance)
        options.append((cost, m, [(sum(1 << j for j in g), t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options)[2]


def _signatures(fp: np.ndarray, mask: int, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, value): the group's value, and it with up to t of its set bits cleared."""
    own = fp & np.uint64(mask)
    rows = np.arange(len(fp))
    yield rows, own
    bits = [j for j in range(64) if mask >> j & 1]
    for k in range(1, t + 1):
        for drop in combinations(bits, k):
            d = np.uint64(sum(1 << j for j in drop))
            hit = np.flatnonzero((own & d) == d)
            yield rows[hit], own[hit] & ~d


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(fp: np.ndarray, parent: list[int], base: np.ndarray, distance: int, out: list[tuple[int, int]]) -> None:
    """Joins rows ``base`` (indices into fp, not yet joined) that lie within the distance; adds only links between separate trees to out."""
    x, label = fp[base], np.arange(len(base))
    for d in range(1, len(x)):
        for i in np.flatnonzero((np.bitwise_count(x[d:] ^ x[:-d]) <= distance) & (label[d:] != label[:-d])).tolist():
            a, b = label[i], label[i + d]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                out.append((int(base[i]), int(base[i + d])))
    for i, top in zip(base.tolist(), base[label].tolist(), strict=True):
        parent[i] = top


def _spread(rows: DataFrame, distance: int, crowd: int) -> DataFrame:
    """``rows``: (used, value, fp), groups by (used, value).  Deals groups of over ``crowd`` rows out again.

    The bits that such a group has not used are cut into distance + 1 pieces; rows within the distance agree on
    one of them, so each piece's value makes a narrower group, and so on until none is too large or under
    distance + 1 bits are left (then a group is small, as its fingerprints are distinct).  All by joins and
    counts, so no task gathers a large group.  Each level writes distance + 1 rows for each row of such a group.
    """

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used, value, fp = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns)
            for u in np.unique(used):
                at = np.flatnonzero(used == u)
                left = [j for j in range(64) if not int(u) >> j & 1]
                for k in range(distance + 1):
                    piece = np.uint64(sum(1 << j for j in left[k :: distance + 1]))
                    cols = (np.full(len(at), u | piece), value[at] | (fp[at] & piece), fp[at])
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["used", "value", "fp"])

    settled: list[DataFrame] = []
    while True:
        wide = F.bit_count("used") < 64 - distance
        sizes = rows.groupBy("used", "value").agg(F.count(F.lit(1)).alias("n"))
        crowded = materialize(sizes.where((F.col("n") > crowd) & wide).select("used", "value"), "crowded")
        n = crowded.count()
        if not n:
            return reduce(DataFrame.union, settled, rows)
        few = F.broadcast(crowded) if n <= 200_000 else crowded  # some 10 MB; beyond, Spark joins by shuffle
        settled.append(rows.join(few, ["used", "value"], "left_anti"))
        rows = materialize(rows.join(few, ["used", "value"], "left_semi").mapInArrow(deeper, "used long, value long, fp long"), "deeper")


def links(fps: DataFrame, distance: int = 4, crowd: int = 1 << 15) -> DataFrame:
    """``fps``: distinct (fp).  Links (src, dst) between fingerprints within the distance: enough to connect whatever is linked.

    Groups of over ``crowd`` fingerprints are split over tasks before their rows are compared.
    """
    n, pairs = bit_counts(fps)
    groups = plan(n, pairs, distance) if n else [((1 << 64) - 1, distance)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(every), 1 << 13):
                fp = every[s : s + (1 << 13)]
                for mask, t in groups:
                    for rows, value in _signatures(fp, mask, t):
                        cols = (np.full(len(rows), mask, np.uint64), value, fp[rows])
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["used", "value", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            used, value, fp = (t.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((used[1:] != used[:-1]) | (value[1:] != value[:-1])) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(fp))
            out: list[tuple[int, int]] = []
            size = ends - starts
            # pairs are quickest among all small groups at once: shift by d and compare rows of one group
            group = np.repeat(np.arange(len(starts)), size)
            small = size <= 64
            x_at = np.flatnonzero(small[group])
            x, g = fp[x_at], group[x_at]
            parent = list(range(len(fp)))
            for d in range(1, min(64, len(x))):
                near = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(x[d:] ^ x[:-d]) <= distance))
                for i in near.tolist():
                    a, b = _find(parent, int(x_at[i])), _find(parent, int(x_at[i + d]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((int(x_at[i]), int(x_at[i + d])))
            for k in np.flatnonzero(~small).tolist():
                _forest(fp, parent, np.arange(starts[k], ends[k]), distance, out)
            a = np.array(out, np.int64).reshape(-1, 2)
            signed = fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[a[:, 0]]), pa.array(signed[a[:, 1]])], ["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            used, value = t.column(0).to_numpy(), t.column(1).to_numpy()
            # all groups but the last are whole
            cut = np.flatnonzero((used != used[-1]) | (value != value[-1]))
            if len(cut):
                whole = int(cut[-1]) + 1
                yield solve(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    width = shuffle_width(fps.sparkSession)
    dealt = _spread(fps.select("fp").mapInArrow(deal, "used long, value long, fp long"), distance, crowd)
    return dealt.repartition(width, "used", "value").sortWithinPartitions("used", "value", "fp").mapInArrow(meet, "src long, dst long")


def near_groups(rows: DataFrame, distance: int = 4) -> DataFrame:
    """``rows``: (doc_id, fp).  One row a fingerprint: fp, label (the component's smallest fp), component_id."""
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    found = materialize(links(reps.select("fp"), distance), "links")
    labels = weak_components(found)
    placed = reps.join(labels, reps["fp"] == labels["id"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    placed = materialize(placed, "placed")
    least = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    return materialize(placed.join(least, "label").select("fp", "label", "component_id"), "groups")


def simhash_groups(docs: DataFrame, distance: int = 4) -> DataFrame:
    """Returns doc_id, fingerprint (16 lowercase hex digits), component_id for every row of ``docs``.

    Documents link if their fingerprints differ in at most ``distance`` bits; component_id is the smallest
    doc_id reachable by links.

    Defined cases: a text without words (or null) has fingerprint zero and links like any other; repeated rows
    share a component; a null doc_id is never the smallest (component_id is null only if the whole component
    has none); an empty table gives no rows; other columns are not read.  A text is never cut: one of any length is
    fingerprinted by itself, which takes some 200 bytes of memory a word in a Python worker.
    """
    rows = materialize(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    groups = near_groups(rows, distance)
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``labelled``: (doc_id, h, label), a row for each of ``docs``, h its text's xxhash64.  The row of each label's smallest doc_id; all columns stay.

    Texts move once and are not sorted, but for rows that repeat both doc_id and text, of which any one stays.
    """
    last = F.lit((1 << 63) - 1).cast("long")
    once = labelled.groupBy("doc_id", "h").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("i"), "doc_id", "h", "n")).alias("k")
    keep = materialize(once.groupBy("label").agg(first).select(F.col("k.doc_id").alias("__id"), F.col("k.h").alias("__h"), F.col("k.n").alias("__n")), "keep")
    rows = docs.select(packed(docs), F.xxhash64("text").alias("__th"))
    same = F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))
    alone = rows.join(keep.where("__n = 1"), same, "left_semi").select("__row")
    again = rows.join(keep.where("__n > 1"), same).withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__h").orderBy(F.lit(0)))).where("__nth = 1")
    return unpacked(alone.unionAll(again.select("__row")), docs.columns)


def keep_one(docs: DataFrame, distance: int = 4) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest doc_id.  All columns stay.

    Defined cases: those of :func:`simhash_groups`; a component without any doc_id keeps one of its rows.
    """
    rows = materialize(docs.select("doc_id", fingerprint("text").alias("fp"), F.xxhash64("text").alias("h")), "fingerprints")
    return keep_first(docs, rows.join(near_groups(rows.select("doc_id", "fp"), distance), "fp"))
