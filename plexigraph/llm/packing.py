"""Best-fit packing (8): linear grouping over the histogram of lengths.

Lengths are whole numbers up to the capacity, so a histogram of at most that many counts describes any
corpus.  Only the histogram comes to the driver.  *Large* lengths are cut into groups of equal cardinality,
each rounded up to its longest; the linear program of the fewest sequences over all configurations of the few
rounded sizes is solved and rounded down; the actual lengths then take the places of the rounded ones; and what
is left and the small lengths go, longest first, to the bin that they fit best.  The plan is a list of runs
(so many sequences of one composition).  Pieces find their place by their rank within their length, from
distributed prefix sums.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.llm.common import slices, text_bytes
from plexigraph.llm.words import encoder
from plexigraph.plans.prefix import prefix_sums
from plexigraph.session import materialize

CAPACITY = 2048
#: Tried in turn: lengths over capacity / x are large, and make so many groups; rooms under ROOM of the capacity are hard to fill.
GROUPINGS = ((8, 48), (3, 32), (2, 24), (1, 1))
ROOM = 1 / 16
PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pieces(tokenizer: str, capacity: int = CAPACITY):
    """A column function: text to its pieces.  ``tokenizer``: the path of the vocabulary file on every worker."""

    @arrow_udf(PIECES)
    def cut(text: pa.Array) -> pa.Array:
        encode = encoder(tokenizer)
        offsets, rows = [0], []
        for begin, end in slices(text, 4 << 20):
            for b in text_bytes(text.slice(begin, end - begin)):
                ids = np.append(encode(b), 0).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    own = ids[s : s + capacity]
                    rows.append((k, s, len(own), zlib.crc32(own.tobytes())))
                offsets.append(len(rows))
        a = np.array(rows, np.int64).reshape(-1, 4)
        fields = [pa.array(a[:, 0].astype(np.int32)), pa.array(a[:, 1]), pa.array(a[:, 2]), pa.array(a[:, 3])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["piece", "start", "length", "ids_crc32"]))

    return cut


class Run:
    """``n`` sequences of one composition; parts: (length, first rank of that length)."""

    __slots__ = ("n", "free", "parts")

    def __init__(self, n: int, free: int, parts: list[tuple[int, int]]) -> None:
        self.n, self.free, self.parts = n, free, parts

    def split(self, k: int) -> Run:
        """Takes the first k sequences off."""
        head = Run(k, self.free, list(self.parts))
        self.n -= k
        self.parts = [(length, rank + k) for length, rank in self.parts]
        return head

    def put(self, length: int, rank: int, times: int) -> None:
        """``times`` more of one length in each sequence."""
        self.parts += [(length, rank + i * self.n) for i in range(times)]
        self.free -= length * times


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The worthiest configuration: (its worth, how many of each size)."""
    use = np.flatnonzero(worth > 1e-12)
    count = np.zeros(len(sizes), np.int64)
    if not len(use):
        return 0.0, count
    s, w = sizes[use], worth[use]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(s, kind="stable")
    s, w, use = s[order], w[order], use[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(int(s[0]), capacity + 1):
        value = best[c - s[: fits[c]]] + w[: fits[c]]
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-15:
            best[c], pick[c] = value[i], i
        else:
            best[c] = best[c - 1]
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[use[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), count


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) with how often each is used, never more than the counts.

    The linear program of the fewest sequences over all configurations, by column generation: the basis holds
    one configuration a size, the prices of the sizes tell the worthiest configuration, which enters for the one
    that runs out first.  What is left when the solution is rounded down goes by best fit later, so any basis
    gives a whole plan; ``rounds`` only bounds how far it is improved.
    """
    size, need = np.array(sizes, np.int64), np.array(counts, np.float64)
    k = len(sizes)
    basis = np.diag((capacity // size).astype(np.float64))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = knapsack(size, price, capacity)
        if worth <= 1 + 1e-9:
            break
        used, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column.astype(np.float64))
        able = np.flatnonzero(step > 1e-9)
        out = able[np.argmin(np.maximum(used[able], 0) / step[able])]
        changed = basis.copy()
        changed[:, out] = column
        if np.linalg.cond(changed) > 1e10:
            break
        basis = changed
    left, found = np.array(counts, np.int64), []
    for j, x in enumerate(np.linalg.solve(basis, need)):
        column = basis[:, j].round().astype(np.int64)
        times = int(min([math.floor(x + 1e-6), *(left[column > 0] // column[column > 0])]))
        if times > 0:
            left -= times * column
            found.append((column, times))
    return found


def fewest(total: int, counts: dict[int, int], capacity: int) -> int:
    """No plan takes fewer sequences: by tokens, and by the pieces of over half the capacity."""
    return max(-(-total // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that hold every piece of the histogram exactly once: the best of a few groupings.

    They differ in which lengths count as large and in the number of groups.  The last one has no large lengths
    and so is best fit of falling lengths, which keeps the plan from being worse than that.  The first plan that
    reaches the lower bound ends the search.
    """
    least = fewest(sum(x * n for x, n in histogram.items()), histogram, capacity)
    best: list[Run] = []
    for small, n_groups in GROUPINGS:
        runs = grouped(histogram, capacity, n_groups, small)
        if not best or sum(r.n for r in runs) < sum(r.n for r in best):
            best = runs
        if sum(r.n for r in best) <= least:
            break
    return best


def grouped(histogram: dict[int, int], capacity: int, n_groups: int, small: int) -> list[Run]:
    """One plan: lengths of over ``capacity`` / ``small`` are large and make ``n_groups`` groups."""
    large = {k: v for k, v in sorted(histogram.items()) if k * small > capacity}
    total, usable = sum(large.values()), int(capacity * ROOM)
    groups: list[list[list[int]]] = []  # each: [length, first rank, count], shortest first
    each, room = -(-total // n_groups) if total else 1, 0
    for length, n in large.items():
        rank = 0
        while rank < n:
            if room <= 0:
                groups.append([])
                room = each
            k = min(room, n - rank)
            groups[-1].append([length, rank, k])
            rank, room = rank + k, room - k
    # a length may close one group and fill others: those of one rounded size are one size of the program
    groups = [[x for g in same for x in g] for _, same in itertools.groupby(groups[::-1], key=lambda g: g[-1][0])]
    sizes = [g[-1][0] for g in groups]
    runs: list[Run] = []
    for config, times in configurations(sizes, [sum(x[2] for x in g) for g in groups], capacity) if sizes else []:
        # actual lengths for rounded ones: the longest left of each group, in stretches over which nothing changes
        lanes = {}
        for i, j in [(i, j) for i, c in enumerate(config.tolist()) for j in range(c)]:
            lane, want = [], times
            while want:
                top = groups[i][-1]
                k = min(want, top[2])
                lane.append((top[0], top[1] + top[2] - k, k))
                top[2] -= k
                want -= k
                if not top[2]:
                    groups[i].pop()
            lanes[i, j] = lane
        cuts = sorted({c for lane in lanes.values() for c in np.cumsum([x[2] for x in lane]).tolist()})
        at = {key: [0, 0] for key in lanes}
        done = 0
        for cut in cuts:
            run = Run(cut - done, capacity, [])
            for key, lane in lanes.items():
                k, used = at[key]
                run.put(lane[k][0], lane[k][1] + used, 1)
                used += run.n
                at[key] = [k + 1, 0] if used == lane[k][2] else [k, used]
            runs.append(run)
            done = cut
    # sequences whose room is too little for most of the small lengths to fill it are dissolved again
    open_ = [r for r in runs if r.free == 0 or r.free >= usable]
    loose = [(length, rank, r.n) for r in runs if 0 < r.free < usable for length, rank in r.parts]
    runs = open_
    # what the rounded-down program leaves, and the small lengths: longest first, each to the bin with the least room that still takes it
    rest = sorted(loose + [(length, first, n) for g in groups for length, first, n in g] + [(k, 0, v) for k, v in histogram.items() if k * small <= capacity], reverse=True)
    best_fit(runs, rest, capacity)
    return [r for r in runs if r.n]


def best_fit(runs: list[Run], rest: list[tuple[int, int, int]], capacity: int) -> None:
    """Adds ``rest`` (length, first rank, count; longest first) to the runs, whole stretches at a time."""
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def keep(run: Run) -> None:
        if run.free not in by_room:
            by_room[run.free] = []
            bisect.insort(rooms, run.free)
        by_room[run.free].append(run)

    for r in runs:
        keep(r)
    for length, rank, n in rest:
        upto = rank + n
        while rank < upto:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                run = Run(-(-(upto - rank) // (capacity // length)), capacity, [])
                runs.append(run)
            else:
                run = by_room[rooms[k]].pop()
                if not by_room[rooms[k]]:
                    del by_room[rooms[k]]
                    rooms.pop(k)
            times = min(run.free // length, upto - rank)
            full = (upto - rank) // times
            if full < run.n:
                head = run.split(full)
                runs.append(head)
                keep(run)
                run = head
            run.put(length, rank, times)
            rank += run.n * times
            keep(run)


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: sorted first ranks, and the first sequence and the offset of each stretch of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for r in runs:
        offset = 0
        for length, rank in r.parts:
            out.setdefault(length, []).append((rank, first, offset))
            offset += length
        first += r.n
    return {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in out.items()}


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows``: doc_id, piece, length, ids_crc32 and others of any name but these two: adds sequence_id and offset.

    The plan is small whatever the corpus: its runs number at most a few for each pair of a length and a
    configuration.  It travels with the tasks' code.

    Defined cases: lengths are from 1 to ``capacity``, not null; repeated rows take places of their own, and which
    of them takes which is open; an empty table gives no rows.
    """
    counts = rows.groupBy("length").count().collect()  # at most `capacity` rows
    where = places(plan({int(r["length"]): r["count"] for r in counts}, capacity))
    ranked = prefix_sums(rows, F.col("length").cast("long"), F.lit(1), [F.col("ids_crc32"), F.col("doc_id"), F.col("piece")], "pack")
    ranked = ranked.select("__row", F.col("__row.length").cast("long").alias("__length"), "__before")
    schema = T.StructType([ranked.schema["__row"], T.StructField("__seq", T.LongType()), T.StructField("__off", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                ranks, first, offset = where[x]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                seq[at], off[at] = first[k] + rank[at] - ranks[k], offset[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seq), pa.array(off)], names=["__row", "__seq", "__off"])

    placed = ranked.mapInArrow(place, schema)
    return placed.select(*[F.col(f"__row.`{c}`").alias(c) for c in rows.columns], F.col("__seq").alias("sequence_id"), F.col("__off").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs every document.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null text is empty and makes one piece of the end id alone; repeated rows make pieces of
    their own; a null doc_id is kept; an empty table gives no rows; other columns are not read; a text of any
    length is tokenised whole by one task and cut into as many pieces as it takes.
    """
    cut = pieces(tokenizer, capacity)
    rows = docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")
    return pack(materialize(rows, "pieces"), capacity)
