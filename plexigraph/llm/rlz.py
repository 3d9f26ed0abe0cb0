"""Substring dedup (6): relative Lempel-Ziv parsing of word sequences.

*Blocks.*  Phrases of the corpus (see ``phrases``) are dealt out by their trigger's hash; those of a bucket form
one reference block, with an index: the suffix array of the block's words and the longest common prefixes of
neighbours in it.  Together the blocks hold every 35-word window of the corpus once for each occurrence.
*Factors.*  Each phrase is factored greedily against its block: the factor at a word is the longest stretch from
there that the block also holds at another place, and the next factor begins behind it.  A document needs no other
blocks, as the triggers tell where a match of 35 words can be.  Equal phrases are one factor without an index.
*Boundaries.*  A match may cross the boundary of two factors, or begin inside a short one.  So every word less
than 35 before a boundary is looked up as well.  Matches of 35 words or more are duplicate spans.

A window counts as repeated if its word sequence starts at two places at least, the same document
included; all its places lose it.  Windows are compared as words, never by hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.llm.common import chunks, text_bytes
from plexigraph.llm.phrases import BLOBS, NULL_ID, blobs, bucket_count, common_grams, common_table, cut, flat, merged, mixed64, ordered, own_spans, pack, settle, span_table, spread, unpack

SPAN = 35
GRAM = 6
HALF = (SPAN - GRAM + 1) // 2
CHUNK = 8 << 20
#: content, its length in bytes, windows, words before the trigger, places (1, or 2 for more), row of a single place, its position, rows' ids and hashes
_KINDS = [None, "<u4", "u1", "u1", "u1", "<u4", "<u4", "<i8", "<i8"]


def _grams(word: np.ndarray) -> np.ndarray:
    """Hash of the words from each on, by the words' hashes; the last few run on at the first."""
    gram = word
    for k in range(1, GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + np.roll(word, -k)
    return mixed64(gram)


def _all_grams(texts: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    every = b" ".join(texts).split()
    number = {w: xxh64_intdigest(w) for w in set(every)}
    return _grams(np.fromiter(map(number.__getitem__, every), np.uint64, len(every)))


def _parse(texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, n_buckets: int, table: np.ndarray) -> list[tuple]:
    """Blob rows of some texts: a phrase once; spans of phrases that occur twice here are settled at once."""
    from xxhash import xxh64_intdigest

    number: dict[bytes, int] = {}
    lists = [b.split() for b in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    every = [w for x in lists for w in x]
    for w in every:
        if w not in number:
            number[w] = xxh64_intdigest(w)
    word = np.fromiter(map(number.__getitem__, every), np.uint64, len(every))
    del number
    length = np.fromiter(map(len, every), np.int64, len(every)) + 1
    data = b" ".join(every) + b" "
    del every, lists
    ends = np.cumsum(length)
    at = ends - length
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    gram = ordered(_grams(word), table)
    first, last, trigger = cut(gram, doc, SPAN, GRAM)
    if not len(first):
        return []
    where = (gram[trigger] % np.uint64(n_buckets)).astype(np.int64)
    lo, hi = at[first], ends[last + SPAN - 1] - 1
    seen: dict[bytes, int] = {}
    entry = np.fromiter((seen.setdefault(data[s:e], i) for i, (s, e) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))), np.int64, len(first))
    del seen
    places = np.bincount(entry, minlength=len(first))
    row = doc[first]
    pos = first - begin[row]
    rows = []
    twice = np.flatnonzero(places[entry] > 1)
    if len(twice):
        twice = twice[np.argsort(row[twice], kind="stable")]
        for mine in np.split(twice, np.flatnonzero(np.diff(row[twice])) + 1):
            r = int(row[mine[0]])
            x = np.stack([pos[mine], pos[mine] + last[mine] - first[mine] + SPAN], 1)
            rows.append((spread(ids[r], hashes[r], n_buckets), None if ids[r] == NULL_ID else int(ids[r]), int(hashes[r]), x.astype("<i8").tobytes()))
    heads = np.flatnonzero(entry == np.arange(len(first)))
    heads = heads[np.argsort(where[heads], kind="stable")]
    squeeze = zstandard.ZstdCompressor(level=3)
    for mine in np.split(heads, np.flatnonzero(np.diff(where[heads])) + 1):
        content = b"".join(data[s:e] for s, e in zip(lo[mine].tolist(), hi[mine].tolist(), strict=True))
        docs, of = np.unique(row[mine], return_inverse=True)
        arrays = [
            content, (hi[mine] - lo[mine]).astype("<u4"), (last[mine] - first[mine] + 1).astype("u1"), (trigger[mine] - first[mine]).astype("u1"),
            np.minimum(places[mine], 2).astype("u1"), of.astype("<u4"), pos[mine].astype("<u4"), ids[docs].astype("<i8"), hashes[docs].astype("<i8"),
        ]
        rows.append((int(where[mine[0]]), None, None, pack(arrays, squeeze)))
    return rows


class Block:
    """The index of some phrases: ranks of all stretches of 1, 2, 4 ... words, and so the order of all suffixes."""

    def __init__(self, phrases: list[list[bytes]]) -> None:
        number: dict[bytes, int] = {}
        rank = np.array([number.setdefault(w, len(number)) for x in phrases for w in x], np.int64)
        size = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.begin = np.cumsum(size) - size
        place = np.arange(len(rank))
        self.left = np.repeat(self.begin + size, size) - place  # words to the phrase's end
        self.ranks, span = [rank], 1
        while span < size.max():  # suffixes that end early come first
            after = np.where(self.left > span, rank[np.minimum(place + span, len(rank) - 1)], -1)
            rank = np.unique(rank * np.int64(len(rank) + 1) + after + 1, return_inverse=True)[1]
            self.ranks.append(rank)
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable")

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the suffixes at x and y share, by stretches from the longest down."""
        most, same = np.minimum(self.left[x], self.left[y]), np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            at = np.flatnonzero(same + (1 << k) <= most)
            rank = self.ranks[k]
            at = at[rank[x[at] + same[at]] == rank[y[at] + same[at]]]
            same[at] += 1 << k
        return same

    def longest(self) -> np.ndarray:
        """For each word, how far the block holds the same words at another place: more than one neighbour in order can't share."""
        near = self._common(self.suffixes[:-1], self.suffixes[1:])
        out = np.zeros(len(self.suffixes), np.int64)
        out[self.suffixes] = np.maximum(np.append(0, near), np.append(near, 0))
        return out


def factors(longest: list[int], least: int = SPAN) -> list[tuple[int, int]]:
    """Matches of ``least`` words or more of one phrase, as (start, end), by greedy factors and a look at their boundaries."""
    out: list[tuple[int, int]] = []
    at, n = 0, len(longest)
    while at < n:
        end = min(n, at + max(1, longest[at]))
        if longest[at] >= least:
            out.append((at, end))
        for j in range(max(at + 1, end - least + 1), end):  # what crosses the boundary
            if longest[j] >= least:
                out.append((j, j + longest[j]))
        at = end
    return out


def _settle(t: pa.Table) -> pa.Table:
    """One bucket: equal phrases; phrases that agree to one side of the trigger make the block and are factored."""
    out = own_spans(t.filter(pc.is_valid(t["h"])))
    out.append(span_table(*[np.zeros(0, np.int64)] * 4))
    number: dict[bytes, int] = {}
    content: list[bytes] = []
    windows, trigger, places = [], [], []
    singles = []
    for blob in t.filter(pc.is_null(t["h"]))["payload"].to_pylist():
        data, size, wins, trig, n, of, pos, docs, hs = unpack(blob, _KINDS)
        s, own = 0, np.empty(len(size), np.int64)
        for i, (e, k) in enumerate(zip(np.cumsum(size, dtype=np.int64).tolist(), n.tolist(), strict=True)):
            c = data[s:e]
            s = e
            own[i] = j = number.setdefault(c, len(content))
            if j == len(content):
                content.append(c)
                windows.append(int(wins[i]))
                trigger.append(int(trig[i]))
                places.append(k)
            else:
                places[j] += k
        one = np.flatnonzero(n == 1)
        singles.append((own[one], docs[of[one]], hs[of[one]], pos[one].astype(np.int64)))
    del number
    if not content:
        return pa.concat_tables(out)
    entry, doc, h, pos = (np.concatenate(x) for x in zip(*singles, strict=True))
    count, width = np.array(places, np.int64), np.array(windows, np.int64)
    whole = np.flatnonzero(count[entry] > 1)
    out.append(span_table(doc[whole], h[whole], pos[whole], pos[whole] + width[entry[whole]] + SPAN - 1))
    met = np.zeros(len(content), bool)
    left: dict[bytes, int] = {}
    right: dict[bytes, int] = {}
    for j, (c, a, w) in enumerate(zip(content, trigger, windows, strict=True)):
        # the phrase's words to the trigger's left and right: cut from either end, never split whole
        if a - w + 1 < HALF:
            tail = c.split(b" ", a)[-1].split(b" ", SPAN - HALF + 1)[: SPAN - HALF + 1]
            if (i := right.setdefault(b" ".join(tail), j)) != j:
                met[i] = met[j] = True
        if a >= HALF:
            head = c.split(b" ", a + GRAM)[a - HALF : a + GRAM]
            if (i := left.setdefault(b" ".join(head), j)) != j:
                met[i] = met[j] = True
    del left, right
    some = np.flatnonzero(met)
    if len(some):
        block = Block([content[j].split(b" ") for j in some.tolist()])
        longest = block.longest()
        # only phrases with a long match are factored
        owner = np.repeat(np.arange(len(some)), width[some] + SPAN - 1)
        held = np.unique(owner[longest >= SPAN])
        of, s, e = [], [], []
        for k in held.tolist():
            lo = int(block.begin[k])
            for x, y in merged(factors(longest[lo : lo + int(width[some[k]]) + SPAN - 1].tolist())):
                of.append(k)
                s.append(x)
                e.append(y)
        if of:
            of, s, e = (np.array(x, np.int64) for x in (of, s, e))
            count_of = np.bincount(of, minlength=len(some))
            slot = np.full(len(content), -1)
            slot[some] = np.arange(len(some))
            mine = np.flatnonzero((count[entry] == 1) & (slot[entry] >= 0))
            mine = mine[count_of[slot[entry[mine]]] > 0]
            times = count_of[slot[entry[mine]]]
            pick = flat((np.cumsum(count_of) - count_of)[slot[entry[mine]]], times)
            again = np.repeat(mine, times)
            out.append(span_table(doc[again], h[again], pos[again] + s[pick], pos[again] + e[pick]))
    return pa.concat_tables(out)


REMOVED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@arrow_udf(REMOVED)
def _remove(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for b, x in zip(text_bytes(text), spans.to_pylist(), strict=True):
        words, kept, at, gone = b.split(), [], 0, 0
        for s, e in merged((y["s"], y["e"]) for y in x or ()):
            kept += words[at:s]
            at, gone = e, gone + e - s
        kept += words[at:]
        rows.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], [f.name for f in REMOVED.fields])


def spans_of(docs: DataFrame) -> DataFrame:
    """Spans of words in repeated windows: __d (doc_id), __dh (hash of the text), spans."""
    n_buckets = bucket_count(docs)
    common = common_grams(docs, _all_grams)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common_table(common)
        for b in chunks(batches, "text", CHUNK):
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            yield blobs(_parse(text_bytes(b.column(1)), ids, b.column(2).to_numpy(zero_copy_only=False), n_buckets, table))

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where(F.octet_length("text") >= 2 * SPAN - 1)
    return settle(narrow.mapInArrow(parse, BLOBS), _settle)


def word_span_dedup(docs: DataFrame) -> DataFrame:
    """Removes each word covered by a 35-word window whose word sequence also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) for every row.

    Defined cases: a null text has no words; texts under 35 words lose nothing; windows never cross documents,
    may overlap, and are judged on the input; rows repeated (same doc_id and text too) count as places of
    their own, so each loses what the other holds; an empty table gives no rows; other columns are not read.  A text
    is never cut: one of any length is parsed by itself, which takes some 250 bytes of memory a word in a Python worker.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    out = rows.join(spans_of(docs), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__dh")), "left")
    return out.select("doc_id", _remove("text", "spans").alias("r")).select("doc_id", "r.*")
