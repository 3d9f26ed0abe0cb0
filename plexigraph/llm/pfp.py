"""Suffix-array dedup (2): prefix-free parsing of the corpus, by bytes.

*Parse.*  Rolling-hash triggers cut every document into overlapping phrases (see ``phrases``): the windows of 50
bytes that share a trigger.  Each task keeps the dictionary of its own phrases: of a phrase that several of its
documents hold, only the smallest document travels, the others are settled at once.  Phrases meet in the bucket
of their trigger; equal ones become one with the smallest document that holds it, and every occurrence in a larger
document is settled whole.  A phrase shares a window with another only if they agree on the 29 or 30 bytes to one
side of the trigger; those that agree with none are done.
*Dictionary and parse.*  What remains is cut at the trigger: the text up to its end is a word of the dictionary,
the text from its start on is what the parse continues with.  The dictionary's suffixes are sorted, and so are the
continuations, to the depth of a window, each with the longest common prefixes of neighbours.
*Corpus order.*  A window is a suffix of the dictionary, whose last bytes are the trigger, and then a continuation.
Sorting pairs of ranks puts the windows of a bucket in order without comparing their texts again: neighbours with
one suffix are the same window if their continuations share as many bytes as the window still has.  The smallest
document of such a run settles it.

The order is whole within a trigger's bucket and to the depth of a window; no order across buckets is made, as
equal windows always share a bucket.
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
from plexigraph.llm.phrases import BLOBS, NULL_ID, blobs, bucket_count, common_grams, common_table, cut, flat, merged, mixed64, ordered, own_spans, pack, runs_of, settle, span_table, spread, unpack

SPAN = 50
GRAM = 8
#: Text whose phrases share one dictionary and one set of blobs, and how much of it is cut at a time.
CHUNK = 12 << 20
SEGMENT = 1 << 20
#: phrases' bytes; windows - 1; bytes before the trigger; of each place: phrase and row (as differences), position; rows' ids and hashes
_KINDS = [None, "u1", "u1", "<i4", "<i4", "u1", "<i8", "<i8"]


def _grams(padded: np.ndarray, size: int) -> np.ndarray:
    """Hash of the eight bytes at each of the first ``size`` places."""
    return mixed64(np.ndarray((size,), "<u8", padded, strides=(1,)).astype(np.uint64)) if size else np.zeros(0, np.uint64)


def _all_grams(texts: list[bytes]) -> np.ndarray:
    data = b"".join(texts)
    return _grams(np.frombuffer(data, np.uint8), max(0, len(data) - GRAM + 1))


def _triggers(parts: list[bytes], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, trigger, trigger's hash) of the parts' phrases, by byte of all parts together."""
    at, held, size = 0, [], 0
    for i, p in enumerate(parts):
        held.append(p)
        size += len(p)
        if size < 2 << 20 and i + 1 < len(parts):
            continue
        doc = np.repeat(np.arange(len(held), dtype=np.int32), np.fromiter(map(len, held), np.int64, len(held)))
        padded = np.frombuffer(b"".join(held) + bytes(GRAM), np.uint8)
        gram = ordered(_grams(padded, size), table)
        first, last, trigger = cut(gram, doc, SPAN, GRAM)
        yield first + at, last + at, trigger + at, gram[trigger]
        at, held, size = at + size, [], 0


def _parse(texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, n_buckets: int, table: np.ndarray) -> list[tuple]:
    """Blob rows of some texts: a phrase once, with its smallest document; spans that are settled here."""
    order = np.argsort(ids, kind="stable")
    parts, row, base = [], [], []
    for r in order.tolist():
        b = texts[r]
        for s in range(0, max(1, len(b) - SPAN + 1), SEGMENT):  # a long text in segments that share no window
            parts.append(b[s : s + SEGMENT + SPAN - 1])
            row.append(r)
            base.append(s)
    data = b"".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(lengths) - lengths
    first, last, trigger, gram = (np.concatenate(x) for x in zip(*_triggers(parts, table), strict=True))
    part = np.searchsorted(begin, first, "right") - 1
    where = (gram % np.uint64(n_buckets)).astype(np.int64)
    # the dictionary of this chunk, in order of doc_id: the first to have a phrase is the smallest
    seen: dict[bytes, int] = {}
    entry = np.fromiter((seen.setdefault(data[s : e + SPAN], i) for i, (s, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True))), np.int64, len(first))
    at_row = np.array(row, np.int64)[part] if len(part) else np.zeros(0, np.int64)
    pos = first - begin[part] + np.array(base, np.int64)[part] if len(part) else at_row
    own_id = ids[at_row]
    later = own_id > own_id[entry]
    out = []
    done = np.flatnonzero(later)
    if len(done):
        by = done[np.argsort(at_row[done], kind="stable")]
        for mine in np.split(by, np.flatnonzero(np.diff(at_row[by])) + 1):
            out.append((int(at_row[mine[0]]), np.stack([pos[mine], pos[mine] + last[mine] - first[mine] + SPAN], 1)))
    rows = [(spread(ids[r], hashes[r], n_buckets), None if ids[r] == NULL_ID else int(ids[r]), int(hashes[r]), x.astype("<i8").tobytes()) for r, x in out]
    keep = np.flatnonzero(~later)
    keep = keep[np.lexsort((keep, entry[keep], where[keep]))]
    squeeze = zstandard.ZstdCompressor(level=3)
    for mine in np.split(keep, np.flatnonzero(np.diff(where[keep])) + 1) if len(keep) else []:
        heads, which = np.unique(entry[mine], return_inverse=True)
        content = b"".join(data[s:e] for s, e in zip(first[heads].tolist(), (last[heads] + SPAN).tolist(), strict=True))
        docs, of = np.unique(at_row[mine], return_inverse=True)
        arrays = [
            content, (last[heads] - first[heads]).astype("u1"), (trigger[heads] - first[heads]).astype("u1"),
            np.diff(which, prepend=0).astype("<i4"), np.diff(of, prepend=0).astype("<i4"), np.ascontiguousarray(pos[mine].astype("<u4").view("u1").reshape(-1, 4).T),
            ids[docs].astype("<i8"), hashes[docs].astype("<i8"),
        ]
        rows.append((int(where[mine[0]]), None, None, pack(arrays, squeeze)))
    return rows


def _sorted_suffixes(texts: list[bytes], of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (text, start) of up to SPAN bytes in byte order: (order, how many bytes each shares with the one before)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(length) - length
    buffer = np.frombuffer(b"".join(texts) + bytes(SPAN + 8), np.uint8)
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    size, at = length[of] - start, begin[of] + start
    # eight bytes at a time; what is behind the end counts as zero, and the size tells it from zeros of the text
    mask = np.array([0, *((1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9))], np.uint64)
    keys = [words[at + o].astype(np.uint64) & mask[np.clip(size - o, 0, 8)] for o in range(0, SPAN, 8)]
    order = np.lexsort([size, *keys[::-1]])
    shared, alive = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in keys:
        s = k[order]
        differ = s[alive] ^ s[alive - 1]
        # equal bytes from the left: those above the highest bit that differs
        top = np.frexp((differ >> np.uint64(32)).astype(np.float64))[1]
        low = np.frexp((differ & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        bits = np.where(top > 0, 32 + top, low)
        shared[alive] += (64 - bits) // 8
        alive = alive[bits == 0]
    sizes = size[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    return order, shared


def _least_between(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(shared[a + 1 .. b]) for a < b."""
    table, step = [shared], 1
    while 2 * step <= len(shared):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][a[at] + 1], table[k][b[at] - (1 << k) + 1])
    return out


def _distinct(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    return list(number), of


def corpus_order(phrases: list[bytes], trigger: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the phrases in one order: (order, is it the same text as the one before, phrase and start of each window).

    A phrase has ``windows`` windows and its trigger at ``trigger``, which is in all of them.
    """
    words, word = _distinct([p[: a + GRAM] for p, a in zip(phrases, trigger.tolist(), strict=True)])
    rests, rest = _distinct([p[a:] for p, a in zip(phrases, trigger.tolist(), strict=True)])
    # the dictionary's suffixes that are long enough to hold the trigger
    starts = np.fromiter((len(w) - GRAM + 1 for w in words), np.int64, len(words))
    first = np.cumsum(starts) - starts
    of, at = np.repeat(np.arange(len(words)), starts), flat(np.zeros(len(words), np.int64), starts)
    order, shared = _sorted_suffixes(words, of, at)
    size = (starts[of] - at)[order]
    new = np.append(True, (shared[1:] < size[1:] + GRAM - 1) | (size[1:] != size[:-1]))
    suffix_rank = np.empty(len(order), np.int64)
    suffix_rank[order] = np.cumsum(new) - 1
    # the continuations
    rest_order, rest_shared = _sorted_suffixes(rests, np.arange(len(rests)), np.zeros(len(rests), np.int64))
    rest_rank = np.empty(len(rests), np.int64)
    rest_rank[rest_order] = np.arange(len(rests))
    # windows: a suffix and a continuation
    owner, start = np.repeat(np.arange(len(phrases)), windows), flat(np.zeros(len(windows), np.int64), windows)
    suffix, then = suffix_rank[first[word[owner]] + start], rest_rank[rest[owner]]
    order = np.lexsort((then, suffix))
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(suffix[order[1:]] == suffix[order[:-1]]) + 1
    x, y = then[order[near - 1]], then[order[near]]
    deep = np.full(len(near), SPAN)
    apart = np.flatnonzero(x != y)
    deep[apart] = _least_between(rest_shared, x[apart], y[apart])
    same[near] = deep >= SPAN - (trigger[owner] - start)[order[near]]
    return order, same, owner, start


def _settle(t: pa.Table) -> pa.Table:
    """One bucket: equal phrases, sieve, corpus order, spans."""
    passed = t.filter(pc.is_valid(t["h"]))
    out = own_spans(passed)
    number: dict[bytes, int] = {}
    content: list[bytes] = []
    windows, trigger, least = [], [], []
    occ_entry, occ_doc, occ_h, occ_pos = [], [], [], []
    for blob in t.filter(pc.is_null(t["h"]))["payload"].to_pylist():
        data, more, trig, which, of, pos, docs, hs = unpack(blob, _KINDS)
        which, of = np.cumsum(which, dtype=np.int64), np.cumsum(of, dtype=np.int64)
        pos = np.ascontiguousarray(pos.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        ids = docs[of][np.unique(which, return_index=True)[1]]
        ends = np.cumsum(more.astype(np.int64) + SPAN)
        own, s = np.empty(len(ends), np.int64), 0
        for i, e in enumerate(ends.tolist()):
            c = data[s:e]
            s = e
            j = number.setdefault(c, len(content))
            if j == len(content):
                content.append(c)
                windows.append(int(more[i]) + 1)
                trigger.append(int(trig[i]))
                least.append(int(ids[i]))
            elif ids[i] < least[j]:
                least[j] = int(ids[i])
            own[i] = j
        occ_entry.append(own[which])
        occ_doc.append(docs[of])
        occ_h.append(hs[of])
        occ_pos.append(pos)
    if not content:
        return pa.concat_tables(out) if out else SPAN_EMPTY
    del number
    entry, doc, h, pos = map(np.concatenate, (occ_entry, occ_doc, occ_h, occ_pos))
    least_a, windows_a = np.array(least, np.int64), np.array(windows, np.int64)
    size = windows_a + SPAN - 1
    whole = np.flatnonzero(doc > least_a[entry])
    out.append(span_table(doc[whole], h[whole], pos[whole], pos[whole] + size[entry[whole]]))
    # entries that agree with another on one side of the trigger
    half = (SPAN - GRAM) // 2
    met = np.zeros(len(content), bool)
    left: dict[bytes, int] = {}
    right: dict[bytes, int] = {}
    for j, (c, a, w) in enumerate(zip(content, trigger, windows, strict=True)):
        if a - w + 1 <= half and (i := right.setdefault(c[a : a + GRAM + half], j)) != j:
            met[i] = met[j] = True
        if a > half and (i := left.setdefault(c[a - half - 1 : a + GRAM], j)) != j:
            met[i] = met[j] = True
    del left, right
    some = np.flatnonzero(met)
    if len(some):
        order, same, owner, start = corpus_order([content[j] for j in some.tolist()], np.array(trigger, np.int64)[some], windows_a[some])
        heads = np.flatnonzero(~same)
        low = np.minimum.reduceat(least_a[some][owner[order]], heads)
        smallest = np.empty(len(order), np.int64)
        smallest[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
        gone = smallest < least_a[some][owner]
        a, b = runs_of(gone, owner)
        if len(a):
            # the runs of each entry, given to its occurrences in the entry's smallest document
            run_entry, run_s, run_e = owner[a], start[a], start[b] + SPAN
            count = np.bincount(run_entry, minlength=len(some))
            slot = np.full(len(content), -1)
            slot[some] = np.arange(len(some))
            mine = np.flatnonzero((doc == least_a[entry]) & (slot[entry] >= 0))
            mine = mine[count[slot[entry[mine]]] > 0]
            times = count[slot[entry[mine]]]
            pick = flat((np.cumsum(count) - count)[slot[entry[mine]]], times)
            again = np.repeat(mine, times)
            out.append(span_table(doc[again], h[again], pos[again] + run_s[pick], pos[again] + run_e[pick]))
    return pa.concat_tables(out)


SPAN_EMPTY = span_table(*[np.zeros(0, np.int64)] * 4)
REMOVED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@arrow_udf(REMOVED)
def _remove(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for b, x in zip(text_bytes(text), spans.to_pylist(), strict=True):
        runs, at, digest = merged((y["s"], y["e"]) for y in x or ()), 0, hashlib.sha256()
        for s, e in runs:
            digest.update(b[at:s])
            at = e
        digest.update(b[at:])
        rows.append((len(b), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [f.name for f in REMOVED.fields])


def spans_of(docs: DataFrame) -> DataFrame:
    """Spans that repeat smaller documents: __d (doc_id), __dh (hash of the text), spans."""
    n_buckets = bucket_count(docs)
    common = common_grams(docs, _all_grams)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common_table(common)
        for b in chunks(batches, "text", CHUNK):
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            yield blobs(_parse(text_bytes(b.column(1)), ids, b.column(2).to_numpy(zero_copy_only=False), n_buckets, table))

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where(F.octet_length("text") >= SPAN)
    return settle(narrow.mapInArrow(parse, BLOBS), _settle)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Removes each byte covered by a 50-byte string that also starts in a document of a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 for every row.

    Defined cases: a null text is empty; texts under 50 bytes lose nothing; matches never cross documents, may
    overlap, and are judged on the input; rows that share a doc_id are never smaller than each other; a null
    doc_id counts as larger than any other; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    spans = spans_of(docs)
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__dh")), "left")
    return out.select("doc_id", _remove("text", "spans").alias("r")).select("doc_id", "r.*")
