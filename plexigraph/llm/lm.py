"""LM scoring (5): quantised n-gram counts in a log-frequency Bloom filter.

*Counts.*  One pass over the training texts counts unigrams and bigrams.  N-grams meet in buckets, which are
ranges of their hash, and a bucket writes its part of the model.

*Filter.*  A count c has the level 1 + floor(log2 c).  For each bucket and level there is one Bloom filter, of
the n-grams that reach the level; a count is read by probing level after level until one is missing, and a
level stands for the middle of its counts.  Every n-gram is kept, so the filter grows with the corpus.  The
levels from ``low`` up that fit ``max_filter_bytes`` together are broadcast; a chunk of texts asks the buckets
about the n-grams that miss level ``low`` there, and they probe the levels below.  On a small corpus ``low`` is
1 and no bigram is asked for.  Where the cut lies decides who probes, never what is kept.

*Model.*  p(w | h) = (q(h w) + k p(w)) / (Q(h) + k) and p(w) = (q(w) + 1) / (Q + V + 1), where q are the
quantised counts, Q(h) the sum of q over the bigrams that begin with h, and Q that over all V words: apart
from the filter's false positives, the probabilities of all words, one unknown word included, add up to 1.

*Base scores* need the exact count of every word.  Chunks ask the buckets for them as well: a word that fills a
third of the corpus is one question a chunk.  Words are known by 96 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexigraph.llm.common import chunks, split_words
from plexigraph.llm.phrases import mixed64, pack, unpack
from plexigraph.session import discard, materialize, shuffle_width

#: No word holds white space, so these can't be words.
END, START = b"\n", b"\t"
PROBES = 6
BITS = 9
#: Text a chunk when counting and when scoring, and text a bucket.
COUNTED, SCORED, BUCKET = 8 << 20, 6 << 20, 4 << 20
#: What a row of the model holds.
BLOOM, WORDS, SUMS = 0, 1, 2
MODEL = "bucket int, kind int, level int, payload binary, bytes long, n long, v long, q double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word's hash, and 32 more."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] >> np.uint64(32)).astype(np.uint32)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _planes(a: np.ndarray) -> np.ndarray:
    """Byte by byte: the high bytes are mostly zero."""
    return np.ascontiguousarray(a.view("u1").reshape(-1, a.dtype.itemsize).T)


def _unplanes(a: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(a.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _gaps(h: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _ungaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(_unplanes(gaps, "<u8"), dtype=np.uint64)


def _stretches(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each stretch of equal values."""
    if not len(at):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]).tolist()
    return [(int(at[s]), s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _heads(*sorted_by: np.ndarray) -> np.ndarray:
    """Where each group of equal rows begins."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = False
    for a in sorted_by:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def level_of(c: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(c, 1).astype(np.float64))[1].astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; level 0: none."""
    top = np.exp2(level)
    return np.where(level > 0, (top / 2 + top - 1) / 2, 0.0)


def unigram(q: np.ndarray, total: float, v: int) -> np.ndarray:
    return (q + 1.0) / (total + v + 1.0)


def bigram(q: np.ndarray, p: np.ndarray, total: np.ndarray, k: float) -> np.ndarray:
    """q: the bigram's; p: its second word's probability; total: Q of its first word."""
    return (q + k * p) / (total + k)


class Sequence:
    """The tokens of some texts as numbers of their kinds; each text is a start, its words and an end."""

    def __init__(self, texts: pa.Array) -> None:
        self.sizes, words = split_words(texts, lower=True)
        coded = words.dictionary_encode()
        kinds = coded.dictionary.cast(pa.large_binary()).to_pylist()
        h, check = _hashes([*kinds, END, START])
        order = np.argsort(h)
        number = np.empty(len(h), np.int32)
        number[order] = np.arange(len(h), dtype=np.int32)
        self.h, self.check = h[order], check[order]
        ends = np.cumsum(self.sizes + 2)
        self.begin = ends - self.sizes - 2
        inner = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        inner[self.begin] = inner[ends - 1] = False
        self.tokens = np.empty(len(inner), np.int32)
        self.tokens[inner] = number[coded.indices.to_numpy(zero_copy_only=False)]
        self.tokens[self.begin], self.tokens[ends - 1] = number[-1], number[-2]
        self.start = int(number[-1])


def _pairs(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of distinct bigrams in order, that order): ``key`` as by :func:`_bigrams`."""
    first = key // len(h)
    pair = _pair(h[first], h[key - first * len(h)])
    order = np.argsort(pair)
    return pair[order], order


def _bigrams(tokens: np.ndarray, begin: np.ndarray, kinds: int) -> np.ndarray:
    """Each token but the starts, with the one before: first * kinds + second."""
    second = np.ones(len(tokens), bool)
    second[begin] = False
    at = np.flatnonzero(second)
    return tokens[at - 1].astype(np.int64) * kinds + tokens[at]


class LogBloom:
    """Filters by (bucket, level), one after the other in ``bits``; ``base`` and ``size`` in bytes, size 0 where there is none."""

    def __init__(self, n_buckets: int, low: int, parts: dict[tuple[int, int], bytes], first: int = 0, buckets: int | None = None) -> None:
        self.n_buckets, self.first, self.low = n_buckets, first, low
        self.high = max((level for _, level in parts), default=low)
        shape = (n_buckets if buckets is None else buckets, self.high - low + 2)
        self.base, self.size = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        at = 0
        for (b, level), data in parts.items():
            self.base[b - first, level - low], self.size[b - first, level - low] = at, len(data)
            at += len(data)
        self.bits = np.frombuffer(b"".join(parts.values()), np.uint8)

    @staticmethod
    def _steps(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = mixed64(h + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return x >> np.uint64(32), x & np.uint64(0xFFFFFFFF) | np.uint64(1)

    @classmethod
    def build(cls, h: np.ndarray, level: int, bits: int = BITS) -> bytes:
        """The filter of the n-grams that reach ``level``."""
        size = len(h) * bits // 8 + 8
        out = np.zeros(size * 8, bool)
        a, b = cls._steps(h, level)
        for _ in range(PROBES):
            out[(a * np.uint64(size * 8)) >> np.uint64(32)] = True
            a = (a + b) & np.uint64(0xFFFFFFFF)
        return np.packbits(out, bitorder="little").tobytes()

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level from ``low`` on that each n-gram reaches without a gap; ``low`` - 1 if none."""
        out = np.full(len(h), self.low - 1, np.int64)
        alive = np.arange(len(h))
        bucket = _bucket(h, self.n_buckets) - self.first
        for level in range(self.low, self.high + 1):
            alive = alive[self.size[bucket[alive], level - self.low] > 0]
            if not len(alive):
                break
            a, b = self._steps(h[alive], level)
            base, bits = self.base[bucket[alive], level - self.low], (self.size[bucket[alive], level - self.low] * 8).astype(np.uint64)
            for _ in range(PROBES):
                spot = ((a * bits) >> np.uint64(32)).astype(np.int64)
                hit = (self.bits[base + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    alive, a, b, base, bits = alive[hit], a[hit], b[hit], base[hit], bits[hit]
                a = (a + b) & np.uint64(0xFFFFFFFF)
            out[alive] = level
        return out


def build_model(train: DataFrame, n_buckets: int, bits: int = BITS) -> DataFrame:
    """The model's rows by bucket (see ``MODEL``): filters by level, exact counts of words, sums of histories."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in chunks(batches, "text", COUNTED):
            s = Sequence(b.column(0))
            n = np.bincount(s.tokens, minlength=len(s.h))
            words = {k: [_gaps(s.h[i:j]), _planes(s.check[i:j]), _planes(n[i:j].astype("<u4"))] for k, i, j in _stretches(_bucket(s.h, n_buckets))}
            key, times = np.unique(_bigrams(s.tokens, s.begin, len(s.h)), return_counts=True)
            first = key // len(s.h)
            pair = _pair(s.h[first], s.h[key - first * len(s.h)])
            at = _bucket(pair, n_buckets)
            order = np.argsort(at * len(s.h) + first)  # by history within a bucket
            pair, first, times = pair[order], first[order], times[order].astype("<u4")
            pairs = {k: [_gaps(s.h[first[i:j]]), _planes(pair[i:j]), _planes(times[i:j])] for k, i, j in _stretches(at[order])}
            own = sorted({*words, *pairs})
            none = [np.zeros(0, np.uint8)] * 3
            data = [pack([*words.get(k, none), *pairs.get(k, none)], squeeze) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(data, pa.binary())], ["bucket", "payload"])

    edge = _hashes([START])[0][0]

    def add(t: pa.Table) -> pa.Table:
        own = t["bucket"][0].as_py()
        parts = [unpack(p.as_py(), ["u1"] * 6) for p in t["payload"]]
        w, check, n = (np.concatenate(x) for x in zip(*((_ungaps(p[0]), _unplanes(p[1], "<u4"), _unplanes(p[2], "<u4")) for p in parts), strict=True))
        first, pair, times = (np.concatenate(x) for x in zip(*((_ungaps(p[3]), _unplanes(p[4], "<u8"), _unplanes(p[5], "<u4")) for p in parts), strict=True))
        del parts
        squeeze = zstandard.ZstdCompressor(level=1)
        order = np.lexsort((check, w))
        w, check, n = w[order], check[order], n[order].astype(np.int64)
        heads = _heads(w, check) if len(w) else np.zeros(0, np.int64)
        w, check, n = w[heads], check[heads], np.add.reduceat(n, heads) if len(heads) else n
        token = w != edge
        rows = [(own, WORDS, 0, pack([_gaps(w), _planes(check), _planes(n.astype("<u8"))], squeeze), int(n[token].sum()), int(token.sum()), float(middle(level_of(n[token])).sum()))]
        order = np.argsort(pair)
        first, pair, times = first[order], pair[order], times[order].astype(np.int64)
        heads = _heads(pair) if len(pair) else np.zeros(0, np.int64)
        first, pair, times = first[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times
        # twice the quantised counts, which are whole numbers, of each history to the history's own bucket
        twice = (2 * middle(level_of(times))).astype(np.int64)
        order = np.argsort(first)
        first, twice = first[order], twice[order]
        heads = _heads(first) if len(first) else np.zeros(0, np.int64)
        first, twice = first[heads], np.add.reduceat(twice, heads) if len(heads) else twice
        for k, i, j in _stretches(_bucket(first, n_buckets)):
            rows.append((k, SUMS, 0, pack([_gaps(first[i:j]), _planes(twice[i:j].astype("<u8"))], squeeze), 0, 0, 0.0))
        h, level = np.concatenate([w, pair]), np.concatenate([level_of(n), level_of(times)])
        for x in range(1, int(level.max(initial=0)) + 1):
            rows.append((own, BLOOM, x, LogBloom.build(h[level >= x], x, bits), 0, 0, 0.0))
        b, kind, x, data, n, v, q = zip(*rows, strict=True)
        return pa.table({"bucket": pa.array(b, pa.int32()), "kind": pa.array(kind, pa.int32()), "level": pa.array(x, pa.int32()), "payload": pa.array(data, pa.binary()), "bytes": pa.array(map(len, data), pa.int64()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64()), "q": pa.array(q, pa.float64())})

    return train.select("text").mapInArrow(gather, "bucket int, payload binary").groupBy("bucket").applyInArrow(add, MODEL)


def lowest_level(model: DataFrame, most: int) -> int:
    """The lowest level such that all filters from it up take at most ``most`` bytes.  One row a level comes to the driver."""
    sums = {r["level"]: r["n"] for r in model.where(F.col("kind") == BLOOM).groupBy("level").agg(F.sum("bytes").alias("n")).collect()}
    low, size = max(sums, default=0) + 1, 0
    while low > 1 and (size := size + sums[low - 1]) <= most:
        low -= 1
    return low


def _lookup(at: np.ndarray, by: np.ndarray, value: np.ndarray) -> np.ndarray:
    """value where ``by`` (sorted) holds ``at``, else 0."""
    if not len(by):
        return np.zeros(len(at), value.dtype)
    i = np.minimum(np.searchsorted(by, at), len(by) - 1)
    return np.where(by[i] == at, value[i], 0)


def lm_scores(docs: DataFrame, max_filter_bytes: int = 32 << 20, k: float = 200.0, bits: int = BITS) -> DataFrame:
    """Scores every whole text with a model of the training documents (crc32 of doc_id as text, mod 7, not 2).

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram, exact counts), score (log10 probability by the filter's bigram model).

    Defined cases: a null text is empty and scores its end alone; a null doc_id hashes as the empty string and
    so trains; repeated rows train and score as often as they occur; without training documents base and score
    come from zero counts; an empty table gives no rows; other columns are not read.  A text is never cut: one
    of any length is a chunk by itself, which takes some 25 times its size of memory in a Python worker.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(2 * shuffle_width(spark), -(-total // BUCKET))
    model = materialize(build_model(rows.where(~F.col("held_out")), n_buckets, bits), "model")
    n, v, mass = model.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "q"))).first()
    low = lowest_level(model, max_filter_bytes)
    is_bloom = F.col("kind") == BLOOM
    high = model.where(is_bloom & (F.col("level") >= low)).select("bucket", "level", "payload").collect()  # at most max_filter_bytes
    sent = spark.sparkContext.broadcast(LogBloom(n_buckets, low, {(r["bucket"], r["level"]): bytes(r["payload"]) for r in high}))
    held = model.where(~is_bloom | (F.col("level") < low)).select("bucket", "kind", "level", "payload")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of texts as numbers, with what the broadcast filter says of their bigrams in order of their hash."""
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1)
        chunk = TaskContext.get().partitionId() << 32
        for b in chunks(batches, "text", SCORED):
            s = Sequence(b.column(1))
            found = sent.value.levels(_pairs(s.h, np.unique(_bigrams(s.tokens, s.begin, len(s.h))))[0])
            sink = pa.BufferOutputStream()
            head = pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s.sizes)], ["doc_id", "held_out", "n"])
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            data = pack([sink.getvalue().to_pybytes(), _gaps(s.h), _planes(s.check), _planes(s.tokens), found.astype(np.uint8)], squeeze)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["chunk", "payload"])
            chunk += 1

    def numbered(payload: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A chunk's head, kinds of token (hash, check), tokens, bigrams and their levels so far."""
        head, h, check, tokens, found = unpack(payload, [None, "u1", "u1", "u1", "u1"])
        t, h, tokens = pa.ipc.open_stream(head).read_all(), _ungaps(h), _unplanes(tokens, "<i4")
        sizes = t["n"].to_numpy()
        return t, h, _unplanes(check, "<u4"), _bigrams(tokens, np.cumsum(sizes + 2) - (sizes + 2), len(h)), found.astype(np.int64), sizes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's questions to each bucket: its words, and its bigrams that miss the lowest level sent."""
        squeeze = zstandard.ZstdCompressor(level=1)
        none = np.zeros(0, np.uint8)
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, h, check, bigrams, found, _ = numbered(payload.as_py())
                open_ = _pairs(h, np.unique(bigrams))[0][found < low] if low > 1 else h[:0]
                words = {x: [_gaps(h[i:j]), _planes(check[i:j])] for x, i, j in _stretches(_bucket(h, n_buckets))}
                pairs = {x: _gaps(open_[i:j]) for x, i, j in _stretches(_bucket(open_, n_buckets))}
                own = sorted({*words, *pairs})
                data = [pack([*words.get(x, [none, none]), pairs.get(x, none)], squeeze) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(data, pa.binary())], ["chunk", "bucket", "payload"])

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        """For each question: counts, levels and sums of its words, and levels of its bigrams."""
        if not asked.num_rows:
            return asked
        own = asked["bucket"][0].as_py()
        parts, w, check, n, first, twice = {}, *([np.zeros(0, np.uint64)] * 5)
        sums = []
        for kind, level, p in zip(held["kind"].to_pylist(), held["level"].to_pylist(), held["payload"], strict=True):
            if kind == BLOOM:
                parts[own, level] = p.as_py()
            elif kind == WORDS:
                a = unpack(p.as_py(), ["u1"] * 3)
                w, check, n = _ungaps(a[0]), _unplanes(a[1], "<u4"), _unplanes(a[2], "<u8")
            else:
                a = unpack(p.as_py(), ["u1"] * 2)
                sums.append((_ungaps(a[0]), _unplanes(a[1], "<u8")))
        if sums:
            first, twice = (np.concatenate(x) for x in zip(*sums, strict=True))
            order = np.argsort(first)
            first, twice = first[order], twice[order]
            heads = _heads(first)
            first, twice = first[heads], np.add.reduceat(twice, heads)
        bloom = LogBloom(n_buckets, 1, parts, own, 1)
        squeeze, out = zstandard.ZstdCompressor(level=1), []
        for p in asked["payload"]:
            a = unpack(p.as_py(), ["u1"] * 3)
            h, c, pair = _ungaps(a[0]), _unplanes(a[1], "<u4"), _ungaps(a[2])
            i = np.searchsorted(w, h)
            count = np.zeros(len(h), np.uint64)
            todo = np.arange(len(h))
            while len(todo := todo[i[todo] < len(w)]) and len(todo := todo[w[i[todo]] == h[todo]]):
                same = check[i[todo]] == c[todo]  # words that share a hash stand next to each other
                count[todo[same]] = n[i[todo[same]]]
                todo = todo[~same]
                i[todo] += 1
            out.append(pack([_planes(count.astype("<u8")), _planes(_lookup(h, first, twice).astype("<u8")), bloom.levels(pair).astype(np.uint8)], squeeze))
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "payload": pa.array(out, pa.binary())})

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        t, h, _, bigrams, level, sizes = numbered(own["payload"][0].as_py())
        # buckets are ranges of the hash, so answers in the order of buckets are in that of hashes
        got = [unpack(p, ["u1"] * 3) for _, p in sorted(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True))]
        count, twice, deep = (np.concatenate(x) for x in zip(*((_unplanes(a[0], "<u8"), _unplanes(a[1], "<u8"), a[2]) for a in got), strict=True))
        count = count.astype(np.float64)
        if low > 1:
            level[level < low] = deep
        key, which = np.unique(bigrams, return_inverse=True)
        _, order = _pairs(h, key)
        first = key // len(h)
        second = key - first * len(h)
        of = np.empty(len(key), np.int64)
        of[order] = level
        top = np.where(count > 0, level_of(count), 0)  # a bigram is no more frequent than its words
        p = unigram(middle(top), mass, v)
        logp = np.log10(bigram(middle(np.minimum(of, np.minimum(top[first], top[second]))), p[second], twice[first] / 2, k))
        at = np.cumsum(sizes + 1) - (sizes + 1)
        score = np.add.reduceat(logp[which], at)
        known, base = np.add.reduceat((count > 0)[second][which].astype(np.int64), at), np.add.reduceat(np.log10(count + 1)[second][which], at)
        return pa.table({
            "doc_id": t["doc_id"], "held_out": t["held_out"], "n_tokens": pa.array(sizes + 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(sizes), n)),
            "base_score": pa.array(base - (sizes + 1) * log10(n + v + 1)), "score": pa.array(score),
        })

    own = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(number, "chunk long, payload binary"), "numbered")
    kind = "chunk long, bucket int, payload binary"
    asked = own.mapInArrow(ask, kind)
    # written, so that the questions' shuffle is gone before the chunks move
    answers = materialize(held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, kind), "answers")
    discard(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
