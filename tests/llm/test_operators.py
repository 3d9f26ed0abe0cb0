"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, before long, fp string, `a.b` string"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def make(n: int = 60) -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 8))) for _ in range(400)] + ["Été", "NAÏVE", "日本", "x\x0by"]
    passage = " ".join(rng.choices(vocab, k=60))
    line = "A Frequent  line that many documents hold, É"
    out = []
    for i in range(n):
        text = " ".join(rng.choices(vocab, k=rng.randint(1, 150)))
        if i % 4 == 0:
            text += " " + passage + " " + rng.choice(vocab)
        if i % 3 == 0:
            text += "\n \t" + (line if i % 2 else line.upper().replace("É", "É")) + " \r\nshort\nshort\n"
        out.append((i * 3, text))
    out += [(500, out[5][1]), (501, out[5][1].upper().replace("ß", "ẞ")), (502, out[7][1] + " tail"), (503, None), (504, ""), (505, " \n\n\t"), (506, "one"), (507, "ab " * 3000), (507, "ab " * 3000), (None, out[5][1]), (None, None), (508, "ÀÉ 12'll it's don't ﬁ ①  İı x́"), (509, ("word%d " * 40) % tuple(range(40)) * 2)]
    return [(d, t, "en", None if k % 11 == 0 else f"s{k % 3}", None if t is None else len(t), "g", k, "f", "q") for k, (d, t) in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return Counter(tuple(r[c.strip("`")] for c in cols) for r in df.collect())


def low(b: bytes) -> bytes:
    return b.lower()


def data(t: str | None) -> bytes:
    return (t or "").encode()


def test_quality(docs, none, rows):
    from plexigraph.llm.quality import keep_good, quality

    want, failed = [], Counter()
    for d, t, *_ in rows:
        w = data(t).split()
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        bad = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), bad))
    got = quality(docs)
    assert bag(got, *got.columns[:7]) == Counter(want)
    assert all(not (r["base_failed"] and r["kept"]) for r in got.collect())
    good = Counter(w[0] for w in want if not w[6])  # no host of these fails as a whole
    kept = keep_good(docs)
    assert kept.columns == docs.columns and bag(kept, "doc_id") == bag(got.where("kept"), "doc_id") == Counter((d,) for d in good.elements())
    assert quality(none).count() == 0 and keep_good(none).count() == 0


def test_host_verdicts(spark):
    from plexigraph.llm.quality import fit_beta, host_verdicts

    f = spark.createDataFrame([("bad", True)] * 40 + [("good", False)] * 60 + [("mix", True), ("mix", False)] + [(None, True)], "source string, failed boolean")
    v = {r["source"]: r["host_kept"] for r in host_verdicts(f).collect()}
    assert v["bad"] is False and v["good"] is True and set(v) == {"bad", "good", "mix"}
    assert fit_beta(0, 0, 0, 0, 0) == (0.0, 0.0) and fit_beta(10.0, 4.0, 1.6, 100.0, 1) == (0.4, 0.0)
    # hosts drawn from a known prior, small ones too; and hosts that differ by chance alone
    rng = np.random.default_rng(1)
    size = rng.integers(2, 60, 20_000)
    for a, b in ((2.0, 6.0), (0.5, 0.5), (30.0, 20.0)):
        x = rng.binomial(size, rng.beta(a, b, len(size)))
        mean, strength = fit_beta(float(size.sum()), float(x.sum()), float((x * x / size).sum()), float((size * size).sum()), len(size))
        assert mean == pytest.approx(a / (a + b), abs=0.01) and strength == pytest.approx(a + b, rel=0.1)
    x = rng.binomial(size, 0.3)
    assert fit_beta(float(size.sum()), float(x.sum()), float((x * x / size).sum()), float((size * size).sum()), len(size))[1] > 500


def test_suffix_array(docs, none, rows):
    from plexigraph.llm.pfp import substring_dedup

    first: dict[bytes, float] = {}
    key = lambda d: math.inf if d is None else d
    for d, t, *_ in rows:
        b = data(t)
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], math.inf), key(d))
    want = []
    for d, t, *_ in rows:
        b, m = data(t), bytearray(len(data(t)))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                m[i : i + 50] = b"\1" * 50
        want.append((d, len(b), sum(m), sum(m[i] and not (i and m[i - 1]) for i in range(len(m))), sha(bytes(c for c, x in zip(b, m) if not x))))
    got = substring_dedup(docs)
    assert bag(got, *got.columns) == Counter(want)
    assert substring_dedup(none).count() == 0


def test_corpus_order():
    """The order from dictionary and parse is that of the windows' texts."""
    from plexigraph.llm.pfp import GRAM, SPAN, corpus_order

    rng = np.random.default_rng(6)
    for alphabet in (1, 2, 4, 200):
        base = bytes(rng.integers(0, alphabet, 120, dtype=np.uint8))
        phrases, trigger, windows = [], [], []
        for _ in range(60):
            w = int(rng.integers(1, SPAN - GRAM + 2))
            a = int(rng.integers(w - 1, SPAN - GRAM + 1))
            s = int(rng.integers(0, 20))
            text = bytearray(base[s : s + w + SPAN - 1])
            if rng.random() < 0.5:
                text[int(rng.integers(len(text)))] ^= 1
            phrases.append(bytes(text))
            trigger.append(a)
            windows.append(w)
        order, same, owner, start = corpus_order(phrases, np.array(trigger), np.array(windows))
        text = [phrases[p][s : s + SPAN] for p, s in zip(owner.tolist(), start.tolist())]
        key = [(phrases[p][s : trigger[p] + GRAM], phrases[p][trigger[p] : s + SPAN]) for p, s in zip(owner.tolist(), start.tolist())]
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            assert key[a] <= key[b] or key[a][0] == key[b][0]
            assert same[k] == (key[a] == key[b])
        # windows with one trigger place in them make one run
        runs = Counter()
        for k, i in enumerate(order.tolist()):
            if not same[k]:
                runs[key[i]] += 1
        assert set(runs.values()) == {1} and len(text) == len(order)


def test_long_segments(spark, monkeypatch):
    from plexigraph.llm import pfp

    rng = np.random.default_rng(0)
    one = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    two = bytes(rng.integers(97, 123, 700, dtype=np.uint8)) + one[1000:1400] + b"x"
    monkeypatch.setattr(pfp, "SEGMENT", 900)
    ids, hs = np.array([1, 2]), np.array([11, 12])
    spans = [s for r in pfp._parse([one, two], ids, hs, 1, np.zeros(1 << 20, bool)) if r[2] is not None for s in np.frombuffer(r[3], "<i8").reshape(-1, 2).tolist()]
    assert spans and min(s for s, _ in spans) >= 700 and max(e for _, e in spans) <= 1100


def test_exact(docs, none, rows):
    from plexigraph.llm.exact import FuseFilter, drop_copies, exact_dedup

    groups: dict[bytes, list] = {}
    for d, t, *_ in rows:
        groups.setdefault(low(data(t)), []).append(d)
    keep = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = [(d, keep[k], len(groups[k]), d == keep[k], sha(k)) for d, t, *_ in rows for k in [low(data(t))]]
    for n in (1, 2, 3):
        got = exact_dedup(docs, n)
        assert bag(got, *got.columns) == Counter(want)
    assert exact_dedup(none).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and bag(kept, "doc_id", "text") == Counter((d, t) for d, t, *_ in rows if d == keep[low(data(t))])
    for size in (0, 1, 2, 10, 5000):
        keys = np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64)
        f = FuseFilter.load(FuseFilter.build(keys).dump())
        assert f.holds(keys).all()
        assert f.holds(np.random.default_rng(99).integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.02


def test_simhash(docs, none, rows):
    from xxhash import xxh64_intdigest

    from plexigraph.llm.simhash import keep_one, simhash_groups

    prints = []
    for _, t, *_ in rows:
        w = low(data(t)).split()
        hs = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs)))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    got = simhash_groups(docs)
    assert bag(got, *got.columns) == Counter((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows)))
    kept = keep_one(docs)
    first = {}
    for i, g in enumerate(group):
        first[g] = min(first.get(g, (math.inf,)), (math.inf if rows[i][0] is None else rows[i][0], rows[i][1] or "", i))
    assert kept.columns == docs.columns and bag(kept, "doc_id") == Counter((None if x == math.inf else x,) for x, *_ in first.values())
    assert simhash_groups(none).count() == 0 and keep_one(none).count() == 0


def test_similar(spark, docs, none, rows):
    """Recall of the pipeline's near copies against all pairs: 1."""
    import corpus_pipeline

    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [t for _, t, *_ in rows]
    for k in range(60):  # copies from alike to just under 0.8, of a group and of each other
        words = list(base) if k % 3 else texts[rng.randrange(60)].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = low(data(t)).split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                pairs += 1
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert pairs > 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and corpus_pipeline.simhash_near_dedup(spark, none, "").count() == 0


def test_similar_candidates(spark, monkeypatch):
    """Texts of the same passages, few of them similar: all meet, but only those that bounds can't part are verified."""
    from plexigraph.llm import similar

    rng = random.Random(11)
    block = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(24)]
    texts = [" ".join(block[k] for k in rng.sample(range(24), 6)) for _ in range(150)]
    for k in range(30):
        words = texts[k].split()
        words[rng.randrange(120)] = f"new{k}"
        texts.append(" ".join(words[: 120 - rng.randrange(12)]))
    rows, made = [(i, t) for i, t in enumerate(texts)], {}

    def counted(df, what="table", by=None):
        out = materialize(df, what, by)
        made[what] = max(made.get(what, 0), out.count())
        return out

    materialize = similar.materialize
    monkeypatch.setattr(similar, "materialize", counted)
    got = similar.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in brute_similar(rows))
    assert made["apart"] <= 180, made


def test_parities():
    """No link is lost by the bounds: sets of all sizes, as similar as 0.8 and less."""
    from plexigraph.llm.similar import PARITY, _parities

    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 9, 300, 0, 5000)]
    sets += [np.append(x[: len(x) - len(x) // 9], rng.integers(0, 1 << 63, len(x) // 9, dtype=np.uint64)) for x in sets] * 400
    got = _parities(np.concatenate(sets), np.array([len(x) for x in sets]))
    words = np.stack([got.field(k).to_numpy().view(np.uint64) for k in range(len(PARITY))], axis=1)
    for i, x in enumerate(sets):
        for j in (0, 1, 2, 3, 5):
            assert np.bitwise_count(words[i] ^ words[j]).sum() <= len(np.setxor1d(x, sets[j]))
    assert np.bitwise_count(words[3] ^ words[9]).sum() > 30 and np.bitwise_count(words[3]).sum() > 100


def test_pigeonhole(spark):
    """Planted chains and a dense ball over random fingerprints, for every number of parts."""
    from plexigraph.llm import simhash

    rng = np.random.default_rng(2)
    fps = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for base in list(fps)[:30]:
        fps |= {base ^ sum(1 << int(j) for j in rng.choice(64, k, replace=False)) for k in (1, 3, 4)}
    ball = int(rng.integers(0, 1 << 63))
    fps |= {ball} | {ball ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    f = np.array(sorted(fps), np.uint64)
    parent = list(range(len(f)))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4).tolist():
            a, b = simhash._find(parent, i), simhash._find(parent, j)
            parent[max(a, b)] = min(a, b)
    want = [simhash._find(parent, i) for i in range(len(f))]
    n, pairs = simhash.bit_counts(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"))
    assert n == len(f)
    # bits that always agree count once
    twin = np.array([[50, 50, 26], [50, 50, 26], [26, 26, 52]], float)
    assert simhash.agreement(100, twin, [0, 1]) == pytest.approx(0.5) and simhash.agreement(100, twin, [0, 1, 2]) == pytest.approx(0.25, abs=0.01)
    real = simhash.plan
    for m, crowd in ((1, 0), (2, 4096), (3, 4096), (4, 4096), (5, len(f) // 4)):
        groups = simhash.bit_groups(n, pairs, m)
        ts = simhash.thresholds(n, pairs, groups, 4)[1]
        assert sum(t + 1 for t in ts) == 5 and sorted(j for g in groups for j in g) == list(range(64))
        if m == 1:
            continue
        simhash.plan = lambda *_, g=groups, t=ts: [(sum(1 << j for j in x), y) for x, y in zip(g, t) if y >= 0]
        try:
            found = simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(3), crowd=crowd).collect()
        finally:
            simhash.plan = real
        at, own = {int(x): i for i, x in enumerate(f.view(np.int64))}, list(range(len(f)))
        for r in found:
            a, b = simhash._find(own, at[r["src"]]), simhash._find(own, at[r["dst"]])
            own[max(a, b)] = min(a, b)
        assert [simhash._find(own, i) for i in range(len(f))] == want
    parent, out = list(range(len(f))), []
    simhash._forest(np.tile(f, 1), parent, np.arange(len(f)), 4, out)
    assert [simhash._find(parent, i) for i in range(len(f))] == want


def test_split_words():
    """Whole arrays and slices of them, in chunks of every size, against Python's split."""
    import pyarrow as pa

    from plexigraph.llm.common import chunks, slices, split_words, text_bytes

    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "".join(rng.choices("aBÉé日 \t\n\x1c\x85x", k=rng.randrange(60))) for _ in range(3000)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for limit in (1, 300, 5_000, 1 << 20):
            got, at = [], 0
            for b in chunks(iter(pa.table({"text": whole}).to_batches(max_chunksize=700)), "text", limit):
                for lower in (False, True):
                    counts, words = split_words(b.column(0), lower)
                    want = [(low(data(t)) if lower else data(t)).split() for t in texts[at : at + b.num_rows]]
                    assert counts.tolist() == list(map(len, want)) and words.cast(pa.large_binary()).to_pylist() == [w for x in want for w in x]
                got += text_bytes(b.column(0))
                at += b.num_rows
            assert got == list(map(data, texts))
            assert [x for s, e in slices(whole, limit) for x in text_bytes(whole.slice(s, e - s))] == got


def quantised(c: int) -> float:
    return (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0


def test_lm(docs, none, rows):
    """Base scores exactly; the model against one of quantised counts whose probabilities add up to 1."""
    from plexigraph.llm.lm import lm_scores

    one, two, toks = Counter(), Counter(), []
    for d, t, *_ in rows:
        toks.append([b"\t", *low(data(t)).split(), b"\n"])
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            one.update(toks[-1][1:])
            two.update(zip(toks[-1], toks[-1][1:]))
    n, v = sum(one.values()), len(one)
    mass, history = sum(map(quantised, one.values())), Counter()
    for (a, _), c in two.items():
        history[a] += quantised(c)

    def p(b):
        return (quantised(one[b]) + 1) / (mass + v + 1)

    def q(a, b):
        return (quantised(two[a, b]) + 200 * p(b)) / (history[a] + 200)

    for a in [b"\t", *list(one)[:40], b"unknown"]:
        assert sum(q(a, b) for b in [*one, b"unknown"]) == pytest.approx(1)
    assert 1 in two.values() and max(two.values()) > 8
    want = sorted(
        (str(d), len(w) - 1, sum(x in one for x in w[1:]), n, round(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w[1:]), 5), round(sum(math.log10(q(a, b)) for a, b in zip(w, w[1:])), 5))
        for (d, *_), w in zip(rows, toks)
    )
    # wide filters have no false positives here: broadcast whole, in part, and not at all
    for most in (1 << 25, 20_000, 0):
        got = lm_scores(docs, max_filter_bytes=most, bits=200).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want, most
    assert any(r["held_out"] for r in got)
    usual = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), r["score"]) for r in lm_scores(docs).collect())
    assert [r[:5] for r in usual] == [r[:5] for r in want]
    assert sum(abs(r[5] - x[5]) for r, x in zip(usual, want)) < 0.01 * sum(r[1] for r in usual)
    assert lm_scores(none).count() == 0


def test_lm_held_out(spark):
    """On texts that it has not seen, the model is better than base scores."""
    from plexigraph.llm.lm import lm_scores

    held = lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.2


def test_small_chunks(docs, monkeypatch):
    """Cut into many chunks and buckets, every operator gives the same rows."""
    from plexigraph.llm import lm, pfp, rlz, similar

    def each():
        yield sorted(map(str, pfp.substring_dedup(docs).collect()))
        yield sorted(map(str, rlz.word_span_dedup(docs).collect()))
        yield sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.lm_scores(docs, bits=200).collect())
        yield sorted(str(r["doc_id"]) for r in similar.keep_similar(docs).collect())

    want = list(each())
    for module, name, size in ((pfp, "CHUNK", 900), (rlz, "CHUNK", 900), (lm, "COUNTED", 1000), (lm, "SCORED", 700), (lm, "BUCKET", 500), (similar, "CHUNK", 800)):
        monkeypatch.setattr(module, name, size)
    assert list(each()) == want


def test_log_bloom():
    from plexigraph.llm.lm import LogBloom, _bucket, level_of

    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    level = level_of(rng.integers(1, 500, len(h)))
    at = _bucket(h, 4)
    parts = {(k, x): LogBloom.build(h[(at == k) & (level >= x)], x) for k in range(4) for x in range(1, 10)}
    got = LogBloom(4, 1, parts).levels(h)
    assert (got >= level).all() and (got == level).mean() > 0.9
    high = LogBloom(4, 3, {k: x for k, x in parts.items() if k[1] >= 3}).levels(h)
    assert (high[level >= 3] >= level[level >= 3]).all() and (high[level < 3] == 2).mean() > 0.9
    assert level_of(np.array([1, 2, 3, 4, 7, 8, 1023, 1024])).tolist() == [1, 2, 2, 3, 3, 4, 10, 11]
    assert not LogBloom(4, 2, {}).levels(h).max() > 1


def test_word_spans(docs, none, rows):
    from plexigraph.llm.rlz import word_span_dedup

    seen = Counter()
    for _, t, *_ in rows:
        w = data(t).split()
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for d, t, *_ in rows:
        w = data(t).split()
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = word_span_dedup(docs)
    assert bag(got, *got.columns) == Counter(want)
    assert word_span_dedup(none).count() == 0


def test_factors():
    """The index and the greedy parse against all pairs of places."""
    from plexigraph.llm.phrases import merged
    from plexigraph.llm.rlz import Block, factors

    rng = random.Random(8)
    for _ in range(30):
        phrases = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 8))]
        got = Block(phrases).longest().tolist()
        places = [(p, i) for p, x in enumerate(phrases) for i in range(len(x))]
        for (p, i), n in zip(places, got):
            best = max((next((k for k in range(40) if i + k >= len(phrases[p]) or j + k >= len(phrases[q]) or phrases[p][i + k] != phrases[q][j + k])) for q, j in places if (p, i) != (q, j)), default=0)
            assert n == best
        at = 0
        for x in phrases:
            own = got[at : at + len(x)]
            at += len(x)
            assert merged(factors(own, 5)) == merged((i, i + n) for i, n in enumerate(own) if n >= 5)


def test_hot_passage(spark):
    """A passage that all documents hold, each followed by words of its own: no trigger collects what is unlike."""
    from plexigraph.llm import pfp, rlz
    from plexigraph.llm.phrases import common_grams, common_table, unpack

    rng = random.Random(2)
    passage = " ".join(f"shared{k}" for k in range(80))
    texts = [passage + " " + " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(80)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = np.arange(300)
    for op in (pfp, rlz):
        common = common_grams(docs, op._all_grams)
        assert len(common) > 50
        # by trigger, the unlike phrases that meet there
        widest = []
        for table in (np.zeros(1 << 20, bool), common_table(common)):
            met: dict[int, set] = {}
            for k, t in enumerate(texts):
                for bucket, doc, _, payload in op._parse([t.encode()], ids[k : k + 1], ids[k : k + 1], 1 << 40, table):
                    if doc is None:
                        content, sizes = unpack(payload, op._KINDS)[:2]
                        sizes = sizes.astype(np.int64) + (pfp.SPAN if op is pfp else 0)
                        met.setdefault(bucket, set()).update(content[e - n : e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist()))
            widest.append(max(map(len, met.values())))
        assert widest[0] > 150 and widest[1] < 60, widest
    got = {r["doc_id"]: r["n_removed"] for r in rlz.word_span_dedup(docs).collect()}
    assert set(got.values()) == {80}
    got = {r["doc_id"]: r["n_removed"] for r in pfp.substring_dedup(docs).collect()}
    assert got.pop(0) == 0 and all(len(passage) + 1 <= n <= len(passage) + 4 for n in got.values())


def brute_targets(total: Counter) -> dict:
    """Each source's share of 150 % of all sizes by weight, stopped at twice its size, the excess shared again."""
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(docs, none, rows):
    from plexigraph.llm.mixing import mix, mixed, word_count

    sizes = [len(data(t).split()) for _, t, *_ in rows]
    total = Counter()
    for r, n in zip(rows, sizes):
        total[r[3]] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    target = brute_targets(total)
    counted = docs.select("doc_id", "source", word_count("text").alias("size"), "g", "before", F.lit("k").alias("key"), "`a.b`", F.lit(1).alias("rank"))
    out = mix(counted)
    assert out.columns == [*counted.columns, "source_size", "target", "taken"]
    assert bag(out, "g", "before", "key", "`a.b`", "rank") == bag(counted, "g", "before", "key", "`a.b`", "rank")
    got = out.collect()
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == total[s]
        assert sum(r["taken"] for r in own) == math.floor(target[s] + 1e-9) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert Counter(map(tuple, mix(counted.repartition(2)).collect())) == Counter(map(tuple, got))
    # the mix itself: every document as often as it is taken whole, and one part of it
    want = Counter()
    held = {}
    for r in rows:
        held.setdefault((r[0], r[3], len(data(r[1]).split())), []).append(r)
    for r in got:
        row = held[r["doc_id"], r["source"], r["size"]].pop()
        words = data(row[1]).split()
        whole, part = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
        want.update({(*row[:1], row[1], *row[2:5]): whole} if whole else {})
        if part:
            cut = re.match(rb"(?:[ \t-\r]*[^ \t-\r]+){%d}" % part, data(row[1]))[0].decode()
            assert cut.encode().split() == words[:part]
            want[row[0], cut, *row[2:4], len(cut)] += 1
    out = mixed(docs)
    assert out.columns == docs.columns and bag(out, "doc_id", "text", "lang", "source", "n_chars") == want
    assert mix(none.select("doc_id", "source", word_count("text").alias("size"))).count() == 0 and mixed(none).count() == 0


def test_packing(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from plexigraph.llm.packing import pack, pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[d, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())] += 1
    got = pack_documents(docs, path, 64).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    seqs: dict[int, list] = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in seqs.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 64
    assert len(seqs) <= best_fit_decreasing([r["length"] for r in got], 64)
    assert pack_documents(none, path).count() == 0
    named = docs.select("doc_id", F.lit(0).alias("piece"), (1 + F.col("before") % 60).alias("length"), F.lit(7).cast("long").alias("ids_crc32"), "g", "before", F.lit("x").alias("one"), "`a.b`")
    out = pack(named, 64)
    assert out.columns == [*named.columns, "sequence_id", "offset"] and bag(out, *[f"`{c}`" for c in named.columns]) == bag(named, *[f"`{c}`" for c in named.columns])


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = min((r for r in rooms if r >= x), default=None)
        if at is not None:
            rooms.remove(at)
        rooms.append((capacity if at is None else at) - x)
    return len(rooms)


def test_configurations():
    """The program's worth against all patterns of a small case, and its use in a plan."""
    from plexigraph.llm.packing import configurations, grouped, knapsack, plan

    worth, count = knapsack(np.array([50, 30, 20]), np.array([0.6, 0.3, 0.1]), 100)
    assert worth == pytest.approx(1.2) and count.tolist() == [2, 0, 0]
    # three sizes that only fill up together: 60 + 40, 50 + 25 + 25
    found = configurations([60, 50, 40, 25], [10, 10, 10, 20], 100)
    assert sum(n for _, n in found) == 20
    assert sum(n * c for c, n in found).tolist() == [10, 10, 10, 20]
    runs = grouped({60: 10, 50: 10, 40: 10, 25: 20}, 100, 50, 8)
    assert sum(r.n for r in runs) == 20 and all(r.free == 0 for r in runs)
    assert sum(r.n for r in plan({60: 10, 50: 10, 40: 10, 25: 20, 3: 4}, 100)) == 21


def test_plan():
    from plexigraph.llm.packing import fewest, plan

    rng = random.Random(1)
    for k in range(12):
        h = Counter(min(200, int(rng.expovariate(0.01 * (1 + k))) + 1) for _ in range(rng.randint(1, 2000)))
        n = sum(r.n for r in plan(dict(h), 200))
        assert fewest(sum(x * y for x, y in h.items()), h, 200) <= n <= best_fit_decreasing(list(h.elements()), 200)
    rng = random.Random(1)
    for _ in range(20):
        h = Counter(min(200, int(rng.expovariate(0.02)) + 1) for _ in range(rng.randint(1, 3000)))
        used = Counter()
        for r in plan(dict(h), 200):
            assert sum(x for x, _ in r.parts) + r.free == 200 and r.free >= 0
            for x, rank in r.parts:
                used.update((x, rank + i) for i in range(r.n))
        assert used == Counter((x, i) for x, n in h.items() for i in range(n))


def test_urls(spark):
    from plexigraph.llm.urlfilter import RULES, judge_urls, rule_table

    urls = [None, "", "nothing", "http://", "HTTP://Example.COM/en/7x?q", "http://a.b.example.com/en/8", "x://com/en/", "http://com.evil.org/en/", "http://netx/de/1", "http://a-net/de/", "http://net/de", "http://net/de/", "http://q.example.net/de/8", "http://q.example.net/de/8#/x", "http://org?x=/es/", "http://w.org/es/1", "http://w.org/es/1", "a://b://com/en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for rules in (RULES, (*RULES, ("block", "com/"), ("allow", "b.example.com/"), ("block", "a.b.example.com/en/8"))):
        want = []
        for i, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
            fit = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
            best = max(fit, default=(0, None, "allow"))
            want.append((i, host, path, best[1], best[2]))
        got = judge_urls(pages, rule_table(spark, rules))
        assert bag(got, *got.columns) == Counter(want)
    assert judge_urls(pages.limit(0), rule_table(spark)).count() == 0


def test_lines(docs, none, rows):
    from plexigraph.llm.linededup import dedup_lines, line_dedup

    white = " \t\n\x0b\x0c\r"
    key = lambda x: low(x.strip(white).encode()).decode()
    holds: dict[str, list] = {}
    for d, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holds.setdefault(k, []).append(d)
    want = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= 20 and len(holds[key(x)]) >= 3 and d != max(y for y in holds[key(x)] if y is not None)  # noqa: E731, B023
        kept = [x for x in lines if not gone(x)]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert any(w[2] for w in want)
    for n in (1, 2, 6):  # six batches compact the runs
        got = line_dedup(docs, n_batches=n, bucket_lines=20)
        assert bag(got, *got.columns) == Counter(want)
    out = dedup_lines(docs)
    assert out.columns == docs.columns and bag(out, "doc_id", "text") == Counter((w[0], w[3]) for w in want)
    assert line_dedup(none).count() == 0 and dedup_lines(none).count() == 0


def test_line_runs(spark):
    """Fresh keys and compaction; joins and merges of runs shuffle nothing."""
    from plexigraph.llm.linededup import LineRuns

    rng, store, want = random.Random(3), LineRuns(spark, 3, 2), {}
    for k in range(5):
        batch = sorted({(100 - 10 * k - rng.randrange(10), rng.randrange(30), 1) for _ in range(40)})
        for d, a, _ in batch:
            n, last = want.get(a, (0, d))
            want[a] = n + 1, max(last, d)
        store.add(spark.createDataFrame(batch, "doc_id long, a long, b long"))
        assert {r["a"]: (r["n"], r["last"]) for r in store.totals().collect()} == want
        assert sum(r.where("fresh").count() for r in store.runs) == len(want)
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert "Exchange" not in store.totals()._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def long_rows():
    """Texts of 20,000 words, of over a MB and of several MB, with shared passages, and nulls beside them."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    some = lambda n: rng.choices(vocab, k=n)
    first = some(20_000)
    second = some(90_000) + first[5_000:5_200] + some(90_000) + ["x" * 30_000]
    third = second[1_000:60_000] + some(500_000)
    line = " ".join(first[:30])
    lines = "\n".join([line] + [" ".join(some(9)) for _ in range(30_000)] + [line.upper(), ""])
    texts = [" ".join(first), " ".join(second), " ".join(third), lines, line, None, "", line + "\n" + line]
    return [(k * 7, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame([(d, t, "h") for d, t in long_rows], "doc_id long, text string, source string").repartition(2)


def windows_gone(words: list, span: int, seen: Counter) -> int:
    edge, gone = 0, 0
    for i in range(len(words) - span + 1):
        if seen[hash(tuple(words[i : i + span]))] > 1:
            gone += i + span - max(edge, i)
            edge = i + span
    return gone


def test_long_words(long_docs, long_rows):
    from xxhash import xxh64_intdigest

    from plexigraph.llm.lm import lm_scores
    from plexigraph.llm.mixing import word_count
    from plexigraph.llm.quality import quality
    from plexigraph.llm.rlz import word_span_dedup
    from plexigraph.llm.simhash import simhash_groups

    words = {d: data(t).split() for d, t in long_rows}
    assert sorted(map(len, words.values()))[-1] > 500_000
    got = {r["doc_id"]: r for r in quality(long_docs).collect()}
    for d, w in words.items():
        own = Counter(hash(tuple(w[i : i + 8])) for i in range(len(w) - 7))
        assert (got[d]["n_words"], got[d]["n_repeat_words"]) == (len(w), windows_gone(w, 8, own)), d
    seen = Counter(hash(tuple(w[i : i + 35])) for w in words.values() for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in word_span_dedup(long_docs).collect()}
    assert {d: (r["n_words"], r["n_removed"]) for d, r in got.items()} == {d: (len(w), windows_gone(w, 35, seen)) for d, w in words.items()}
    got = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash_groups(long_docs).collect()}
    for d, t in long_rows:
        w = low(data(t)).split()
        hs = np.array([xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else [], np.uint64)
        assert got[d] == sum(1 << j for j in range(64) if 2 * int((hs >> np.uint64(j) & np.uint64(1)).sum()) > len(hs)), d
    train = Counter()
    for d, t in long_rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*low(data(t)).split(), b"\n"])
    n, v = sum(train.values()), len(train)
    for r in lm_scores(long_docs).collect():
        w = [*low(data(dict(long_rows)[r["doc_id"]])).split(), b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in train for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) and r["score"] < 0
    assert {r["doc_id"]: r["n"] for r in long_docs.select("doc_id", word_count("text").alias("n")).collect()} == {d: len(w) for d, w in words.items()}


def test_long_bytes(long_docs, long_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from plexigraph.llm.exact import exact_dedup
    from plexigraph.llm.linededup import line_dedup
    from plexigraph.llm.mixing import mixed
    from plexigraph.llm.packing import pack_documents
    from plexigraph.llm.pfp import substring_dedup

    first: dict[int, int] = {}
    for d, t in long_rows:  # in order of doc_id
        b = data(t)
        for i in range(len(b) - 49):
            first.setdefault(hash(b[i : i + 50]), d)
    want = {}
    for d, t in long_rows:
        b, edge, gone, spans = data(t), 0, 0, 0
        for i in range(len(b) - 49):
            if first[hash(b[i : i + 50])] < d:
                spans += i > edge or not gone
                gone += i + 50 - max(edge, i)
                edge = i + 50
        want[d] = (len(b), gone, spans)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring_dedup(long_docs).collect()} == want
    assert {r["doc_id"]: (r["keep_id"], r["text_sha256"]) for r in exact_dedup(long_docs).collect()} == {d: (42 if not t else d, sha(low(data(t)))) for d, t in long_rows}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup(long_docs).collect()}
    assert got == {d: ((t or "").count("\n") + 1, {21: 2, 28: 1}.get(d, 0)) for d, t in long_rows}
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in pack_documents(long_docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {d: len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in long_rows}
    total = sum(len(data(t).split()) for _, t in long_rows)
    assert sum(len(r["text"].split()) for r in mixed(long_docs).collect()) == math.floor(1.5 * total)


def test_long_url(spark):
    from plexigraph.llm.urlfilter import judge_urls, rule_table

    url = "http://" + "a." * 100 + "example.com/en/7" + "x" * 300_000
    got = judge_urls(spark.createDataFrame([(1, url), (None, url[:250])], "page_id long, url string"), rule_table(spark)).collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in got} == {(1, "example.com/en/7", "allow"), (None, "example.com/en/7", "allow")}


def brute_quality(rows):
    """Rows that pass the base rules; no host of these fails as a whole."""
    out = []
    for r in rows:
        w = data(r[1]).split()
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w):
            out.append(r)
    return out


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r").encode()).decode()
    holds: dict[str, list] = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holds.setdefault(k, []).append(r[0])
    out = []
    for r in rows:
        last = {k: max((y for y in holds[k] if y is not None), default=None) for k in map(key, (r[1] or "").split("\n"))}
        kept = [x for x in (r[1] or "").split("\n") if not (len(key(x)) >= 20 and len(holds[key(x)]) >= 3 and last[key(x)] not in (None, r[0]))]
        text = "\n".join(kept)
        out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def brute_similar(rows):
    sets = []
    for r in rows:
        w = low(data(r[1])).split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    best = {}
    for i, g in enumerate(group):
        k = (math.inf if rows[i][0] is None else rows[i][0], i)
        best[g] = min(best.get(g, k), k)
    return [rows[i] for _, i in best.values()]


def test_pipeline(spark, docs, none, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    stages, want = docs, list(rows)
    kept = ["doc_id", "text", "lang", "source", "n_chars", "g", "before", "fp", "`a.b`"]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], (brute_quality, brute_lines, brute_similar)):
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        stages, want = stage(spark, stages, str(tmp_path)), brute(want)
        assert stages.columns == docs.columns
        columns = [c for c in kept if c != "before"] if name == "simhash_near_dedup" else kept  # of equal rows any one stays
        at = [kept.index(c) for c in columns]
        assert bag(stages, *columns) == Counter(tuple(r[i] for i in at) for r in want), name
    mixed = corpus_pipeline.STAGES[3][1](spark, stages, str(tmp_path))
    total = Counter()
    for r in want:
        total[r[3]] += len(data(r[1]).split())
    target = brute_targets(total)
    taken = Counter()
    whole = {(r[0], r[1]) for r in want}
    for r in mixed.collect():
        taken[r["source"]] += len(data(r["text"]).split())
        assert (r["doc_id"], r["text"]) in whole or any(d == r["doc_id"] and t.startswith(r["text"]) for d, t in whole)
    assert taken == Counter({s: math.floor(t + 1e-9) for s, t in target.items()}) and mixed.columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert bag(got, *keys) == bag(packed, *keys)
    lengths = [r["length"] for r in got.collect()]
    assert got.select("sequence_id").distinct().count() <= best_fit_decreasing(lengths, 2048)
