"""Quality rules (1): rule failures of single documents, and verdicts on their hosts.

A document fails the base rules if it has under 20 words, or if over 30 % of its words lie in 8-word
windows that the text holds twice or more.  Failures are summed by host (the ``source`` column), each
host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of
moments), and hosts whose shrunk rate reaches ``host_limit`` lose all their documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plexigraph.llm.common import packed, slices, text_bytes, unpacked
from plexigraph.session import materialize

#: The symbols that are counted, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8

RULES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document inside a window of WINDOW words that the same document holds twice or more.

    Windows get exact ranks by doubling: ranks of 2, 4 and 8 words, each from two ranks of half the length.
    """
    n = len(ids)
    if n < WINDOW:
        return np.zeros(n_docs, np.int64)
    rank, span = ids, 1
    while span < WINDOW:
        pair = rank[: len(rank) - span] * np.int64(rank.max() + 1) + rank[span:]
        rank, span = np.unique(pair, return_inverse=True)[1], span * 2
    starts = np.arange(n - WINDOW + 1)
    starts = starts[doc[starts] == doc[starts + WINDOW - 1]]
    own = np.unique(rank[starts] * np.int64(n_docs) + doc[starts], return_inverse=True, return_counts=True)
    hit = starts[own[2][own[1]] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=n_docs).astype(np.int64)


def measure(texts: list[bytes], chars: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts of each text; ``chars``: code points of each."""
    number: dict[bytes, int] = {}
    ids: list[np.ndarray] = []
    n_words, white, symbols, lines = [], [], [], []
    for b in texts:
        words = b.split()
        for w in words:
            if w not in number:
                number[w] = len(number)
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        n_words.append(len(words))
        white.append(len(b) - len(b.translate(None, SPACES)))
        symbols.append(len(b) - len(b.translate(None, SYMBOLS)))
        real = [x for x in b.split(b"\n") if x.strip()]
        lines.append(len(real) - len(set(real)))
    count = np.array(n_words, np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return {
        "n_words": count, "word_chars": chars - np.array(white, np.int64), "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": _repeated(every, doc, max(1, len(texts)))[: len(texts)],
    }


@arrow_udf(RULES)
def rule_counts(text: pa.Array) -> pa.Array:
    """The counts, taken over about 2 MB of text at a time."""
    parts = []
    for s, e in slices(text, 2 << 20):
        some = text.slice(s, e - s)
        parts.append(measure(text_bytes(some), pc.utf8_length(some).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    names = [f.name for f in RULES.fields]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64)) for n in names], names)


def _failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < 20) | (100 * F.col(f"{c}.n_repeat_words") > 30 * F.col(f"{c}.n_words"))


def fit_beta(n: float, failed: float, sum_nrr: float, sum_nn: float, hosts: int) -> tuple[float, float]:
    """(mean, strength) of the hosts' beta prior by the method of moments.

    Of the spread of the hosts' rates, weighed by documents, what their own chance explains is taken off: with
    k hosts of n_i documents, N in all, the expected sum of n_i (r_i - mean)^2 is
    var (N - sum n_i^2 / N - (k - 1)) + mean (1 - mean) (k - 1).  The strength, the prior's worth in documents, is
    mean (1 - mean) / var - 1.  If nothing is left of the spread, hosts do not differ and the strength is infinite;
    a spread wider than any beta prior's has strength 0 (rates as they are); a single host has 0 too.
    """
    if not n or hosts < 2:
        return (failed / n if n else 0.0), 0.0
    mean = failed / n
    chance = mean * (1 - mean)
    var = (sum_nrr - n * mean * mean - chance * (hosts - 1)) / max(n - sum_nn / n - (hosts - 1), 1e-9)
    if var <= 1e-12:
        return mean, math.inf
    return mean, max(0.0, chance / var - 1)


def host_verdicts(failures: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """``failures``: (source, failed).  One row a host: host_docs, host_failed, host_rate (shrunk), host_kept."""
    hosts = failures.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    hosts = materialize(hosts, "hosts")
    docs, x = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    n, f, s, q, k = hosts.agg(F.sum(docs), F.sum(x), F.sum(x * x / docs), F.sum(docs * docs), F.count(F.lit(1))).first()
    mean, strength = fit_beta(n or 0.0, f or 0.0, s or 0.0, q or 0.0, k)
    rate = F.lit(mean) if math.isinf(strength) else (x + F.lit(mean * strength)) / (docs + F.lit(strength))
    return hosts.withColumn("host_rate", F.round(rate, 9)).withColumn("host_kept", F.col("host_rate") < host_limit)


def quality(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Rule counts and verdicts of every document.

    Returns doc_id, the five counts, base_failed, source, host_rate, kept.  kept is false if the base rules
    failed or the host's verdict is against it.

    Defined cases: a null text has no words (and so fails); a document of null source belongs to no host and
    is judged alone (host_rate null); rows repeated count as often as they occur; empty tables give no rows;
    other columns are not read.  A text is never cut: one of any length is counted by itself, which takes some 60
    bytes of memory a word in a Python worker.
    """
    rules = materialize(docs.select("doc_id", "source", rule_counts("text").alias("r")), "rules")
    judged = rules.select("doc_id", "source", "r.*", _failed("r").alias("base_failed"))
    hosts = host_verdicts(judged.select("source", F.col("base_failed").alias("failed")), host_limit)
    out = judged.join(hosts.select(F.col("source").alias("host"), "host_rate", "host_kept"), F.col("source") == F.col("host"), "left")  # a row a host: Spark broadcasts it if it is small
    return out.select("doc_id", *[f.name for f in RULES.fields], "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "source", "host_rate")


def keep_good(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that :func:`quality` rejects; all columns stay.

    Texts are read twice, once for the hosts' sums and once for the rows that stay, and never shuffled.

    Defined cases: those of :func:`quality`; columns of any name stay as they are.
    """
    hosts = host_verdicts(docs.select("source", rule_counts("text").alias("r")).select("source", _failed("r").alias("failed")), host_limit)
    bad = hosts.where(~F.col("host_kept")).select(F.col("source").alias("__host"))
    rows = docs.select(packed(docs), rule_counts("text").alias("__r")).where(~_failed("__r"))
    return unpacked(rows.join(bad, F.col("__row.source") == F.col("__host"), "left_anti"), docs.columns)
