"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.quality import quality

    return quality(_docs(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.pfp import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.lm import lm_scores

    return lm_scores(_docs(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.rlz import word_span_dedup

    return word_span_dedup(_docs(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.simhash import simhash_groups

    return simhash_groups(_docs(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plexigraph.llm.packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.mixing import mix, word_count
    from plexigraph.session import materialize

    sizes = materialize(_docs(spark, sf_dir).select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return mix(sizes).drop("source")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.urlfilter import judge_urls, rule_table

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.exact import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexigraph.llm.linededup import line_dedup

    return line_dedup(_docs(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return {k: own[k] for k in sorted(own, key=lambda k: int(k[2:].split("_")[0]))}


#: DuckDB's form of lower-casing A-Z only.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_SQL = {
    "op1_quality_rules": f"""
        WITH t AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
        d AS (SELECT *, {_WORDS.format("text")} AS w FROM t),
        win AS (SELECT k, w[i : i + 7] AS g, i FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
        rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
        rw AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, range(8) r(j) GROUP BY k),
        ln AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM t) WHERE len({_WORDS.format("l")}) > 0 GROUP BY k),
        b AS (SELECT d.k, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
              FROM d LEFT JOIN rw USING (k) LEFT JOIN ln USING (k)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
        h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f WHERE source IS NOT NULL GROUP BY source),
        m AS (SELECT sum(x) / sum(n) AS mean, sum(n) AS docs, sum(x * x / n) AS s, sum(n * n) AS q, count(*) AS hosts FROM h),
        v AS (SELECT mean, hosts, mean * (1 - mean) AS chance, (s - docs * mean * mean - mean * (1 - mean) * (hosts - 1)) / greatest(docs - q / docs - (hosts - 1), 1e-9) AS var FROM m),
        p AS (SELECT mean, hosts < 2 OR var > 1e-12 AS finite, CASE WHEN hosts < 2 OR var <= 1e-12 THEN 0 ELSE greatest(0, chance / var - 1) END AS s FROM v),
        hv AS (SELECT source, round(CASE WHEN finite THEN (x + mean * s) / (n + s) ELSE mean END, 9) AS host_rate FROM h, p)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(host_rate < 0.5, true) AS kept, f.source, host_rate
        FROM f LEFT JOIN hv ON f.source = hv.source""",
    "op6_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT k, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
        mark AS (SELECT DISTINCT k, i + j AS p FROM rep, range(35) r(j)),
        one AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        t AS (SELECT one.k, count(mark.p) AS n, string_agg(word, ' ' ORDER BY one.p) FILTER (mark.p IS NULL) AS kept FROM one LEFT JOIN mark ON mark.k = one.k AND mark.p = one.p GROUP BY one.k)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (k)""",
    "op9_url_filters": """
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u),
        p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s),
        r(action, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        f AS (SELECT p.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
              FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.page_id)
        SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op10_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
