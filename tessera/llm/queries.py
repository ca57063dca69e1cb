"""The queries of this subpackage: thin contracts over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import common, html, language, mixing, near, packing, personal, quality, search, substrings, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files make fewer tasks than there are cores is dealt to all of them first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op10_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_source_mix, op2_warc_archive, op3_site_style_tree, op4_best_fit_packing, op5_quality_rules, op6_personal_data, op7_minhash_forest, op8_language_id, op9_suffix_dedup, op10_maxscore_search)
}

#: Where the result is a function of the tables that SQL can state. The others are tested against brute force or held-out accuracy.
ORACLE: dict[str, str] = {
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
        b AS (SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(h, CAST(floor(k / 4) AS BIGINT) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)),
                'string_agg', '') AS payload_digest,
              min(page_id) OVER (PARTITION BY html) AS leader FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> leader THEN leader END AS refers_to
        FROM b""",
    "op5_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        a AS (SELECT doc_id, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
        x AS (SELECT doc_id, unnest(range(len(w) - 4)) AS i, w FROM a WHERE len(w) > 4),
        g AS (SELECT doc_id, i, list_slice(w, i + 1, i + 5) AS five FROM x),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS f(k) WHERE n > 1 GROUP BY doc_id),
        m AS (SELECT a.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
        h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
        p AS (SELECT least(greatest(avg(failed / n), 1e-4), 1 - 1e-4) AS mean, coalesce(var_samp(failed / n), 0) AS spread, avg(1 / n) AS inverse FROM h),
        s AS (SELECT mean, greatest(spread - mean * (1 - mean) * inverse, 0) AS beyond FROM p),
        k AS (SELECT mean, CASE WHEN beyond > 0 THEN greatest(1, least(1e6, mean * (1 - mean) / beyond - 1)) ELSE 1 END AS strength FROM s),
        v AS (SELECT source, true AS bad FROM h, k WHERE n >= 20 AND (failed + mean * strength) / (n + strength) > 0.5)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND bad IS NULL AS kept, bad IS NOT NULL AS host_failed
        FROM f LEFT JOIN v USING (source)""",
    "op7_minhash_forest": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') || CASE WHEN len(w) < 3 THEN chr(10) || len(w) ELSE '' END AS s FROM x),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
        m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op10_maxscore_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
