"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import byte_bpe, common, decontaminate, divergence, exact_dedup, filter_audit, html_text, language, lm_scoring, secrets, simhash, token_counts, token_files, toxicity

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
END_ID = 2


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.refine(common.documents(spark, sf_dir), every_digest=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(WORD_TOKENIZER)).drop("text")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.documents(spark, sf_dir), common.text_bucket("doc_id", 3) == 1
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.documents(spark, sf_dir), common.text_bucket("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs)).drop("text")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.new_path(spark, "token-files")
    token_files.write(common.documents(spark, sf_dir), out, public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_files.read(spark, out)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN).drop("text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(common.documents(spark, sf_dir), common.text_bucket("doc_id", 10) == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.documents(spark, sf_dir))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_token_files": op7_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_html_text": op13_html_text,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    # every order applied step by step, each step's own counts summed for shapley
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
            FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (len(words) < 200)::INT
                   + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT
                   + 16 * coalesce(w.doc_id > first, false)::INT AS mask
            FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
              WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
        s AS (
            SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
                   list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::INT AS before
            FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM r
    """,
    # every kept term of a language beside every group, zeros included
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT id, lang, source,
                   unnest(list_transform(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
            FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (
            SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS lang_total, coalesce((SELECT sum(n) FROM c WHERE c.lang = a.lang AND c.source = a.source), 0) AS total
            FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN v USING (lang)),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_total + g.v) AS q
            FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
        s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS rank FROM r)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM s WHERE part = 'pair' OR rank <= 200
    """,
    # on pages whose articles are article elements with headings and paragraphs alone
    "op13_html_text": r"""
        WITH a AS (
            SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's'), '</?(p|h1)[^>]*>', chr(1), 'g') AS x
            FROM pages),
        b AS (
            SELECT page_id, url, list_transform(string_split(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)),
                   lambda y: trim(regexp_replace(replace(replace(replace(replace(replace(replace(y, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&#x27;', chr(39)), '&amp', '&'), '[\s]+', ' ', 'g'))) AS blocks
            FROM a),
        c AS (SELECT page_id, url, list_transform(blocks, lambda y: replace(y, '&;', '&')) AS blocks FROM b)
        SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda y: y <> ''), chr(10)), '') AS text,
               length(coalesce(array_to_string(list_filter(blocks, lambda y: y <> ''), chr(10)), ''))::BIGINT AS n_chars
        FROM c
    """,
}
