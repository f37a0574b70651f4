"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonon.llm import bpe, cap_filters, langid, minhash, pii, prefix_trie, quality_rules, secret_scan, url_filter, whitening
from phonon.llm.exact_dedup import exact_groups
from phonon.llm.packing import pack
from phonon.llm.token_store import read_store, write_store

BPE_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))
    return read_store(spark, folder)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with surrogates; the key is a placeholder for the deployment's secret."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="deployment-secret")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
                    for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(_table(spark, sf_dir, "embeddings"))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures. The table has no fetch time, so its day follows from the page id."""
    return _table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("date_add(DATE '2024-01-01', cast(page_id % 366 as int))").alias("day"))


def _list_history(captures: DataFrame) -> DataFrame:
    """Dated list entries from what the captured URLs show on their day."""
    host, prefix = url_filter.host_of(F.col("url")), url_filter.prefix_of(F.col("url"), 1)
    entry = F.expr("""CASE
        WHEN url LIKE '%casino%' THEN named_struct('scope', 'domain', 'category', 'gambling', 'action', 'add')
        WHEN url LIKE '%utm_source=%' THEN named_struct('scope', 'host', 'category', 'tracking', 'action', 'add')
        WHEN url LIKE '%.html' THEN named_struct('scope', 'host', 'category', 'tracking', 'action', 'remove')
        WHEN url LIKE '%#top' THEN named_struct('scope', 'prefix', 'category', 'anchor', 'action', 'add')
        WHEN url LIKE '%/' THEN named_struct('scope', 'prefix', 'category', 'anchor', 'action', 'remove')
        END""")
    rows = captures.select("day", entry.alias("e"), host.alias("host"), prefix.alias("prefix"))
    return rows.where("e IS NOT NULL").select(
        "e.scope", F.expr("""CASE e.scope WHEN 'domain' THEN regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1)
                             WHEN 'host' THEN host ELSE prefix END""").alias("value"),
        "e.category", "day", "e.action")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    return url_filter.judge(captures, _list_history(captures)).select(
        "page_id", "day", "listed", "category", "entry_scope", "entry_value", "listed_since")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_documents(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt as stated: the first h turns of the hundred's first one, then their own."""
    c = F.col("c")
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), base=c - c % 100,
                                   borrowed=F.crc32(c.cast("string")) % 6)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_token_store": op4_token_store,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_secret_scan": op6_secret_scan,
    "op7_cap_filters": op7_cap_filters,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op8_url_filter": r"""
        WITH cap AS (
          SELECT page_id, url, DATE '2024-01-01' + cast(page_id % 366 AS INTEGER) AS day,
                 nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '') AS host,
                 nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS seg
          FROM pages),
        ent AS (
          SELECT day, CASE WHEN url LIKE '%casino%' THEN 'domain'
                           WHEN url LIKE '%utm_source=%' OR url LIKE '%.html' THEN 'host'
                           WHEN url LIKE '%#top' OR url LIKE '%/' THEN 'prefix' END AS scope,
                 CASE WHEN url LIKE '%casino%' OR url LIKE '%utm_source=%' THEN 1
                      WHEN url LIKE '%.html' THEN 0 WHEN url LIKE '%#top' THEN 1 ELSE 0 END AS on_,
                 host, seg FROM cap),
        rul AS (
          SELECT scope, CASE scope WHEN 'domain' THEN regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1)
                                   WHEN 'host' THEN host ELSE lower(host || '/' || seg) END AS value,
                 CASE scope WHEN 'domain' THEN 'gambling' WHEN 'host' THEN 'tracking' ELSE 'anchor' END AS category,
                 day, max(on_) AS on_
          FROM ent WHERE scope IS NOT NULL GROUP BY ALL),
        span AS (
          SELECT scope, value, category, day AS valid_from,
                 lead(day) OVER (PARTITION BY scope, value, category ORDER BY day) AS valid_to, on_
          FROM rul WHERE value IS NOT NULL),
        run AS (   -- consecutive days of additions are one interval, held since its first day
          SELECT *, max(CASE WHEN prev IS DISTINCT FROM 1 THEN valid_from END)
                      OVER (PARTITION BY scope, value, category ORDER BY valid_from) AS since
          FROM (SELECT *, lag(on_) OVER (PARTITION BY scope, value, category ORDER BY valid_from) AS prev
                FROM span) WHERE on_ = 1),
        hit AS (
          SELECT c.page_id, min(struct_pack(category := r.category, scope := r.scope, value := r.value,
                                            since := r.since)) AS best
          FROM cap c JOIN run r ON c.day >= r.valid_from AND (r.valid_to IS NULL OR c.day < r.valid_to)
           AND ((r.scope = 'host' AND r.value = c.host)
             OR (r.scope = 'domain' AND (c.host = r.value OR ends_with(c.host, '.' || r.value)))
             OR (r.scope = 'prefix' AND r.value = lower(c.host || '/' || c.seg)))
          GROUP BY c.page_id)
        SELECT c.page_id, c.day, h.best IS NOT NULL AS listed, h.best.category AS category,
               h.best.scope AS entry_scope, h.best.value AS entry_value, h.best.since AS listed_since
        FROM cap c LEFT JOIN hit h USING (page_id)""",
    "op10_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
          FROM documents),
        r AS (
          SELECT doc_id, sha,
                 first_value(doc_id) OVER w AS keep_id,
                 count(*) OVER (PARTITION BY sha) AS group_size,
                 row_number() OVER w = 1 AS kept
          FROM t WINDOW w AS (PARTITION BY sha ORDER BY length(text) DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, kept, sha AS text_sha256 FROM r""",
}
