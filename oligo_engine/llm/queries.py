"""Registered queries of the corpus operators: thin calls over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from oligo_engine.llm import (
    chunk_dedup,
    decontamination,
    filter_audit,
    language_id,
    minhash,
    mixing,
    neighbours,
    ranked_search,
    simhash,
    suffix_dedup,
    token_counts,
    toxic_text,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(table(spark, sf, "documents"), length=400).drop("removed")


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10)


@query("op3_token_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunk_dedup.dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxic_text.toxicity(docs, table(spark, sf, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 3))::BIGINT AS bucket
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS clamp_at, sum(source_size) OVER () AS every
  FROM totals),
ranked AS (SELECT *, clamp_at / weight AS full_at FROM weighted),
levels AS (
  SELECT *, (every * 1.5::DOUBLE - coalesce(sum(clamp_at) OVER (ORDER BY full_at, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (SELECT min_by(level, full_at) AS level FROM levels WHERE level <= full_at),
targets AS (
  SELECT source, source_size, CASE WHEN c.level IS NULL THEN clamp_at ELSE least(clamp_at, c.level * weight) END AS target
  FROM ranked CROSS JOIN chosen c),
filled AS (SELECT source, bucket, sum(size)::BIGINT AS words FROM sized GROUP BY source, bucket),
plan AS (
  SELECT f.source, f.bucket, f.words, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(f.words) OVER (PARTITION BY f.source ORDER BY f.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM filled f JOIN targets t ON f.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, CASE WHEN words <= 0 THEN 0 ELSE greatest(0.0, least(1.0, (target - whole * source_size - before) / words)) END AS part FROM plan)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
       CAST(d.size * p.whole + floor(d.size * p.part + 0.5) AS BIGINT) AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source AND d.bucket = p.bucket
"""


@query("op6_source_mixing", MIX_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2)


WARC_SQL = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_page FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
       CASE WHEN first_page IS NOT NULL AND first_page IS DISTINCT FROM r.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page IS NOT NULL AND first_page IS DISTINCT FROM r.page_id THEN first_page END AS refers_to
FROM rows r LEFT JOIN firsts f ON r.payload_digest = f.payload_digest AND r.payload_bytes >= 100
"""


@query("op7_warc_round_trip", WARC_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages"), least=100)


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op9_minhash_near_duplicates")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), words=2, percent=80)


@query("op10_language_id")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents").select("doc_id", "text", "lang"))


AUDIT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
judged AS (
  SELECT d.doc_id, d.part,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text),
          regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > f.first, false)] AS fails,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM words d JOIN firsts f ON d.text = f.text
  LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l
    ON d.doc_id = l.doc_id),
orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
steps AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own,
         list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
classes AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
seen AS (
  SELECT c.*, s.filter_order, s.step, s.own, fails[s.own] AS hit,
         len(list_filter(s.before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM classes c, steps s),
summed AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN hit AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_simhash_near_duplicates")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), words=3, bits=3)


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
stated AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM stated),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
posted AS (
  SELECT term, doc_id, n, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, n, unnest(w) AS term FROM stated) SEMI JOIN asked USING (term) GROUP BY term, doc_id, n),
weighted AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posted, whole GROUP BY term, nn),
scored AS (
  SELECT a.item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM asked a JOIN posted p USING (term) JOIN weighted USING (term), whole GROUP BY a.item_id, p.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


@query("op12_ranked_search", SEARCH_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)
