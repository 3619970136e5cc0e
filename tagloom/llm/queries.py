"""Queries and SQL of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import ann, audit, chat, html_text, mixing, neardup, quality, repeats, secrets, segment, spelling, tokencount, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    write = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    joined = lambda spans: F.array_join(F.transform(spans, write), ",")
    return found.select("doc_id", *counts, F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.encode_documents(table(spark, sf_dir, "documents"), MODEL)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.chat_digest(turns.unionByName(own))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), MODEL)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.count_words(table(spark, sf_dir, "documents"), drop_every=97))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_toxicity, op3_hilbert_neighbours, op4_sentencepiece, op5_minhash_neardup, op6_suffix_dedup, op7_chat_format, op8_token_counts, op9_quality_rules, op10_source_mix, op11_spelling_variants, op12_html_extraction, op13_filter_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    esc = lambda c: f"replace(replace(replace(replace({c}, '\\', '\\e'), '<', '\\l'), '[', '\\k'), ']', '\\j')"
    chat_sql = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         length({esc("role")}) + length({esc("text")}) + 11 AS chars FROM c
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto, count(*) OVER (PARTITION BY conv_id) AS turns FROM w
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR n = turns THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""
    mix_sql = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), o AS (SELECT *, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS ord FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT *, (SELECT level FROM l WHERE cap >= weight * level ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS lev FROM l
), t AS (
  SELECT source, source_size, CASE WHEN lev IS NULL THEN cap ELSE least(cap, weight * lev) END AS target FROM g
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), k AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord ROWS UNBOUNDED PRECEDING) AS upto FROM o
)
SELECT k.doc_id, CAST(k.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(k.size * (p.whole + CASE WHEN target - whole * source_size > 0 AND k.upto - k.size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source"""
    audit_sql = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic
  FROM d
), m AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM o), w AS (
  SELECT m.*, filter_order, step, substr(filter_order, step, 1) AS filter,
         (a = 1 AND contains(left(filter_order, step - 1), 'A')) OR (b = 1 AND contains(left(filter_order, step - 1), 'B')) OR (c = 1 AND contains(left(filter_order, step - 1), 'C'))
         OR (d = 1 AND contains(left(filter_order, step - 1), 'D')) OR (e = 1 AND contains(left(filter_order, step - 1), 'E')) AS gone
  FROM m, steps
), v AS (SELECT *, CASE filter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 AS fails FROM w), r AS (
  SELECT part, filter_order, step, filter, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND a + b + c + d + e = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM v GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""
    return {"op7_chat_format": chat_sql, "op10_source_mix": mix_sql, "op13_filter_audit": audit_sql}
