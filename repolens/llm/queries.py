"""The registered query of each operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import chat, licenses, lm, mixing, neighbours, packing, quality, rules, simhash, urls
from repolens.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations, and from conversation -7 of control strings."""
    ship(spark)
    events = chat.as_events(table(spark, sf_dir, "conversations"))
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast(events.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("message"), F.col("id").alias("seq"), F.lit("message").alias("kind"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"),
    )
    return chat.digests(chat.format_events(events.unionByName(extra)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    ship(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of all sources."""
    ship(spark)
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by trees trained on labels outside the held-out fold."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the line rules' verdict of every document."""
    ship(spark)
    return rules.judge(table(spark, sf_dir, "documents")).drop("kept_words")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and trie scores of every document."""
    ship(spark)
    return lm.score(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in windows of at most 4096."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    ship(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    ship(spark)
    return urls.filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_license_scan": op2_license_scan,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_packing": op8_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_url_filters": op10_url_filters,
}



def oracle_sql() -> dict[str, str]:
    return SQL | {"op2_license_scan": licenses.oracle(), "op6_quality_rules": rules.oracle()}


SQL = {
    "op1_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(regexp_replace(text, '[\\\[<]', '--', 'g')) + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 ELSE 17 + length(regexp_replace(role, '[\\\]]', '--', 'g')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op10_url_filters": rf"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
rules(verdict, own, start, rule) AS (VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
  ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')),
hits AS (
  SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.own OR ends_with(p.host, '.' || r.own)) AND starts_with(p.path, r.start) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, h.rule,
  coalesce(h.verdict, CASE WHEN regexp_matches(p.low, '{urls.pattern_sql()}')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN hits h USING (page_id)""",
}
