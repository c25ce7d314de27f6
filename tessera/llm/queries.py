"""Queries opN_* with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontaminate, hard_negatives, packing, quality_rules, shards, simhash, subwords, suffix_dedup, tokens, url_rules, whitening
from .scratch import documents

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=3, max_bits=2)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_by_bytes(documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.quality(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_bytes(documents(spark, sf_dir), words=51)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return backoff.score(documents(spark, sf_dir), F.coalesce(remainder == 2, F.lit(False)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_simhash, op4_best_fit_packing, op5_toxicity, op6_sharding, op7_quality_classifier, op8_decontamination, op9_suffix_dedup, op10_url_filters, op11_backoff_automaton, op12_whitening, op13_hard_negatives)}

ORACLES = {
    "op8_decontamination": r"""
with words as (
  select 'd' kind, doc_id id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark),
widths as (select distinct least(5, len(w)) width from words where kind = 'i' and len(w) > 0),
wide as (
  select kind, id, w, least(5, len(w)) width from words where kind = 'i' and len(w) > 0
  union all
  select kind, id, w, width from words, widths where kind = 'd' and len(w) >= width),
shingles as (
  select distinct kind, id, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) s from wide),
sizes as (select id, count(*) n from shingles where kind = 'i' group by id),
shared as (select d.id doc_id, i.id item_id, count(*) k from shingles i join shingles d on d.s = i.s and d.kind = 'd' where i.kind = 'i' group by all)
select doc_id, item_id, n as n_shingles, k as n_shared, k / n as containment from shared join sizes on item_id = id where k >= ceil(0.8 * n - 1e-9)
""",
    "op10_url_filters": r"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path
  from pages),
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits as (
  select p.*, r.rhost || r.rpath as rule, r.verdict,
    row_number() over (partition by page_id, host, path order by length(rhost || rpath) desc nulls last) k
  from parts p left join rules r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hits where k = 1
""",
    "op13_hard_negatives": r"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id anchor_id, a.label own, r.vec_id id, r.label other, list_inner_product(a.v, r.v)::bigint score
  from rows a join rows r on a.vec_id % 100 = 0),
positives as (
  select anchor_id, id positive_id, score positive_score from scores where own = other and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
hard as (
  select s.anchor_id, positive_id, positive_score, id negative_id, score negative_score,
    row_number() over (partition by s.anchor_id, positive_id order by score desc, id)::int as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and own <> other and 100 * score between 30 * positive_score and 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from hard where rank <= 10
""",
}
