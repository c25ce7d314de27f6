"""A corpus made ready for training: toxicity, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, similar, subwords, suffix_dedup
from tessera.llm.scratch import free_name

#: Passages of so many words are repeats, however few bytes they have.
PASSAGE_WORDS = 51


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as toxic (0.5 or more) go.

    Null and empty texts have the model's prior. All other rows stay as they are, repeated ones and null ids too;
    with no labels all have the same prior. An empty table gives none.
    """
    model = subwords.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", subwords.TOXICITY)
    return docs.where(subwords.scorer(docs, model)(F.coalesce("text", F.lit(""))) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles) the document with the smallest id stays.

    Candidates are found by SimHash, and by an exact join for pairs whose fingerprints lie too far apart; all are
    verified. Texts without words, or null, are copies of each other; null ids come last. Rows are told apart by a hash of id and text; of rows that repeat both, compared as they are, one
    stays, and their texts are only dealt out where hashes repeat. Other columns stay as they are.
    """
    own = free_name(docs, "row_key")
    keep = similar.near_duplicates(docs).withColumnRenamed("rk", own)
    kept = docs.withColumn(own, similar.keyed(docs)).join(keep, own, "left_semi")
    repeated = kept.groupBy(own).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    return (kept if repeated.isEmpty() else kept.dropDuplicates([own, "doc_id", "text"])).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes, that occur more than once go.

    Judged on the stage's own input, all its rows at once: repeated rows repeat each other. No row goes; null and empty
    texts, and null ids, stay as they are. An empty table gives none.
    """
    cleaned = suffix_dedup.remove_repeats(docs, words=PASSAGE_WORDS)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its five-word shingles) go. Rows are told apart by id and text.

    Null and empty texts hold nothing and stay; with no benchmark, or none with words, all rows stay.
    """
    own = free_name(docs, "row_key")
    marked = docs.withColumn(own, similar.keyed(docs))
    hits = decontaminate.contained_items(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=own)
    leaks = hits.select(F.col("doc_id").alias(own)).distinct()
    return marked.join(leaks, own, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as sequences of at most 2048 tokens: a row for each piece of a document.

    Null and empty texts are documents of a separator alone; repeated rows and null ids are documents of their own.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("benchmark_decontamination", decontamination), ("best_fit_packing", packed)]

#: No SQL: the stages learn, hash and pack. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read again by the next."""
    from tessera.llm.scratch import Scratch

    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
