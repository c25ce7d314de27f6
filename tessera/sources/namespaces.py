"""Prefixes that artefacts declare, by expressions over their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURTLE = r"(?im)^\s*@?prefix\s+([\w.\-]*):\s*<([^>]*)>"
XMLNS = r"xmlns:([\w.\-]+)\s*=\s*[\"']([^\"']*)[\"']"


def declared(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, prefix, uri of Turtle and N3 prefixes and XML namespaces; the last declaration of a prefix holds."""
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("prefix"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("uri"))
    both = F.concat(pairs(TURTLE).cast("array<struct<prefix:string,uri:string>>"), pairs(XMLNS).cast("array<struct<prefix:string,uri:string>>"))
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(both).alias("k", "d"))
    return rows.groupBy("doc", F.col("d.prefix").alias("prefix")).agg(F.max_by("d.uri", "k").alias("uri"))


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return declared(files.select(F.col("path").alias("doc"), F.decode("content", "UTF-8").alias("text")))


def onto_models(models: DataFrame, found: DataFrame) -> DataFrame:
    """``models`` (doc, id) with namespaces, a map of their document's prefixes."""
    maps = found.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("prefix", "uri")))).alias("namespaces"))
    return models.join(maps, "doc", "left")
