"""N-Triples as a stream: triples, classified types and windowed counts as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import type_frame
from ..sources.parse import nt_columns
from ..vocab import iri


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Triples of N-Triples files as they arrive, with the time of arrival."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return nt_columns(lines).withColumn("seen", F.current_timestamp())


def typed_stream(triples: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, cls, seen by rdf:type; a stateless join with the rule table."""
    rules = F.broadcast(type_frame(triples.sparkSession, dialect))
    return triples.where(F.col("p") == iri("rdf:type")).join(rules, "o").select(F.col("s").alias("id"), "cls", "seen")


def counts_by_class(typed: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    return typed.withWatermark("seen", late).groupBy(F.window("seen", window), "cls").agg(F.count("*").alias("n"))
