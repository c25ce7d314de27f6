"""Durable intermediate tables, lineage cuts and small shared helpers of the corpus operators."""

from __future__ import annotations

import gc
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no shared folder, such as unit tests.
FALLBACK_DIR = "/tmp/tessera-checkpoints"


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir``, the folder that all executors share.

    ``save`` writes a frame once and returns the frame read back: the lineage ends there, so a lost
    executor costs a re-read and not a recomputation. ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = FALLBACK_DIR
        self.root = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Lets Spark's context cleaner remove the shuffle files of plans that are no longer referenced.

        What the first collection lets go of is seen by the second only: after one, the files of the last plan stay.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, as single texts can hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model sees: crc32 of the id's decimal text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], doc_id: str, text: str, extra: Column | None = None) -> DataFrame:
    """_id, _text, _label of at most ``rows`` ids of label 0 and of label 1 that aren't held out.

    The ids with the smallest hashes are drawn from the labels alone, so at most sum(rows) of them are
    broadcast to the documents and no text is dealt out. An id with both labels counts as label 1; null ids,
    labels and texts aren't drawn; of several texts of an id the smallest is taken.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_label")).where(~held_out(F.col("_id")))
    draw = lambda value: marked.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows[value])
    drawn = draw(0).unionByName(draw(1))
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = found if extra is None else found.where(extra)
    return found.join(F.broadcast(drawn), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, compared without case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
