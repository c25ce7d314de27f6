"""The cache of fetched artefacts: what stays within its lifetime and budget."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_sums
from .validate import ArtefactValidationError

# Lifetime in seconds and budget in bytes.
TTL, BUDGET = 4 * 3600, 1 << 30


def upload_path(root: str, token: str) -> str:
    """Where an upload is kept; a token is one plain name, so no path leads out of the spool."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*", token) or ".." in token:
        raise ArtefactValidationError("Invalid upload id", token=token)
    return f"{root.rstrip('/')}/{token}"


def cached(spark: SparkSession, root: str, token: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame kept under ``token`` in the spool folder ``root``; it is made and written the first time."""
    path = upload_path(root, token)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """name, size, mtime (in seconds) of the spool's files, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("name"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def tokens(spark: SparkSession, root: str) -> DataFrame:
    """name, size, mtime of what the spool keeps: a token's files together, as old as the newest of them."""
    token = F.regexp_extract("name", "/([^/]+)/[^/]*$", 1)
    return listing(spark, root, "*.parquet").groupBy(token.alias("name")).agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))


def forget(spark: SparkSession, root: str, names: list[str]) -> None:
    """Deletes what is kept under these tokens, where there is anything."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(upload_path(root, name))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(files: DataFrame, now: int, ttl: int = TTL, budget: int = BUDGET, by: str | None = None) -> DataFrame:
    """Files (name, size, mtime) that stay: young enough, and newest first within the budget.

    Dropping the oldest until the rest fits keeps those whose running sum from the newest is in budget. The sum goes over
    ranges of time, so one spool may hold any number of files; ``by`` names the column that tells spools apart. A file
    without a time is too old, one without a size takes no room.
    """
    young = files.where(F.col("mtime") >= now - ttl)
    return running_sums(young, "size", [F.desc("mtime"), F.desc("name")], [by] if by else None).where(F.col("total") <= budget).drop("total")
