"""Shards of near equal bytes by sampled splitters; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fine ranges a shard is made of, weighted samples a range is cut from, and most bytes of a range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, RANGE_BYTES = 64, 8, 256 << 20
#: A range of over this many times the mean is subdivided.
OVERFULL = 1.5
#: Tables of ranges are broadcast up to so many rows (of some 50 bytes), which is 50 TB of input; else rows are joined.
BROADCAST_RANGES = 200_000
#: Leading bits of a key that join a row to the few ranges near it.
PREFIX_BITS = 12


def _prefix(key):
    return F.shiftright(key, 64 - PREFIX_BITS)


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deals all rows into ``shards`` shards whose bytes are near equal.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32, shard and slot,
    gapless from 0 in each shard. Rows are ordered by (hash of the text, doc_id): size-weighted samples
    of that key give quantile boundaries of ``64 * shards`` ranges (more when a range would pass 256 MB),
    the exact bytes of each range are summed, an overfull range (one text that many rows share, say) is
    subdivided by a hash of the text, a text of over a mean range's bytes by a hash of the id, and whole parts go to
    shards by their cumulative bytes. So only texts that fill a range alone are parted. Windows without a partition see
    a row or, for samples, eight for each range or part, so one for each 32 MB. Repeated rows are rows of their own; null ids and
    texts are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = scratch.save(
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("key"))
        .withColumn("salt", F.xxhash64("doc_id", "key", F.lit(1))),
        "rows",
    )
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    n_ranges = max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    step = max(1.0, total / (n_ranges * SAMPLES_PER_RANGE))
    # A row is drawn once for each whole step of its size, and for the rest with that chance.
    uniform = F.pmod(F.xxhash64("salt", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select("key", F.floor(F.col("size") / step + uniform).alias("weight")).where("weight > 0").groupBy("key").agg(F.sum("weight").alias("weight"))
    upto = F.sum("weight").over(Window.orderBy("key"))
    cuts = sample.select("key", upto.alias("upto"), "weight").where(F.floor(F.col("upto") / SAMPLES_PER_RANGE) > F.floor((F.col("upto") - F.col("weight")) / SAMPLES_PER_RANGE)).select("key")
    low, high = -(1 << 63), (1 << 63) - 1
    bounds = Window.orderBy("key")
    ranges = (
        cuts.unionByName(cuts.sparkSession.range(1).select(F.lit(high).alias("key"))).distinct()
        .select("key", F.lag("key").over(bounds).alias("before"), F.row_number().over(bounds).alias("range"))
        .select("range", F.coalesce(F.col("before") + 1, F.lit(low)).alias("first"), F.col("key").alias("last"))
        .withColumn("prefix", F.explode(F.sequence(_prefix(F.col("first")), _prefix(F.col("last")))))
    )
    ranges = scratch.save(ranges, "ranges")
    small = F.broadcast if n_ranges <= BROADCAST_RANGES else lambda table: table
    placed = rows.withColumn("prefix", _prefix(F.col("key"))).join(small(ranges), "prefix").where("key between first and last").drop("prefix", "first", "last")
    mean = total / n_ranges if n_ranges else 1
    placed = scratch.save(placed, "placed")
    over = placed.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * mean)
    over = scratch.save(over, "overfull")
    # Texts that fill a range alone are at most as many as there are ranges.
    texts = placed.join(small(over.select("range")), "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("own"))
    heavy = texts.where(F.col("own") > mean).withColumn("own_parts", F.ceil(F.col("own") / mean))
    before = F.sum("own_parts").over(Window.partitionBy("range").orderBy("key")) - F.col("own_parts")
    heavy = scratch.save(heavy.withColumn("base", before), "heavy")
    rest = over.join(heavy.groupBy("range").agg(F.sum("own").alias("taken")), "range", "left")
    rest = rest.select("range", F.greatest(F.lit(1), F.ceil((F.col("bytes") - F.coalesce("taken", F.lit(0))) / mean)).alias("parts"))
    split = placed.join(small(rest), "range", "left").join(small(heavy.select("range", "key", "own_parts", "base")), ["range", "key"], "left")
    by_id = F.col("parts") + F.col("base") + F.pmod(F.col("salt"), F.col("own_parts"))
    by_text = F.pmod(F.xxhash64("key", F.lit(3)), F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.coalesce(by_id, by_text)).drop("parts", "own_parts", "base")
    split = scratch.save(split, "split")
    # One row for each range and part: at most a few times n_ranges, whatever the input holds.
    sums = split.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    order = Window.orderBy("range", "part")
    middle = F.sum("bytes").over(order) - F.col("bytes") / 2
    chosen = sums.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int"))
    offsets = chosen.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("n")).select("range", "part", "shard", "before")
    offsets = scratch.save(offsets, "offsets")
    within = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", F.col("doc_id").asc_nulls_first()))
    scratch.drop("rows", "ranges", "placed", "overfull", "heavy")
    out = split.join(small(offsets), ["range", "part"]).withColumn("slot", (F.col("before") + within - 1).cast("long"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
