"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, small_batches

#: Buckets of up to so many fingerprints are paired; larger ones are linked through common neighbours.
PAIRED = 32
BITS, HALF = 64, 32
#: Keys that several fingerprints have are broadcast up to so many (of some 64 bytes); else variants are dealt out again.
BROADCAST_KEYS = 1_000_000
#: Shingles hashed at a time, which bounds the bit matrix of a very long text.
BLOCK = 1 << 16


def fingerprint(text: str, width: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all ``width``-word shingles; A-Z lower-cased, no words: 0."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    total, n, block = np.zeros(BITS, np.int64), 0, []

    def add() -> None:
        nonlocal total
        bits = np.unpackbits(np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)

    for shingle in shingles:
        block.append(digest(b" ".join(shingle), 42))
        if len(block) == BLOCK:
            n += len(block)
            add()
            block.clear()
    if block:
        n += len(block)
        add()
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or "", width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(hashed, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """64 keys a fingerprint: the number of the bit left out, then the half that it is in without it."""
    half = F.expr("shiftright(fp, if(at < 32, 0, 32))").bitwiseAND(F.lit((1 << HALF) - 1))
    bit = F.expr("shiftright(fp, at)").bitwiseAND(F.lit(1))
    kept = half - bit * F.expr("shiftleft(1L, at % 32)")
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("at")).select("fp", (F.col("at").cast("long") * F.lit(1 << HALF) + kept).alias("key"))


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """fp with every value that differs from it in at most ``radius`` bits."""
    masks = [0] + [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(BITS), r)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return fps.select("fp", F.explode(F.lit(signed).cast("array<bigint>")).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("v"))


def links(fps: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that differ in at most ``max_bits`` (0 to 3) bits.

    They reach what all such pairs reach. Of two halves one differs by at most one bit, so both have a
    one-wildcard variant of a half in common: fingerprints meet by equality of variants and are verified.
    A pair is taken under the bit in which its halves differ, or under bit 0 if they don't. Buckets of over
    ``PAIRED`` fingerprints aren't paired: their members are linked through values near both, a ball
    around each of them, in which at most 65 (radius 1) or 2,081 (radius 2) fingerprints meet.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves settle up to 3 differing bits")
    variants = _variants(fps)
    met = scratch.save(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    scratch.free_shuffles()
    few_keys = met.count() <= BROADCAST_KEYS
    members = scratch.save(variants.join(F.broadcast(met) if few_keys else met.hint("merge"), "key"), "members")
    scratch.free_shuffles()
    few = members.where(F.col("n") <= PAIRED)
    bit = lambda name: F.expr(f"shiftright({name}, cast(shiftright(key, {HALF}) as int))").bitwiseAND(F.lit(1))
    one, two = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    first_bit = F.pmod(F.shiftright("key", HALF), F.lit(HALF)) == 0
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    within = one.join(two, "key").where((F.col("a") < F.col("b")) & ((bit("a") != bit("b")) | first_bit) & close).select("a", "b")
    many = members.where(F.col("n") > PAIRED).select("fp").distinct()
    near = max_bits // 2
    centres = _ball(many, near).groupBy("v").agg(F.min("fp").alias("b"))
    across = _ball(many, max_bits - near).join(centres, "v").select(F.col("fp").alias("a"), "b")
    return within.unionByName(across).where("a <> b").distinct()


def candidates(docs: DataFrame, scratch: Scratch, width: int, max_bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b) of ids for the user to verify: each row with the first of its fingerprint, and the first rows of
    fingerprints that ``links`` has. Repeated ids are one."""
    hashed = scratch.save(fingerprints(docs, width, doc_id, text), "hashed")
    first = scratch.save(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    own = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    across = links(first.select("fp"), max_bits, scratch).join(own("a"), "a").join(own("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return hashed.join(first, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).unionByName(across).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links.

    Texts link whose fingerprints differ in at most ``max_bits`` bits; equal fingerprints are one node, so
    copies cost nothing. Null texts and texts without words have fingerprint zero and link like any other.
    One row for each row. Null ids are kept and never become a component's id unless all of it is null;
    further columns are left out; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    hashed = scratch.save(fingerprints(docs, width, doc_id, text), "fingerprints")
    nodes = scratch.save(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp"), max_bits, scratch), scratch)
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    merged = rooted.where("root is not null")
    roots = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = merged.join(roots, "root").select("fp", "component_id").unionByName(rooted.where("root is null and n > 1").select("fp", F.col("least").alias("component_id")))
    named = scratch.save(named, "named")
    scratch.drop("nodes", "met", "members")
    out = hashed.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
