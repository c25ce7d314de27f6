"""Near-duplicates by Jaccard similarity of word shingles: a prefix-filter join that loses no pair, verified.

Put the distinct shingles of all texts into one order. Of two sets of a similarity of t or more, the first
n - ceil(t * n) + 1 shingles of each (its prefix) have one in common at least. Any order loses nothing;
shingles that many texts of a sample share come last, so that boilerplate meets only where it is nearly all
of a text. Pairs that their sizes or the places of a common shingle rule out aren't looked at, all others are
verified on the whole sets. Shingles are told apart by 64-bit hashes.

SimHash goes first: pairs that ``simhash.candidates`` finds by deletion variants are verified along with them. Texts
of a similarity of 0.8 often differ in more bits of a fingerprint than two halves settle; the join finds those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .scratch import Scratch, small_batches
from .suffix_dedup import _mix

WIDTH, THRESHOLD = 5, 0.8
#: Differing bits of fingerprints whose texts are candidates.
MAX_BITS = 3
#: Buckets of up to so many sets are paired; of larger ones, members first meet ``CENTRES`` of them.
PAIRED, CENTRES = 32, 4
#: Bits that sets are compared by first: in large buckets before they are paired, else before whole sets are.
BITMAP = 1024
#: One set in ``SAMPLE`` is looked at for common shingles: those of ``COMMON`` sets, at most ``MOST`` of them.
SAMPLE, COMMON, MOST = 4, 8, 200_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    own = min(width, len(words))
    total = single[: len(words) - own + 1] + np.uint64(own)
    for i in range(1, own):
        total = _mix(total, single[i : len(words) - own + 1 + i], 0x9E3779B97F4A7C15)
    return np.unique(total.view(np.int64))


def _name(hashes: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "big", signed=True)


def _sets(texts: DataFrame, width: int, schema: str, rows) -> DataFrame:
    """``rows`` of (rk, set) for each text, as a table of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in names]
            for rk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for column, values in zip(columns, rows(rk, shingle_set(text, width))):
                    column.append(values)
            flat = [np.concatenate(c) if c and isinstance(c[0], np.ndarray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flat, types)], names)

    return texts.select("rk", "text").mapInArrow(each, schema)


def _possible(threshold: float):
    """Whether sizes and places (from 0) of a shingle that a and b have in common allow the similarity."""
    least = F.expr(f"ceil({threshold / (1 + threshold)!r}D * (a_n + b_n) - 1e-6)")
    return (F.least(F.expr("a_n - a_i"), F.expr("b_n - b_i")) >= least) & F.expr(f"least(a_n, b_n) >= {threshold!r}D * greatest(a_n, b_n) - 1e-6")


def _bits(own: np.ndarray) -> np.ndarray:
    """A set as ``BITMAP`` bits, of which each element sets one."""
    bits = np.zeros(BITMAP, bool)
    bits[own.view(np.uint64) % np.uint64(BITMAP)] = True
    return np.packbits(bits).view(np.int64)


def _close(threshold: float):
    """Whether the bits of two sets allow the similarity: each bit that only one has is an element that only it has."""
    alone = lambda x, y: " + ".join(f"bit_count({x}_bits[{k}] & ~{y}_bits[{k}])" for k in range(BITMAP // 64))
    return F.expr(f"least(a_n - ({alone('a', 'b')}), b_n - ({alone('b', 'a')})) >= ceil({threshold / (1 + threshold)!r}D * (a_n + b_n) - 1e-6)")


def _side(members: DataFrame, side: str) -> DataFrame:
    return members.select(*[F.col(c).alias({"v": c, "sk": side}.get(c, f"{side}_{c}")) for c in members.columns])


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have at least ``threshold`` of their union in common.

    ``marks`` (sk, n, bits) rules most pairs out, so that few whole sets are written and dealt out.
    """
    pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"met-{name}")
    for side in ("a", "b"):
        pairs = pairs.join(_side(marks, side), side)
    pairs = scratch.save(pairs.where(_close(threshold)).select("a", "b"), f"pairs-{name}")
    scratch.drop(f"met-{name}")
    scratch.free_shuffles()
    asked = pairs.select(F.col("a").alias("sk")).unionByName(pairs.select(F.col("b").alias("sk"))).distinct()
    asked = nodes.join(asked, "sk", "left_semi").select("best.rk")
    arrays = scratch.save(_sets(texts.join(asked, "rk", "left_semi").dropDuplicates(["rk"]), width, "sk long, hashes array<long>", lambda rk, own: (_name(own), own.tolist())), f"sets-{name}")
    one, two = arrays.select(F.col("sk").alias("a"), F.col("hashes").alias("x")), arrays.select(F.col("sk").alias("b"), F.col("hashes").alias("y"))
    shared = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("total"))
    return scratch.save(shared.where(F.expr(f"k * {1 + threshold!r}D >= {threshold!r}D * total - 1e-6")).select("a", "b"), f"edges-of-{name}")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
    """A hash of id and text: what a row is told apart by. Null ids and repeated ids are nothing special."""
    return F.xxhash64(docs[doc_id], docs[doc_id].isNull(), F.coalesce(docs[text], F.lit("")))


def _common(texts: DataFrame, width: int) -> list[int]:
    """The shingles that most sets of a sample share, most frequent first. Copies count as one set: whether there are
    different ones is seen from the largest and the smallest name."""
    sampled = _sets(texts, width, "v long, sk long", lambda rk, own: (own, np.full(len(own), _name(own))) if _name(own) % SAMPLE == 0 else (own[:0], own[:0]))
    often = sampled.groupBy("v").agg(F.count("*").alias("k"), F.min("sk").alias("lo"), F.max("sk").alias("hi")).where(f"k >= {COMMON} and lo <> hi")
    return [r[0] for r in often.orderBy(F.desc("k"), "v").limit(MOST).select("v").collect()]


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rk (``keyed``) of the row that stays of each group of near-duplicates.

    Two texts are linked if the distinct ``width``-word shingles (A-Z lower-cased words between ASCII white
    space; a shorter text is one shingle) of both are at least ``threshold`` of those of either; texts without
    words, or null, are copies of each other. Groups are what links reach. The row with the smallest id stays,
    null ids after all others; of equal ids one by ``rk``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    texts = docs.select(keyed(docs, doc_id, text).alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(keyed(docs, doc_id, text).alias("rk"), F.col(doc_id).alias("id"))
    own = scratch.save(_sets(texts, width, "rk long, sk long, n int, bits array<long>", lambda rk, own: (rk, _name(own), len(own), _bits(own).tolist())), "own")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk")).alias("best")
    nodes = scratch.save(own.join(ids, "rk").groupBy("sk").agg(best, F.max("n").alias("n")), "nodes")

    marks = scratch.save(own.select("sk", "n", "bits").dropDuplicates(["sk"]), "marks")

    hinted = simhash.candidates(texts, scratch, width, MAX_BITS, "rk", "text")
    named = lambda side: own.select(F.col("rk").alias(side), F.col("sk").alias(f"sk_{side}")).distinct()
    hinted = hinted.join(named("a"), "a").join(named("b"), "b").select(F.col("sk_a").alias("a"), F.col("sk_b").alias("b")).where("a <> b")
    hinted = scratch.save(hinted.distinct(), "hinted")
    scratch.drop("hashed", "first", "met", "members")
    scratch.free_shuffles()

    common = _common(texts, width)
    scratch.free_shuffles()
    values = np.array(common, np.int64)
    by_value = np.argsort(values)
    shared = spark.sparkContext.broadcast((values[by_value], (len(values) - by_value).astype(np.int64)))

    def prefix(rk: int, own: np.ndarray) -> tuple[np.ndarray, ...]:
        known, ranks = shared.value
        rank = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            rank = np.where(known[at] == own, ranks[at], 0)
        first = own[np.lexsort((own, rank))][: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1 if len(own) else 0]
        return first, np.full(len(first), _name(own)), np.full(len(first), len(own), np.int32), np.arange(len(first), dtype=np.int32)

    entries = scratch.save(_sets(texts, width, "v long, sk long, n int, i int", prefix), "entries")
    again = scratch.save(entries.groupBy("v").agg(F.min("sk").alias("lo"), F.max("sk").alias("hi")).where("lo <> hi").select("v"), "again")
    scratch.free_shuffles()
    members = scratch.save(entries.join(again, "v").distinct(), "members")
    scratch.drop("entries", "again", "own")
    scratch.free_shuffles()
    centres = F.array(*[F.min(F.struct(F.xxhash64("sk", F.lit(k)).alias("h"), "sk"))["sk"] for k in range(CENTRES)])
    buckets = scratch.save(members.groupBy("v").agg(F.count("*").alias("size"), centres.alias("centres")), "buckets")
    few = scratch.save(members.join(buckets.where(F.col("size") <= PAIRED).select("v"), "v"), "few")
    many = scratch.save(members.join(buckets.where(F.col("size") > PAIRED), "v"), "many")
    scratch.drop("members", "buckets")
    scratch.free_shuffles()
    pairs = _side(few, "a").join(_side(few, "b"), "v").where((F.col("a") < F.col("b")) & _possible(threshold)).select("a", "b")
    pairs = pairs.unionByName(hinted).unionByName(many.select(F.col("sk").alias("a"), F.explode("centres").alias("b")).distinct())
    edges = _verified(pairs, marks, texts, nodes, width, threshold, scratch, "first")
    # What is left in large buckets are pairs that centres haven't linked yet; one of the two lies outside of
    # the largest group of its bucket.
    roots = components(edges, Scratch(spark)).select(F.col("node").alias("sk"), "root")
    grouped = scratch.save(many.select("v", "sk", "n", "i").join(roots, "sk", "left").withColumn("root", F.coalesce("root", "sk")), "grouped")
    largest = grouped.groupBy("v", "root").agg(F.count("*").alias("k")).groupBy("v").agg(F.count("*").alias("groups"), F.max(F.struct("k", "root"))["root"].alias("most")).where("groups > 1")
    mixed = scratch.save(grouped.join(largest, "v"), "mixed")
    mixed = scratch.save(mixed.join(marks.select("sk", "bits"), "sk"), "compared")
    members = ["v", "sk", "n", "i", "root", "bits"]
    met = _side(mixed.where("root <> most").select(*members), "a").join(_side(mixed.select(*members), "b"), "v")
    left = met.where((F.col("a_root") != F.col("b_root")) & _possible(threshold) & _close(threshold)).select("a", "b")
    edges = edges.unionByName(_verified(left, marks, texts, nodes, width, threshold, scratch, "second"))
    scratch.drop("few", "many", "grouped", "mixed", "marks", "compared", "hinted", "pairs-first", "sets-first", "pairs-second", "sets-second")
    scratch.free_shuffles()
    found = components(edges, scratch)
    kept = nodes.join(found.withColumnRenamed("node", "sk"), "sk", "left").groupBy(F.coalesce("root", "sk").alias("root")).agg(F.min("best").alias("best"))
    out = scratch.save(kept.select("best.rk"), "kept")
    scratch.drop("nodes", "edges-of-first", "edges-of-second")
    return out
