"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item of n distinct word shingles is contained in a document to the share t if at least ceil(t * n) of
them are there, so at most n - ceil(t * n) are missing: of the item's n - ceil(t * n) + 1 smallest hash
values (its bottom-k MinHash sketch) one at least must be a hash of the document. Items are partitioned by
size, as the length of the sketch follows from n, and a document is looked up only in partitions whose
items it is large enough to contain. So the search loses nothing, however long the document and however
short the item, and each hit is verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import small_batches

WIDTH, THRESHOLD = 5, 0.8
#: Most bytes of benchmark text that are indexed and broadcast at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 16 << 20

HITS = "doc_id {id}, item_id {item}, n_shingles long, n_shared long"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles_of(words: list[bytes], width: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


class Index:
    """Sketches of a block of items: for each shingle width, partitions of sizes [2^j, 2^(j+1))."""

    def __init__(self, items: list[tuple[object, str | None]], width: int, threshold: float):
        from xxhash import xxh64_intdigest

        self.items: list[tuple[object, frozenset[bytes], int]] = []
        #: width -> hash value -> size class -> items that have it in their sketch
        self.sketches: dict[int, dict[int, dict[int, list[int]]]] = defaultdict(dict)
        #: width -> size class -> least number of shingles that any of its items asks for
        self.least: dict[int, dict[int, int]] = defaultdict(dict)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            own = min(width, len(words))  # an item of fewer words is one shingle of its own width
            shingles = frozenset(shingles_of(words, own))
            need = math.ceil(threshold * len(shingles) - 1e-9)
            size, number = len(shingles).bit_length() - 1, len(self.items)
            self.items.append((item_id, shingles, need))
            for value in sorted(map(xxh64_intdigest, shingles))[: len(shingles) - need + 1]:
                self.sketches[own].setdefault(value, {}).setdefault(size, []).append(number)
            self.least[own][size] = min(need, self.least[own].get(size, need))

    def search(self, text: str | None) -> Iterator[tuple[object, int, int]]:
        """(item, its shingles, how many of them the text has) for all items contained in the text."""
        from xxhash import xxh64_intdigest

        words = words_of(text)
        for width, sketch in self.sketches.items():
            open_ = {size for size, least in self.least[width].items() if len(words) - width + 1 >= least}
            if not open_:
                continue
            hits = [v for v in map(xxh64_intdigest, shingles_of(words, width)) if v in sketch]
            numbers = {n for v in hits for size, own in sketch[v].items() if size in open_ for n in own}
            there = set(shingles_of(words, width)) if numbers else set()
            for number in sorted(numbers):
                item_id, shingles, need = self.items[number]
                shared = len(shingles & there)
                if shared >= need:
                    yield item_id, len(shingles), shared


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: each item in each document that holds it.

    An item is held if at least ``threshold`` of its distinct ``width``-word shingles (A-Z lower-cased words
    between ASCII white space) occur in the document. Items of fewer words are one shingle; items and texts
    without words, or null, match nothing. Repeated documents and repeated items each give their rows; null
    ids are kept; further columns are left out; empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    schema = HITS.format(id=source.schema["doc_id"].dataType.simpleString(), item=items.schema["item_id"].dataType.simpleString())
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], width, threshold))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(row, *hit) for row, text in enumerate(batch.column(1).to_pylist()) for hit in index.value.search(text)]
                row, item, n, shared = zip(*found) if found else ([],) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], ["doc_id", "item_id", "n_shingles", "n_shared"])

        hits = source.mapInArrow(search, schema)
        out = hits if out is None else out.unionByName(hits)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
