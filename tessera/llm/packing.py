"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

Documents longer than a sequence are cut into pieces; every other document is one piece. The pieces are
range-sorted by length, which ranks them in their length's class, and the open gaps are kept sorted by
size. Both sorted orders are held run-length encoded - (length, first rank, n) and (gap, first sequence, n) -
so a round costs as much as there are runs, a few for each of the 2048 lengths however many documents they
stand for, and the driver can hold them. In a round every piece looks for its successor, the smallest gap
that takes it; pieces that want the same gap are ranked, longest first, and as many as there are gaps win;
the gaps shrink; the rest tries again. The ranks are distributed sorts, and the runs are joined back to the
pieces by rank on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions, small_batches
from .tokens import encoding

CAPACITY, SEPARATOR = 2048, 0

#: Pieces of one length whose runs are looked up together, as a power of two.
BLOCK_BITS = 16
RUNS = "length long, lo long, n long, seq long, offset long"
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenizes whole texts, appends the separator and cuts what is over ``capacity``.

    The first piece of a cut document takes the remainder, so that all others are full.
    """
    small_batches(docs.sparkSession)
    mark = separator.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.of(text) + mark
                n = len(ids) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    end = start + (n % capacity or capacity if piece == 0 else capacity)
                    out.append((row, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start = end
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(cut, PIECES.format(id=source.schema["doc_id"].dataType.simpleString()))


def match_runs(classes: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places ``classes`` of (length, n) into sequences: runs of (length, lo, n, seq, offset).

    A run says: the n pieces of that length from rank lo on go to the n sequences from seq on, at offset.
    Lengths are taken in bands, longest first (capacity/2 to capacity, then half of that, and so on). In a
    band rounds go on until no gap takes any piece that is left; then as many sequences are opened as the
    rest fills at least - one for each piece in the first band, where no two share a sequence.
    """
    waiting = dict(sorted(classes))
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed, sequences, top = [], 0, capacity
    taken = dict.fromkeys(waiting, 0)
    while top:
        band = {length: n for length, n in waiting.items() if top // 2 < length <= top}
        while band:
            matched, gaps = _sweep(band, taken, gaps, capacity)
            placed += matched
            if not matched:
                need = sum(band.values()) if top == capacity else -(-sum(length * n for length, n in band.items()) // capacity)
                gaps.setdefault(capacity, []).append((sequences, need))
                sequences += need
        top //= 2
    return placed


def _sweep(band: dict[int, int], taken: dict[int, int], gaps: dict[int, list[tuple[int, int]]], capacity: int) -> tuple[list, dict]:
    """One round over both sorted orders, from the smallest size up.

    Every gap is offered to the longest piece below it that no smaller gap has won, so a piece that loses
    its successor to a longer one is already ranked for the next gap. Each gap takes one piece a round.
    """
    matched, after, ranked = [], {}, []
    for size in sorted(band.keys() | gaps.keys()):
        if size in band:
            ranked.append(size)
        for seq, room in gaps.get(size, ()):
            while room and ranked:
                length = ranked[-1]
                n = min(room, band[length])
                matched.append((length, taken[length], n, seq, capacity - size))
                taken[length] += n
                band[length] -= n
                if not band[length]:
                    del band[length]
                    ranked.pop()
                if size > length:
                    after.setdefault(size - length, []).append((seq, n))
                seq, room = seq + n, room - n
            if room:
                after.setdefault(size, []).append((seq, room))
    return matched, after


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    Null and empty texts are documents of the separator alone. Repeated rows and null ids are documents of
    their own. Further columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.save(cut_into_pieces(docs, tokenizer_path, capacity, separator, doc_id, text), "pieces")
    # Range-sorted, each piece's rank in its length's class is its place less the class's first place.
    key = ["length", F.xxhash64("doc_id", "piece", "ids_crc32")]
    place = F.monotonically_increasing_id()
    placed = scratch.save(pieces.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key).withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    counts = placed.groupBy("length").agg(F.count("*").alias("n"))
    first = counts.select("length", (F.sum("n").over(Window.orderBy("length")) - F.col("n")).alias("first"))
    runs = match_runs([tuple(r) for r in counts.collect()], capacity)  # at most `capacity` classes
    ranked = placed.join(F.broadcast(before), "part").join(F.broadcast(first), "length").withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "before", "first")
    # Runs meet pieces by length and block of ranks: a hot length is dealt over many keys, and whether the runs are
    # broadcast is left to Spark, which knows the size of the written table.
    block = lambda rank: F.shiftright(rank, BLOCK_BITS)
    runs = spark.createDataFrame(runs, RUNS).withColumn("hi", F.col("lo") + F.col("n"))
    runs = scratch.save(runs.select("length", "lo", "hi", "seq", "offset", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))).alias("block")), "runs")
    out = ranked.withColumn("block", block(F.col("rank"))).join(runs, ["length", "block"]).where("rank >= lo and rank < hi")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
