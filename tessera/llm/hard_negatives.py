"""Hard negatives by threshold joins with an inverted index, in the manner of L2AP.

Rows are packed into chunks, anchors into blocks; each block meets each chunk once a round, where the chunk lies, as a
block of bounded size goes to all of them. Where they meet, a chunk's inverted index has, for each dimension, the rows that still matter there:
a row's last dimensions are left out as soon as their norm says that they alone can't reach the threshold. Partial
scores are accumulated along the lists; a pair goes when what is left of both norms can't lift it to the threshold, and
what remains is finished on the dimensions that were left out. Thresholds are high in the first round and lowered, round
by round, for the anchors whose windows aren't full; the last one leaves nothing out, so results are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions
from .vectors import matrix, usable, whole

#: Rows of a chunk, anchors of a block and anchors that are looked up at a time.
CHUNK, BLOCK, TOGETHER = 4096, 16_384, 512
#: Dimensions that are accumulated between two looks at the bounds, and the share of pairs from which they go on one by one.
STEP, FEW = 8, 0.1
#: Thresholds of the first rounds, as shares of the largest score that norms allow, or of a window; a last round leaves nothing out.
SHARES, WINDOW_SHARES = (0.7, 0.45, 0.2), (0.75, 0.4)
#: Entries are held within this bound, so that scores of up to 512 dimensions are 64-bit integers.
MOST = 1 << 27
#: Pairs that wait in a task before they are reduced to the best of each list.
WAITING = 1 << 20
#: Pairs whose numbers are looked up and multiplied at a time, and blocks that go to all tasks in one job.
LOOKED_UP, AT_ONCE = 1 << 16, 8
#: What tasks tell of their lists.
FOUND = "block int, pos int, rank int, score long, id long"


class Chunk:
    """Rows by dimensions of falling energy, with the norms of what follows each step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, order: np.ndarray):
        self.ids, self.labels, self.order, self.whole = ids, labels, order, values
        self.values = values.astype(np.float64)
        self.rest = _rest(self.values)

    def of(self, rows: np.ndarray) -> Chunk:
        part = object.__new__(Chunk)
        part.ids, part.labels, part.order, part.whole, part.values, part.rest = self.ids[rows], self.labels[rows], self.order, self.whole[rows], self.values[rows], self.rest[rows]
        return part


def _rest(values: np.ndarray) -> np.ndarray:
    """Norms of the dimensions from each step on: a column a step, and one of zeros."""
    n, width = values.shape
    steps = -(-width // STEP)
    squares = np.zeros((n, steps * STEP))
    squares[:, :width] = values * values
    sums = squares.reshape(n, steps, STEP).sum(2)
    return np.sqrt(np.concatenate([np.cumsum(sums[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1))], axis=1))


def above(chunk: Chunk, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of anchors and rows, and scores, of all pairs whose score is ``least[anchor]`` or more.

    ``anchors``: whole numbers in the chunk's order of dimensions.
    """
    queries = anchors.astype(np.float64)
    tails = _rest(queries)
    steps = chunk.rest.shape[1] - 1
    norms = np.maximum(tails[:, 0], 1e-9)
    slack = 0.5 + 1e-12 * norms * (chunk.rest[:, 0].max(initial=0.0) + 1)
    bound = least - slack
    # Steps of a row that are indexed: what follows them can't reach the lowest threshold of these anchors.
    share = (bound / norms).min(initial=np.inf)
    listed = (chunk.rest[:, :steps] >= share).sum(1) if share > 0 else np.full(len(chunk.ids), steps)
    rank = np.argsort(-listed, kind="stable")
    values, rest, listed = chunk.values[rank], chunk.rest[rank], listed[rank]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sums = np.zeros((len(queries), int((listed > 0).sum())))

    def finish(a: np.ndarray, r: np.ndarray, partial: np.ndarray, step: int) -> None:
        for k in range(step, steps + 1):
            keep = partial + tails[a, k] * rest[r, k] >= bound[a]
            a, r, partial = a[keep], r[keep], partial[keep]
            if k == steps or not len(a):
                break
            at = slice(k * STEP, (k + 1) * STEP)
            partial = partial + np.einsum("ij,ij->i", queries[a, at], values[r, at])
        if len(a):
            found.append((a, r))

    for k in range(steps):
        alive = sums.shape[1]
        if not alive:
            break
        at = slice(k * STEP, (k + 1) * STEP)
        sums += queries[:, at] @ values[:alive, at].T
        on = int((listed > k + 1).sum())
        may = sums + tails[:, k + 1, None] * rest[:alive, k + 1] >= bound[:, None]
        if k + 1 == steps or may.mean() <= FEW:
            on = 0
        a, r = np.nonzero(may[:, on:])
        finish(a, r + on, sums[a, r + on], k + 1)
        sums = sums[:, :on]
    if not steps:
        found = [np.nonzero(np.zeros((len(queries), len(values))) >= bound[:, None])]
    a, r = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    r = rank[r]
    scores = np.concatenate([np.einsum("ij,ij->i", anchors[a[i : i + LOOKED_UP]], chunk.whole[r[i : i + LOOKED_UP]]) for i in range(0, len(a), LOOKED_UP)] or [np.zeros(0, np.int64)])
    keep = scores >= least[a]
    return a[keep], r[keep], scores[keep]


class Best:
    """The first ``most`` of each list, by falling score and then by id; what comes later is held back in between."""

    def __init__(self, most: int):
        self.most, self.waiting, self.size = most, [], 0
        #: The last score of lists that are full.
        self.full: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if len(key):
            self.waiting.append((key, score, ident))
            self.size += len(key)
            if self.size > WAITING:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, score, ident = (np.concatenate(x) for x in zip(*self.waiting)) if self.waiting else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        first = np.flatnonzero(np.diff(key, prepend=np.iinfo(np.int64).min) != 0)
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = place < self.most
        self.waiting = [(key[keep], score[keep], ident[keep])]
        self.size = int(keep.sum()) // 2  # so that what stays doesn't ask for another reduction at once
        last = place == self.most - 1
        self.full = (key[last], score[last])
        return self.waiting[0]


LONGEST, SHORTEST = (1 << 63) - 1, -(1 << 63)


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """Chunks of rows: most (the largest norm) and, as bytes, ids, labels, dimensions by falling energy and numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                values = whole(matrix(part.column(2), pc.max(pc.list_value_length(part.column(2))).as_py() or 0), scale, MOST)
                squares = values.astype(np.float64) ** 2
                order = np.argsort(-squares.sum(0), kind="stable").astype(np.int32)
                packed = (part.column(0).to_numpy(), part.column(1).to_numpy(), order, np.ascontiguousarray(values[:, order], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([np.sqrt(squares.sum(1)).max(initial=0.0)]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["most", "ids", "labels", "dims", "numbers"])

    return rows.mapInArrow(pack, "most double, ids binary, labels binary, dims binary, numbers binary")


def _blocked(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks of anchors in order of their ids: block, anchors (ids), norms and, as bytes, labels and numbers."""

    def pack(found: pa.Table) -> pa.Table:
        found = found.combine_chunks().sort_by([("vec_id", "ascending"), ("label", "ascending")])
        lists = found.column("vector").combine_chunks()
        values = whole(matrix(lists, pc.max(pc.list_value_length(lists)).as_py() or 0), scale, MOST)
        norms = np.sqrt((values.astype(np.float64) ** 2).sum(1))
        return pa.table({
            "block": pa.array([found.column("block")[0].as_py()], pa.int32()), "anchors": pa.array([found.column("vec_id").to_numpy()], pa.list_(pa.int64())), "norms": pa.array([norms], pa.list_(pa.float64())),
            "own_labels": pa.array([found.column("label").to_numpy().tobytes()], pa.binary()), "own_numbers": pa.array([values.astype(np.int32).tobytes()], pa.binary()),
        })

    return rows.groupBy("block").applyInArrow(pack, "block int, anchors array<long>, norms array<double>, own_labels binary, own_numbers binary")


class Lists:
    """The lists that a block's anchors ask for in a round, and what a task has found for them so far."""

    def __init__(self, block: dict, same: bool, most: int):
        asked = np.array([(x["pos"], x["rank"]) for x in block["lists"]], np.int64)
        order = np.lexsort((asked[:, 1], asked[:, 0]))
        self.pos, self.rank = asked[order].T
        self.lo, self.hi = (np.array([block["lists"][k][n] for k in order], np.int64) for n in ("lo", "hi"))
        self.least = np.array([block["lists"][k]["least"] for k in order])
        self.active, self.first, self.count = np.unique(self.pos, return_index=True, return_counts=True)
        labels = np.frombuffer(block["own_labels"], np.int64)
        self.labels, self.ids = labels[self.active], np.array(block["anchors"], np.int64)[self.active]
        self.numbers = np.frombuffer(block["own_numbers"], np.int32).reshape(len(labels), -1)[self.active].astype(np.int64)
        self.same, self.best = same, Best(most)

    def meet(self, chunk: Chunk) -> None:
        width = max(self.numbers.shape[1], len(chunk.order))
        numbers = np.zeros((len(self.numbers), width), np.int64)
        numbers[:, : self.numbers.shape[1]] = self.numbers
        numbers = numbers[:, chunk.order]
        least = np.minimum.reduceat(self._now(), self.first)
        for label in np.unique(self.labels) if self.same else (None,):
            anchors = np.arange(len(self.active)) if label is None else np.flatnonzero(self.labels == label)
            part = chunk if label is None else chunk.of(np.flatnonzero(chunk.labels == label))
            for start in range(0, len(anchors), TOGETHER) if len(part.ids) else ():
                own = anchors[start : start + TOGETHER]
                a, r, score = above(part, numbers[own], least[own])
                a = own[a]
                keep = self.ids[a] != part.ids[r] if self.same else self.labels[a] != part.labels[r]
                a, r, score = a[keep], r[keep], score[keep]
                for k in range(int(self.count[own].max())):
                    fits = self.count[a] > k
                    at = self.first[a[fits]] + k
                    s, ident = score[fits], part.ids[r[fits]]
                    fits = (self.lo[at] <= s) & (s <= self.hi[at])
                    self.best.add(at[fits], s[fits], ident[fits])

    def _now(self) -> np.ndarray:
        """What a list still asks for: once it is full here, at least its last score."""
        now = np.maximum(self.least, self.lo.astype(float))
        at, score = self.best.full
        now[at] = np.maximum(now[at], score)
        return now

    def told(self, block: int) -> pa.RecordBatch:
        at, score, ident = self.best.reduce()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), pa.array(self.pos[at].astype(np.int32)), pa.array(self.rank[at].astype(np.int32)), pa.array(score), pa.array(ident)], ["block", "pos", "rank", "score", "id"])


def _round(chunks: DataFrame, asked: DataFrame, number: int, same: bool, most: int) -> DataFrame:
    """block, pos, rank, score, id: what tasks find for the lists of block ``number`` of ``asked``, the first ``most`` of each in a task.

    Chunks stay where they lie, and the block, whose size is bounded, goes to all of them.
    """
    own, other = ["block", "anchors", "own_labels", "own_numbers", "lists"], ["ids", "labels", "dims", "numbers"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                if held is None:
                    held = Lists({n: batch.column(i)[k].as_py() for i, n in enumerate(own)}, same, most)
                ids, labels, dims, values = (np.frombuffer(batch.column(len(own) + i)[k].as_py(), kind) for i, kind in enumerate((np.int64, np.int64, np.int32, np.int32)))
                held.meet(Chunk(ids, labels, values.reshape(len(ids), len(dims)).astype(np.int64), dims))
        if held:
            yield held.told(number)

    met = chunks.crossJoin(F.broadcast(asked.where(F.col("block") == number).select(*own)))
    return met.select(*own, *other).mapInArrow(meet, FOUND)


def _rounds(chunks: DataFrame, blocks: DataFrame, lists: DataFrame, same: bool, most: int, scratch: Scratch, name: str) -> DataFrame:
    """block, pos, rank, score, id, place: the first ``most`` rows of each list (block, pos, rank, lo, hi, least), written.

    Blocks go ``AT_ONCE`` by job, so what is sent to all tasks doesn't grow with anchors.
    """
    asked = lists.groupBy("block").agg(F.collect_list(F.struct("pos", "rank", "lo", "hi", "least")).alias("lists"))
    asked = scratch.save(blocks.join(asked, "block"), f"{name}-asked", ["block"])
    numbers = sorted(r["block"] for r in asked.select("block").collect())  # one number for each 16,384 anchors
    place = F.row_number().over(Window.partitionBy("block", "pos", "rank").orderBy(F.desc("score"), "id"))
    none = chunks.sparkSession.createDataFrame([], FOUND)
    found = []
    for start in range(0, max(1, len(numbers)), AT_ONCE):
        told = _all([_round(chunks, asked, n, same, most) for n in numbers[start : start + AT_ONCE]] or [none])
        found.append(scratch.save(told.withColumn("place", place).where(F.col("place") <= most), f"{name}-{start}"))
    scratch.drop(f"{name}-asked")
    return _all(found)


def _filled(chunks: DataFrame, blocks: DataFrame, lists: DataFrame, steps: int, same: bool, most: int, scratch: Scratch, name: str) -> DataFrame:
    """Rounds of falling thresholds. ``lists``: block, pos, rank, lo, hi and, for each round but the last, a number in ``steps``.
    A list that is full at a threshold is done, as nothing below it comes first; the others go on."""
    key, found = ["block", "pos", "rank"], []
    for step in range(steps + 1):
        least = F.col("lo").cast("double") if step == steps else F.greatest(F.col("lo").cast("double"), F.col("steps")[step])
        got = _rounds(chunks, blocks, lists.withColumn("least", least), same, most, scratch, f"{name}-{step}")
        if step == steps:
            return _all([*found, got])
        full = got.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= most).select(*key)
        found.append(got.join(full, key, "left_semi"))
        lists = scratch.save(lists.join(full, key, "left_anti"), f"{name}-left-{step}")
        if lists.isEmpty():
            return _all(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives within a window of scores.

    Entries become floor(scale * entry), held within +-2^27; a score is the inner product, shorter vectors filled up with
    zeros. Higher scores come first, ties by smaller id. An anchor's positives are its first ``positives`` rows of its label
    and another id, its negatives the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or null or non-finite entries, take no part; ids and labels are whole numbers.
    Rows that repeat an id are rows of their own among positives and negatives; anchors that repeat id, label and vector
    are one. Anchors without positives, and positives without negatives, have no row; an empty table gives none. Other
    columns are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    known = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector))
    shape = [F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")]
    chunks = scratch.save(_packed(rows.where(known).select(*shape), scale).repartition(partitions(spark)), "chunks")
    anchors = scratch.save(rows.where(known & is_anchor).select(*shape).distinct(), "anchors")
    n_blocks = -(-max(1, anchors.count()) // BLOCK)
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(n_blocks)).cast("int"))
    blocks = scratch.save(_blocked(anchors, scale), "blocks")
    most = chunks.agg(F.max("most")).first()[0] or 0.0
    own = blocks.select("block", F.posexplode(F.arrays_zip("anchors", "norms"))).select("block", "pos", F.col("col.anchors").alias("anchor_id"), F.col("col.norms").alias("norm"))
    lists = own.select("block", "pos", F.lit(0).alias("rank"), F.lit(SHORTEST).alias("lo"), F.lit(LONGEST).alias("hi"), F.array(*[F.col("norm") * most * s for s in SHARES]).alias("steps"))
    found = _filled(chunks, blocks, lists, len(SHARES), True, positives, scratch, "positives")
    found = scratch.save(found.select("block", "pos", F.col("place").alias("rank"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    least, greatest = F.col("positive_score") * low, F.col("positive_score") * high
    windows = found.select("block", "pos", "rank", (least + F.pmod(-least, F.lit(100))).alias("lo"), (greatest - F.pmod(greatest, F.lit(100))).alias("hi"))
    windows = windows.selectExpr("block", "pos", "rank", "lo div 100 as lo", "hi div 100 as hi").where("lo <= hi").withColumn("steps", F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * s for s in WINDOW_SHARES]))
    scratch.drop("anchors")
    hard = _filled(chunks, blocks, windows, len(WINDOW_SHARES), False, negatives, scratch, "negatives").select("block", "pos", "rank", F.col("place").alias("at"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    hard = hard.join(found, ["block", "pos", "rank"]).join(own.select("block", "pos", "anchor_id"), ["block", "pos"])
    return hard.select("anchor_id", "positive_id", F.col("at").alias("rank"), "negative_id", "positive_score", "negative_score")
