"""Removal of every byte that lies in a string of 400 bytes which occurs more than once.

A repeated string is settled by comparing suffixes, and only suffixes that can repeat are exchanged:

1. Each 400-byte window has an anchor, the 256-byte gram in it with the least hash (leftmost of equal
   ones). It depends on the window's bytes alone, so equal windows have equal anchors at equal places.
   Neighbouring windows with one anchor are a run. Runs whose anchor gram occurs nowhere else are done.
2. Runs whose bytes (from the first window's start to the last one's end) occur again as a whole, by two
   64-bit hashes, repeat entirely.
3. What is undecided - runs that share an anchor gram with runs that differ elsewhere - goes through a
   common-prefix-aware merge sort: each task sorts its suffixes from the anchor on and writes them
   front-coded (length shared with the one before, then the rest), the runs are exchanged by anchor, and a
   loser tree merges them, comparing only bytes beyond the prefix that two suffixes are known to share.
   Suffixes with a common anchor come out together and their windows are compared byte by byte.
   An anchor with over ``CROWDED`` different runs is split by window instead: windows meet by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_name, partitions, small_batches

LENGTH, GRAM = 400, 256
#: Words of an anchor where strings are measured in words.
WORD_GRAM = 16
#: Windows looked at together, which bounds memory on very long texts.
SEGMENT = 1 << 20
#: Different runs of one anchor up to which one task compares them.
CROWDED = 20_000
#: Bytes of suffixes that a task sorts into one front-coded run, and that one merge takes.
RUN_BYTES, MERGE_BYTES = 16 << 20, 16 << 20

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    h = a * np.uint64(factor)
    h ^= h >> np.uint64(29)
    h += b
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space."""
    import xxhash

    words = data.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _hashes(data: bytes | np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of ``gram`` and of ``length`` bytes, or word hashes.

    Doubling: a hash of 2s bytes mixes the hashes of its halves; a length is a sum of powers of two.
    """
    if isinstance(data, np.ndarray):
        at, known = 1, {1: data}
    else:
        raw = np.frombuffer(data, np.uint8)
        at, known = 8, {8: np.ndarray((len(data) - 7,), np.uint64, raw, strides=(1,)).copy()}
    while at * 2 <= length:
        half = known[at]
        known[at * 2] = _mix(half[: len(half) - at], half[at:], 0x9E3779B97F4A7C15)
        at *= 2
    n, done, whole = len(data) - length + 1, 0, None
    for size in sorted(known, reverse=True):
        if length - done >= size:
            part = known[size][done : done + n]
            whole = part if whole is None else _mix(whole, part, 0xC2B2AE3D27D4EB4F)
            done += size
    return known[gram], whole


def window_runs(data: bytes | np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (anchor gram's hash, hash of the run's bytes, first window, anchor, last window) by segment.

    ``gram`` is a power of two from 8, ``length`` a larger multiple of 8; of word hashes any power of two and
    any larger length, and all places count words.
    """
    width = length - gram + 1
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        grams, windows = _hashes(part, gram, length)
        # Low bits hold the place, so a minimum tells where it was and takes the leftmost of equal hashes.
        packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        blocks = -(-len(packed) // width)
        table = np.full(blocks * width, np.uint64(2**64 - 1))
        table[: len(packed)] = packed
        table = table.reshape(blocks, width)
        ahead = np.minimum.accumulate(table, 1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        n = len(windows)
        anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        body = _mix(_mix(windows[first], windows[last], 0x165667B19E3779F9), (last - first).astype(np.uint64), 0xD6E8FEB86659FD93)
        a = anchor[first]
        yield grams[a].view(np.int64), body.view(np.int64), base + first, base + a, base + last


# ------------------------------------------------------------------ front coding and the loser tree


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are not looked at."""
    end = min(len(a), len(b))
    while known < end:
        step = min(64, end - known)
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            return known + step - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)
        known += step
    return known


Suffix = tuple[bytes, bytes]  # the suffix and what belongs to it


def front_code(suffixes: Iterable[Suffix]) -> bytes:
    """Sorted suffixes as (shared with the one before, rest, payload)."""
    out, before = [], b""
    for suffix, payload in suffixes:
        shared = common_prefix(before, suffix, 0)
        out += (struct.pack("<III", shared, len(suffix) - shared, len(payload)), suffix[shared:], payload)
        before = suffix
    return b"".join(out)


def front_decode(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(shared with the one before, suffix, payload) in order."""
    at, before = 0, b""
    while at < len(blob):
        shared, rest, more = struct.unpack_from("<III", blob, at)
        at += 12
        before = before[:shared] + blob[at : at + rest]
        at += rest
        yield shared, before, blob[at : at + more]
        at += more


class LoserTree:
    """Merges sorted front-coded runs; yields (shared with the one before, suffix, payload).

    Each run's head knows how much it shares with the last suffix that left. Of two heads the one that
    shares more is smaller; only heads that share equally much are compared, from that length on, and the
    loser then knows how much it shares with the winner.
    """

    def __init__(self, runs: list[bytes]):
        self.sources = [front_decode(r) for r in runs]
        self.heads: list[tuple[bytes, bytes] | None] = []
        self.shared = [0] * len(runs)
        for source in self.sources:
            head = next(source, None)
            self.heads.append(head and head[1:])
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            leaf = node - self.size
            return leaf if leaf < len(self.sources) else -1
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The smaller of two runs' heads goes on, the other stays in the node; equal ones go by run."""
        if a < 0 or self.heads[a] is None or (b >= 0 and self.heads[b] is not None and self._after(a, b)):
            a, b = b, a
        self.losers[node] = b
        return a

    def _after(self, a: int, b: int) -> bool:
        if self.shared[a] != self.shared[b]:
            return self.shared[a] < self.shared[b]
        x, y = self.heads[a][0], self.heads[b][0]
        shared = common_prefix(x, y, self.shared[a])
        later = (x[shared : shared + 1], a) > (y[shared : shared + 1], b)
        self.shared[a if later else b] = shared
        return later

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.shared[run], *self.heads[run]
            following = next(self.sources[run], None)
            if following is None:
                self.heads[run] = None
            else:
                self.shared[run], self.heads[run] = following[0], following[1:]
            node, winner = (run + self.size) // 2, run
            while node:
                winner = self._play(node, winner, self.losers[node])
                node //= 2
            self.winner = winner


# ------------------------------------------------------------------ undecided runs

#: What belongs to a suffix: document, first window, the anchor's distance from it, windows; then the bytes before the anchor.
_OWN, _OWN_BYTES = "<qqII", struct.calcsize("<qqII")


def _repeated_windows(group: list[tuple[bytes, bytes]], length: int, unit: int = 1) -> Iterator[tuple[int, int, int]]:
    """(document, first, end) of the bytes between the outermost repeated windows of each member.

    Members share an anchor; windows at one distance from it are compared whole. Windows of a run overlap,
    so the outermost repeated ones cover what lies between them.
    """
    members = []
    for suffix, payload in group:
        row, first, ahead, windows = struct.unpack_from(_OWN, payload)
        members.append((payload[_OWN_BYTES:] + suffix, row, first, ahead, windows))
    outer: dict[int, list[int]] = {}
    for distance in range(max(m[3] for m in members) + 1):
        seen: dict[bytes, int] = {}
        for i, (data, _, first, ahead, windows) in enumerate(members):
            at = ahead - distance
            if 0 <= at < windows:
                other = seen.setdefault(data[at * unit : (at + length) * unit], i)
                if other != i:
                    for k in (i, other):
                        start = members[k][2] + members[k][3] - distance
                        bounds = outer.setdefault(k, [start, start])
                        bounds[0], bounds[1] = min(bounds[0], start), max(bounds[1], start)
    for k, (lo, hi) in outer.items():
        yield members[k][1], lo, hi + length


def _compare_undecided(texts: DataFrame, undecided: DataFrame, length: int, gram: int, scratch: Scratch, words: bool = False) -> DataFrame:
    """Spans (rk, lo, hi) of repeated bytes, or words, in runs that share an anchor with different runs."""
    unit = 8 if words else 1
    by_row = undecided.groupBy("rk").agg(F.collect_set(F.struct("kh", "p1", "a", "p2", "crowded")).alias("runs"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            kh, rk, p1, a, p2, body, crowded = [], [], [], [], [], [], []
            for row, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "replace")
                data = _word_hashes(data).tobytes() if words else data
                for r in runs:
                    if r["crowded"]:
                        for p in range(r["p1"], r["p2"] + 1):
                            h = xxhash.xxh128_digest(data[p * unit : (p + length) * unit])
                            kh.append(int.from_bytes(h[:8], "big", signed=True)), rk.append(row), p1.append(p), a.append(0), p2.append(0), body.append(h[8:]), crowded.append(True)
                    else:
                        kh.append(r["kh"]), rk.append(row), p1.append(r["p1"]), a.append(r["a"]), p2.append(r["p2"]), body.append(data[r["p1"] * unit : (r["p2"] + length) * unit]), crowded.append(False)
            longs = [pa.array(x, pa.int64()) for x in (kh, rk, p1, a, p2)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(body, pa.binary()), pa.array(crowded, pa.bool_())], ["kh", "rk", "p1", "a", "p2", "body", "crowded"])

    picked = scratch.save(texts.join(by_row, "rk").select("rk", "text", "runs").mapInArrow(pick, "kh long, rk long, p1 long, a long, p2 long, body binary, crowded boolean"), "picked")
    scratch.free_shuffles()
    plain = picked.where("not crowded").drop("crowded")
    total = plain.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    merges = max(partitions(picked.sparkSession), -(-total // MERGE_BYTES))

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Suffix]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([front_code(sorted(held[k])) for k in keys], pa.binary())], ["merge", "run"])

        for batch in batches:
            for kh, rk, p1, a, p2, body in zip(*(batch.column(i).to_pylist() for i in range(6))):
                held.setdefault(kh % merges, []).append((body[(a - p1) * unit :], struct.pack(_OWN, rk, p1, a - p1, p2 - p1 + 1) + body[: (a - p1) * unit]))
                size += len(body)
                if size > RUN_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        spans: list[tuple[int, int, int]] = []
        group: list[tuple[bytes, bytes]] = []
        for shared, suffix, payload in LoserTree(list(frame["run"])):
            if shared < gram * unit:
                if len(group) > 1:
                    spans += _repeated_windows(group, length, unit)
                group = []
            group.append((suffix, payload))
        if len(group) > 1:
            spans += _repeated_windows(group, length, unit)
        return pd.DataFrame(spans, columns=["rk", "lo", "hi"], dtype="int64")

    merged = plain.mapInArrow(sort_runs, "merge long, run binary").groupBy("merge").applyInPandas(merge, "rk long, lo long, hi long")
    windows = picked.where("crowded").select("kh", "body", "rk", "p1")
    twice = windows.groupBy("kh", "body").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    split = windows.join(twice, ["kh", "body"]).groupBy("rk", "p1").agg(F.lit(1)).select("rk", F.col("p1").alias("lo"), (F.col("p1") + length).alias("hi"))
    return merged.unionByName(split)


# ------------------------------------------------------------------ the operator


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rk: a hash of id and text; rows with both equal share it, as they lose the same bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(doc_id), body).alias("rk"), F.col(doc_id).alias("doc_id"), body.alias("text"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowded: int | None = None, words: bool = False) -> DataFrame:
    """rk, spans: for each row that has any, sorted numbers (first << 32) + end of repeated bytes, or ``words``."""
    spark = docs.sparkSession
    crowded = CROWDED if crowded is None else crowded
    small_batches(spark)
    scratch = Scratch(spark)
    texts = _keyed(docs, doc_id, text).drop("doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                for found in window_runs(_word_hashes(data) if words else data, length, gram):
                    rows.append(np.full(len(found[0]), row, np.int64))
                    parts.append(found)
            if parts:
                kh, u, p1, a, p2 = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kh, u, np.concatenate(rows), p1, a, p2)], ["kh", "u", "rk", "p1", "a", "p2"])

    runs = scratch.save(texts.where(F.octet_length("text") >= length).mapInArrow(scan, "kh long, u long, rk long, p1 long, a long, p2 long").withColumns({c: F.col(c).cast("int") for c in ("p1", "a", "p2")}), "runs")
    # Written before it is joined, so that the join has plain exchanges on both sides and a hot gram can be split.
    again = scratch.save(runs.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select("kh"), "again")
    scratch.free_shuffles()
    shared = scratch.save(runs.join(again, "kh"), "shared")
    scratch.drop("runs", "again")
    scratch.free_shuffles()
    bodies = shared.groupBy("kh", "u").agg(F.count("*").alias("n"), F.min(F.struct("rk", "p1")).alias("one"))
    kinds = bodies.groupBy("kh").agg(F.count("*").alias("kinds"))
    verdicts = scratch.save(bodies.join(kinds, "kh"), "verdicts")
    judged = shared.join(verdicts, ["kh", "u"]).select("rk", "kh", "p1", "a", "p2", (F.col("n") > 1).alias("whole"), ((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("rk", "p1") == F.col("one")))).alias("open"), (F.col("kinds") > crowded).alias("crowded"))
    judged = scratch.save(judged.where("whole or open").distinct(), "judged")
    scratch.drop("shared", "verdicts")
    scratch.free_shuffles()
    spans = _compare_undecided(texts, judged.where("open").drop("whole", "open"), length, gram, scratch, words)
    spans = judged.where("whole").select("rk", F.col("p1").cast("long").alias("lo"), (F.col("p2") + length).cast("long").alias("hi")).unionByName(spans)
    packed = spans.groupBy("rk").agg(F.sort_array(F.collect_set(F.col("lo") * F.lit(1 << 32) + F.col("hi"))).alias("spans"))
    out = scratch.save(packed, "spans")
    scratch.drop("judged", "picked")
    scratch.free_shuffles()
    return out


def _kept(data: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside ``spans`` and the number of maximal removed runs."""
    if spans is None or not len(spans):
        return data, 0
    out, at, n, end = [], 0, 0, -1
    for span in spans:
        lo, hi = int(span) >> 32, int(span) & 0xFFFFFFFF
        if lo > end:
            out.append(data[at:lo])
            n += 1
        end = max(end, hi)
        at = end
    out.append(data[at:])
    return b"".join(out), n


def _with_spans(source: DataFrame, spans: DataFrame) -> DataFrame:
    """``source`` (doc_id, text) with the spans of each row."""
    return source.withColumn("rk", F.xxhash64("doc_id", "text")).join(spans.withColumnRenamed("spans", "_spans"), "rk", "left").drop("rk")


def _length(spans) -> int:
    """How much ``spans`` cover together."""
    total, end = 0, 0
    for span in [] if spans is None else spans:
        lo, hi = int(span) >> 32, int(span) & 0xFFFFFFFF
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def removed_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowded: int | None = None, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every whole text.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or in
    another row; strings are judged on the input. Null texts are empty. Texts shorter than ``length`` keep
    all. Repeated rows repeat each other. Null ids are kept; further columns are left out; an empty table
    gives an empty result. With ``words``, n_passage_words tells how many words lie in strings of so many words
    that also start anywhere else, however few bytes they have; they don't go.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_spans(source, length=length, gram=gram, crowded=crowded)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, spans):
            data = text.encode("utf-8", "replace")
            kept, n = _kept(data, own)
            rows.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    @F.pandas_udf("long")
    def covered(spans: pd.Series) -> pd.Series:
        return pd.Series([_length(own) for own in spans], dtype="int64")

    if not words:
        return _with_spans(source, spans).select("doc_id", cut("text", "_spans").alias("c")).select("doc_id", "c.*")
    passages = repeated_spans(source, length=words, gram=WORD_GRAM, crowded=crowded, words=True).select("rk", covered("spans").alias("n_passage_words"))
    spans = spans.join(passages, "rk", "full")
    return _with_spans(source, spans).select("doc_id", cut("text", "_spans").alias("c"), F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words")).select("doc_id", "c.*", "n_passage_words")


def _bytes_of_words(data: bytes, spans) -> list[int]:
    """Spans of words as spans of bytes, from a first word's start to a last word's end."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    return [(words[int(s) >> 32][0] << 32) + words[(int(s) & 0xFFFFFFFF) - 1][1] for s in spans]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, words: int | None = None, word_gram: int = WORD_GRAM) -> DataFrame:
    """``docs`` with repeated bytes cut from its texts; a character that a cut runs through goes whole.

    With ``words``, strings of so many words (between ASCII white space of any kind) that occur more than once
    go as well, however few bytes they have; both are judged on the input.
    """
    key, by_bytes, by_words = (free_name(docs, n) for n in ("_rk", "_spans", "_word_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series, word_spans: pd.Series) -> pd.Series:
        out = []
        for t, own, of_words in zip(texts, spans, word_spans):
            data, own = t.encode("utf-8", "replace"), [] if own is None else [int(s) for s in own]
            own = sorted(own + _bytes_of_words(data, of_words)) if of_words is not None and len(of_words) else own
            out.append(_kept(data, own)[0].decode("utf-8", "ignore") if own else t)
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(key, F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))))
    found = repeated_spans(docs, doc_id, text, length, gram).select("rk", "spans", F.lit(None).cast("array<bigint>").alias("word_spans"))
    if words:
        found = found.unionByName(repeated_spans(docs, doc_id, text, words, word_gram, words=True).select("rk", F.lit(None).cast("array<bigint>").alias("spans"), F.col("spans").alias("word_spans")))
        found = found.groupBy("rk").agg(F.max("spans").alias("spans"), F.max("word_spans").alias("word_spans"))
    joined = joined.join(found.select(F.col("rk").alias(key), F.col("spans").alias(by_bytes), F.col("word_spans").alias(by_words)), key, "left")
    none = F.col(by_bytes).isNull() & F.col(by_words).isNull()
    return joined.withColumn(text, F.when(none, F.col(text)).otherwise(cut(F.coalesce(F.col(text), F.lit("")), by_bytes, by_words))).select(*docs.columns)
