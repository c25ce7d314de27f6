"""Language-model scores of whole texts by a weighted backoff automaton.

Smoothed n-grams are states with failure arcs. The n-grams of the whole corpus are never in one place: texts lie in
groups of bounded size, and for each length n every group asks, in packed form, for the counts of its own distinct
n-grams. Questions are dealt out by a hash of the n-gram, so that a frequent word or context is spread over all its
n-grams, and each group asks once however often it has one. What comes back is the part of the automaton that the
group's texts can reach; it is walked once from left to right, carrying a state and adding up log-probabilities.

A word after context h has (c(hw) + k(h) p(w|h')) / (c(h) + k(h)): an arc with that probability if hw was seen, else a
failure arc of weight k(h) / (c(h) + k(h)) to the context h' without its first word. k(h) = a c(h)^0.8 are the
continuations that a context seen c(h) times is expected to have, with ``a`` such that all contexts together have as
many as were seen. At the bottom a word has (c + 1) / (N + V + 1), and so have all unknown words together.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

#: Bytes of text that end a group (a longer text is one of its own), and tokens of the corpus for each bucket of questions.
GROUP_BYTES, BUCKET_TOKENS = 4 << 20, 1 << 22
#: Growth of the number of a context's continuations with its count.
HEAPS = 0.8
#: The end of a text, counted as a token; no word is empty.
END = b""


def _packed(*arrays: np.ndarray) -> bytes:
    """Columns of whole numbers, each in the fewest bytes and compressed."""
    parts = []
    for a in arrays:
        top = int(a.max(initial=0))
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
        planes = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), -1).T)
        parts.append(bytes([planes.shape[0] if len(a) else 1]) + planes.tobytes())
    return len(arrays[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    n, body, out, at = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:]), [], 0
    while at < len(body):
        size = body[at]
        planes = np.frombuffer(body, np.uint8, n * size, at + 1).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n).astype(np.int64))
        at += 1 + n * size
    return out


def _mixed(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def grouped(docs: DataFrame, held_out: Column, doc_id: str, text: str) -> DataFrame:
    """Rows of groups of texts: group, doc_ids, held, sizes (tokens of each text) and, packed, tokens as numbers in
    ``words`` (by first use, each ended by a line feed), n_tokens and n_train."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType

    def numbering() -> dict[bytes, int]:
        """Numbers by first use; the end has 0."""
        names = defaultdict(count(1).__next__)
        names[END] = 0
        return names

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens, sizes, held, ids, size = numbering(), array("q"), [], [], [], 0

        def told() -> pa.RecordBatch:
            train = sum(n for n, h in zip(sizes, held) if not h)
            columns = [pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_packed(np.array(tokens))], pa.binary())]
            words = zstandard.ZstdCompressor(level=1).compress(b"".join(w + b"\n" for w in names))
            return pa.RecordBatch.from_arrays([*columns, pa.array([words], pa.binary()), pa.array([len(tokens)]), pa.array([train])], ["doc_ids", "held", "sizes", "tokens", "words", "n_tokens", "n_train"])

        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for k in range(batch.num_rows):
                words = (body := batch.column(2)[k].as_py().encode("utf-8", "replace")).lower().split()
                ids.append(batch.column(0)[k].as_py()), held.append(batch.column(1)[k].as_py()), sizes.append(len(words) + 1)
                words.append(END)
                tokens.extend(map(names.__getitem__, words))
                size += len(body)
                if size >= GROUP_BYTES:
                    yield told()
                    names, tokens, sizes, held, ids, size = numbering(), array("q"), [], [], [], 0
        if ids:
            yield told()

    shape = f"doc_ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, tokens binary, words binary, n_tokens long, n_train long"
    return source.mapInArrow(group, shape).withColumn("group", F.monotonically_increasing_id())


def _words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")[:-1]


def _training(held: list[bool], sizes: list[int]) -> np.ndarray:
    """Whether each token is learned from."""
    return np.repeat(~np.array(held, bool), sizes)


class Grams:
    """The n-grams of a group's texts: ``of[n]`` the number of the n-gram that ends at each token (-1 before there are n
    tokens of the text), ``context[n]`` and ``last[n]`` the numbers of its first n - 1 tokens and of its last one."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, order: int):
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(tokens)) - starts
        n_words = int(tokens.max(initial=0)) + 1
        self.of, self.context, self.last = {1: tokens}, {}, {}
        for n in range(2, order + 1):
            there = place >= n - 1
            before = np.concatenate([[-1], self.of[n - 1][:-1]])
            keys, number = np.unique(before[there] * n_words + tokens[there], return_inverse=True)
            self.of[n] = np.full(len(tokens), -1)
            self.of[n][there] = number
            self.context[n], self.last[n] = keys // n_words, keys % n_words

    def counts(self, n: int, training: np.ndarray, size: int) -> np.ndarray:
        own = self.of[n][training]
        return np.bincount(own[own >= 0], minlength=size)


def _asked_words(buckets: int):
    """Questions of a group: its words in each bucket, and how often training texts of the group have them."""
    from zlib import crc32

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, held, sizes, tokens, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words, training = _words(words), _training(held, sizes)
                counts = np.bincount(_unpacked(tokens)[0][training], minlength=len(words))
                bucket = np.array([crc32(w) % buckets for w in words])
                for b, own in _by_bucket(bucket):
                    yield _piece(b, group, zstandard.ZstdCompressor(level=1).compress(b"".join(words[k] + b"\n" for k in own)), _packed(counts[own]))

    return ask


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that are in it, by place."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


PIECE = "bucket int, group long, keys binary, counts binary"


def _piece(bucket: int, group: int, keys: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([group], pa.int64()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], ["bucket", "group", "keys", "counts"])


ANSWER = "group long, bucket int, numbers binary, counts binary, seen long, total long, spread double"


def _answers(groups: list[int], bucket: int, numbers: list[bytes], counts: list[bytes], totals: np.ndarray) -> pa.Table:
    """One row a question; the first one bears the bucket's figures: n-grams and tokens seen, and the sum of c^HEAPS."""
    first = lambda value: [value] + [type(value)(0)] * (len(groups) - 1)
    seen = totals[totals > 0]
    return pa.table({
        "group": pa.array(groups, pa.int64()), "bucket": pa.array([bucket] * len(groups), pa.int32()), "numbers": pa.array(numbers, pa.binary()), "counts": pa.array(counts, pa.binary()),
        "seen": pa.array(first(len(seen)), pa.int64()), "total": pa.array(first(int(seen.sum())), pa.int64()), "spread": pa.array(first(float((seen.astype(float) ** HEAPS).sum())), pa.float64()),
    })


def _answered_words(buckets: int):
    """Counts of a bucket's words over all groups, and a number for each that no other word has."""

    def answer(found: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        asked, totals = [], []
        for keys, counts in zip(found.column("keys").to_pylist(), found.column("counts").to_pylist()):
            own = [numbers.setdefault(w, len(numbers)) for w in _words(keys)]
            asked.append((np.array(own), _unpacked(counts)[0]))
        totals = np.zeros(len(numbers), np.int64)
        for own, counts in asked:
            totals[own] += counts  # a group's words differ
        bucket, ended = found.column("bucket")[0].as_py(), totals.copy()
        if END in numbers:
            ended[numbers[END]] = 0  # nothing follows the end
        out = _answers(found.column("group").to_pylist(), bucket, [_packed(own * buckets + bucket) for own, _ in asked], [_packed(totals[own]) for own, _ in asked], totals)
        spread = float((ended[ended > 0].astype(float) ** HEAPS).sum())
        return out.set_column(out.schema.get_field_index("spread"), "spread", pa.array([spread] + [0.0] * (len(asked) - 1)))

    return answer


def _answered_grams(buckets: int):
    """The same for n-grams: pairs of the numbers of a context and of a word."""

    def answer(found: pa.Table) -> pa.Table:
        asked = [(*_unpacked(k), *_unpacked(c)) for k, c in zip(found.column("keys").to_pylist(), found.column("counts").to_pylist())]
        context, last = (np.concatenate([a[k] for a in asked]) for k in range(2))
        words = int(last.max()) + 1
        if (int(context.max()) + 1) * words < 1 << 63:
            pair = context * words + last
            order = np.argsort(pair)
            differs = np.diff(pair[order]) != 0
        else:
            order = np.lexsort((last, context))
            differs = (np.diff(context[order]) != 0) | (np.diff(last[order]) != 0)
        new = np.concatenate([[True], differs])
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        totals = np.bincount(own, weights=np.concatenate([c for _, _, c, _ in asked]), minlength=int(new.sum())).astype(np.int64)
        ended = np.zeros(len(totals), bool)
        ended[own] = np.concatenate([e for _, _, _, e in asked]) > 0
        parts, bucket = np.split(own, np.cumsum([len(a[0]) for a in asked])[:-1]), found.column("bucket")[0].as_py()
        out = _answers(found.column("group").to_pylist(), bucket, [_packed(p * buckets + bucket) for p in parts], [_packed(totals[p]) for p in parts], totals)
        spread = float((totals[(totals > 0) & ~ended].astype(float) ** HEAPS).sum())
        return out.set_column(out.schema.get_field_index("spread"), "spread", pa.array([spread] + [0.0] * (len(asked) - 1)))

    return answer


class Known:
    """What a group has been told of its n-grams so far: ``number[n]`` and ``count[n]`` of each."""

    def __init__(self, words: list[bytes], grams: Grams, answers: list[list[dict]], buckets: int):
        from zlib import crc32

        self.number, self.count = {}, {}
        for n, told in enumerate(answers, 1):
            bucket = np.array([crc32(w) % buckets for w in words]) if n == 1 else _mixed(self.number[n - 1][grams.context[n]], self.number[1][grams.last[n]], buckets)
            self.number[n], self.count[n] = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
            by = {x["bucket"]: x for x in told or ()}
            for b, own in _by_bucket(bucket):
                self.count[n][own] = _unpacked(by[b]["counts"])[0]
                if "numbers" in by[b]:  # the longest n-grams need none
                    self.number[n][own] = _unpacked(by[b]["numbers"])[0]


def _asked_grams(n: int, buckets: int):
    """Questions of a group about its n-grams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, held, sizes, tokens, words, *answers in zip(*(batch.column(i).to_pylist() for i in range(4 + n))):
                grams = Grams(_unpacked(tokens)[0], np.array(sizes), n)
                known = Known(_words(words), grams, answers, buckets)
                context, last = known.number[n - 1][grams.context[n]], known.number[1][grams.last[n]]
                counts = grams.counts(n, _training(held, sizes), len(context))
                for b, own in _by_bucket(_mixed(context, last, buckets)):
                    yield _piece(b, group, _packed(context[own], last[own]), _packed(counts[own], (grams.last[n][own] == 0).astype(np.int64)))

    return ask


class Automaton:
    """States are the root, 0, and the n-grams that have been seen and can be followed; ``arcs`` leads from a state and a
    word to the number of an arc, ``weight`` and ``to`` are its log-probability and the state behind it, ``fail`` and
    ``back`` a state's failure arc. The root has an arc for every word of the group."""

    def __init__(self, grams: Grams, known: Known, order: int, train_tokens: int, vocabulary: int, scales: dict[int, float]):
        self.n_words = len(known.count[1])
        base = (known.count[1] + 1) / (train_tokens + vocabulary + 1)
        follows = lambda n: (known.count[n] > 0) & ((grams.last[n] if n > 1 else np.arange(self.n_words)) > 0)
        state, n_states, fail, back = {}, 1, [np.zeros(1)], [np.zeros(1, np.int64)]
        share = {}
        for n in range(1, order):  # the longest n-grams end in states of one word less
            own = follows(n)
            state[n] = np.where(own, n_states + np.cumsum(own) - 1, -1)
            n_states += int(own.sum())
            prior = scales[n] * known.count[n][own].astype(float) ** HEAPS
            share[n] = prior / (known.count[n][own] + prior)
            fail.append(np.log10(share[n]))
        probability, reached, self.arcs, weight, to = {1: base}, {}, {}, [], []
        suffix = {n: self._suffixes(grams, n) for n in range(2, order + 1)}
        for n in range(1, order + 1):
            lower = np.zeros(len(known.count[n]), np.int64) if n == 1 else reached[n - 1][suffix[n]]
            reached[n] = np.where(state[n] >= 0, state[n], lower) if n < order else lower
            if n > 1:
                at = state[n - 1][grams.context[n]]
                back_off = share[n - 1][np.maximum(at - self._first(state[n - 1]), 0)] if len(share[n - 1]) else np.zeros(len(at))
                whole = known.count[n - 1][grams.context[n]]
                # Only n-grams that were seen become arcs; their contexts and suffixes were seen as well.
                probability[n] = (1 - back_off) * known.count[n] / np.maximum(whole, 1) + back_off * probability[n - 1][suffix[n]]
            seen = np.ones(self.n_words, bool) if n == 1 else known.count[n] > 0
            source = np.zeros(self.n_words, np.int64) if n == 1 else state[n - 1][grams.context[n]]
            words = np.arange(self.n_words) if n == 1 else grams.last[n]
            keys = (source * self.n_words + words)[seen].tolist()
            self.arcs.update(zip(keys, range(len(self.arcs), len(self.arcs) + len(keys))))
            weight.append(np.log10(probability[n][seen])), to.append(reached[n][seen])
            if n < order:
                back.append((np.zeros(self.n_words, np.int64) if n == 1 else lower)[state[n] >= 0])
        self.weight, self.to = np.concatenate(weight).tolist(), np.concatenate(to).tolist()
        self.fail, self.back = np.concatenate(fail).tolist(), np.concatenate(back).tolist()

    @staticmethod
    def _first(states: np.ndarray) -> int:
        return int(states[states >= 0].min(initial=np.iinfo(np.int64).max))

    @staticmethod
    def _suffixes(grams: Grams, n: int) -> np.ndarray:
        """The number of the n-gram without its first token."""
        out = np.zeros(len(grams.last[n]), np.int64)
        there = grams.of[n] >= 0
        out[grams.of[n][there]] = grams.of[n - 1][there]
        return out

    def walk(self, tokens: list[int]) -> float:
        """One traversal from left to right: the log10 probability of the tokens."""
        arcs, weight, to, fail, back, n_words = self.arcs, self.weight, self.to, self.fail, self.back, self.n_words
        state, total = 0, 0.0
        for token in tokens:
            arc = arcs.get(state * n_words + token)
            while arc is None:
                total += fail[state]
                state = back[state]
                arc = arcs.get(state * n_words + token)
            total += weight[arc]
            state = to[arc]
        return total


def score(docs: DataFrame, held_out: Column, order: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end for each text. The model of n-grams up to
    ``order`` learns from rows that aren't ``held_out`` and scores all. n_known counts tokens that training texts have;
    base_score is the sum of log10((c + 1) / (N + V + 1)), score the automaton's log10 probability of the text.
    A null text is an empty one: the end alone. Repeated rows and null ids are rows of their own, repeated ones are
    learned from as often as they come. Texts are whole, however long. With nothing to learn from every token has
    probability 1. Other columns are left out; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    groups = scratch.save(grouped(docs, held_out, doc_id, text), "groups")
    n_tokens, n_train = groups.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    buckets = max(partitions(docs.sparkSession), -(-(n_tokens or 0) // BUCKET_TOKENS))
    shape = ["group", "held", "sizes", "tokens", "words"]
    told, figures = groups.select("doc_ids", *shape), []
    for n in range(1, order + 1):
        ask, answer = (_asked_words(buckets), _answered_words(buckets)) if n == 1 else (_asked_grams(n, buckets), _answered_grams(buckets))
        asked = told.select(*shape, *(f"told_{k}" for k in range(1, n))).mapInArrow(ask, PIECE)
        answered = scratch.save(asked.groupBy("bucket").applyInArrow(answer, ANSWER), f"answers-{n}")
        scratch.free_shuffles()
        figures.append(answered.agg(F.sum("seen").alias("seen"), F.sum("total").alias("total"), F.sum("spread").alias("spread")).first())
        own = answered.groupBy("group").agg(F.collect_list(F.struct("bucket", "counts", *(["numbers"] if n < order else []))).alias(f"told_{n}"))
        told = told.join(own, "group", "left")
    vocabulary = figures[0]["seen"] or 0
    # Contexts of n tokens have, all together, as many continuations as there are n-grams of n + 1 tokens.
    scales = {n: (figures[n]["seen"] or 0) / figures[n - 1]["spread"] if figures[n - 1]["spread"] else 1.0 for n in range(1, order)}
    train = n_train or 0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, sizes, packed, words, *answers = (batch.column(i)[k].as_py() for i in range(2, 6 + order))
                tokens, sizes = _unpacked(packed)[0], np.array(sizes)
                grams = Grams(tokens, sizes, order)
                known = Known(_words(words), grams, answers, buckets)
                automaton = Automaton(grams, known, order, train, vocabulary, scales)
                first = np.cumsum(sizes) - sizes
                base = np.log10((known.count[1] + 1) / (train + vocabulary + 1))
                listed = tokens.tolist()
                scores = [automaton.walk(listed[a : a + n]) for a, n in zip(first.tolist(), sizes.tolist())]
                columns = [pa.array(held, pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((known.count[1] > 0)[tokens].astype(np.int64), first)), pa.array(np.full(len(sizes), train)), pa.array(np.add.reduceat(base[tokens], first)), pa.array(scores, pa.float64())]
                ids = batch.column(0)[k].values
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = groups.schema["doc_ids"].dataType.elementType.simpleString()
    return told.select("doc_ids", *shape, *(f"told_{n}" for n in range(1, order + 1))).mapInArrow(walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
