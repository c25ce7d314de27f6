"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, then a linear softmax.

A token is the sum of the vectors of its word and of its character n-grams; a document is the mean over all
its subwords; the label is a softmax of that mean. Vectors and softmax weights are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows, in one task. Misspelt or unseen words share
n-gram vectors with words that were seen. As the model is linear once the vectors are learned, each
subword's share of the logit is a number, and a text's score is a mean of these numbers. N-grams are hashed,
looked up and added as numpy arrays over all words of a batch of texts.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import held_out, labelled_sample, small_batches

#: The bucket of a word that came before.
AGAIN = 0
#: Characters of words that are looked at together, which bounds memory on very long texts.
BLOCK = 1 << 19


@dataclasses.dataclass(frozen=True)
class Settings:
    """``rows_per_label`` and ``train_chars`` bound the training sample: rows of label 0 and of label 1, the
    ones with the smallest hash of their id first, and characters of a training text (longer labelled texts
    are not trained on; all texts are scored whole). ``again`` adds one more subword, the same one for all
    words, at each word that the text had before, so that repetition counts. ``balanced`` weighs both labels
    alike. A small sample is passed over more often, for ``least_steps`` steps at least."""

    lower: bool = True
    pattern: str = r"\w+"
    shortest: int = 3
    longest: int = 5
    buckets: int = 1 << 17
    dimensions: int = 4
    epochs: int = 6
    least_steps: int = 1000
    rate: float = 1.5
    batch: int = 16
    rows_per_label: tuple[int, int] = (4500, 1500)
    train_chars: int = 40_000
    again: bool = False
    balanced: bool = False
    seed: int = 7


@functools.lru_cache(maxsize=4)
def _word_characters(pattern: str) -> np.ndarray:
    """Whether each code point belongs to words; ``pattern`` is a repeated class of characters."""
    known = np.zeros(0x110000, bool)
    for first, end in ((0, 0xD800), (0xE000, 0x110000)):
        for found in re.finditer(pattern, "".join(map(chr, range(first, end)))):
            known[first + found.start() : first + found.end()] = True
    return known


@dataclasses.dataclass
class Block:
    """Neighbouring words of some texts. ``grams`` holds, for each n, the bucket of the n-gram that starts at each
    character of ``<word>`` and whether it ends in the word; ``first`` is where each word starts there."""

    owner: np.ndarray
    first: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    words: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray


def blocks(texts: list[str], s: Settings) -> Iterator[Block]:
    """All subwords of ``texts``: each word, between ``<`` and ``>``, as a whole and its character n-grams."""
    texts = [t.lower() for t in texts] if s.lower else texts
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    inside = np.concatenate(([False], _word_characters(s.pattern)[codes], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    upto = np.cumsum(ends - starts + 2)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        yield _block(codes, starts[at:end], ends[at:end], owner[at:end], s)
        at = end


def _block(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, s: Settings) -> Block:
    lengths = ends - starts
    marked = lengths + 2
    first = np.cumsum(marked) - marked
    n = int(marked.sum())
    place = np.arange(n)
    within = place - np.repeat(first, marked)
    left = np.repeat(marked, marked) - within
    text = codes[np.minimum(np.repeat(starts, marked) + within - 1, len(codes) - 1)]
    text[first], text[first + marked - 1] = ord("<"), ord(">")
    shift = np.uint32(32 - s.buckets.bit_length() + 1)
    bucket = lambda h, n: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)) >> shift
    rolling, grams = text * np.uint32(0x9E3779B1), []
    for size in range(2, s.longest + 1):
        following = np.zeros(n, np.uint32)
        following[: max(0, n - size + 1)] = text[size - 1 :]
        rolling = (rolling + following) * np.uint32(0x85EBCA6B)
        if size >= s.shortest:
            grams.append((bucket(rolling, size), left >= size))
    long = text.astype(np.uint64) + (within.astype(np.uint64) << np.uint64(32))
    long *= np.uint64(0x9E3779B97F4A7C15)
    long ^= long >> np.uint64(29)
    hashes = np.add.reduceat(long * np.uint64(0xBF58476D1CE4E5B9), first)
    hashes ^= hashes >> np.uint64(32)
    sizes = 1 + sum(np.maximum(0, marked - size + 1) for size in range(s.shortest, s.longest + 1))
    return Block(owner, first, grams, bucket(hashes.astype(np.uint32), 0), hashes, sizes)


def repeated_words(found: list[Block], n: int) -> np.ndarray:
    """How many words of each of ``n`` texts are equal to an earlier one of the same text."""
    owner = np.concatenate([b.owner for b in found]) if found else np.zeros(0, np.int64)
    hashes = np.concatenate([b.hashes for b in found]) if found else np.zeros(0, np.uint64)
    own = (hashes + owner.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    _, one = np.unique(own, return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[one], minlength=n)


@dataclasses.dataclass
class Model:
    settings: Settings
    #: Share of each bucket in the logit of label 1 against label 0, and the bias.
    share: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """The softmax of each text's mean; a text without words has the bias alone."""
        total, n, found = np.zeros(len(texts)), np.zeros(len(texts)), []
        for block in blocks(texts, self.settings):
            per_character = sum(np.where(valid, self.share[bucket], 0) for bucket, valid in block.grams)
            per_word = np.add.reduceat(per_character, block.first) + self.share[block.words]
            total += np.bincount(block.owner, per_word, len(texts))
            n += np.bincount(block.owner, block.sizes, len(texts))
            if self.settings.again:
                block.grams = []
                found.append(block)
        if self.settings.again:
            repeats = repeated_words(found, len(texts))
            total += repeats * self.share[AGAIN]
            n += repeats
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def _features(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their weights, which sum to 1, of each text."""
    out = []
    for text in texts:
        found = list(blocks([text], s))
        ids = [bucket[valid] for block in found for bucket, valid in block.grams] + [block.words for block in found]
        if s.again:
            ids.append(np.full(repeated_words(found, 1)[0], AGAIN, np.uint32))
        unique, counts = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.zeros(0, np.uint32), np.zeros(0))
        out.append((unique.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Trains vectors and softmax weights together. With no row of one label the score is the other's rate."""
    rng = np.random.default_rng(s.seed)
    y = np.asarray(labels, dtype=np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return Model(s, np.zeros(s.buckets), float(np.log(rate / (1 - rate))))
    features = _features(texts, s)
    vectors = rng.normal(0, 1 / s.dimensions, (s.buckets, s.dimensions))
    weights, bias = rng.normal(0, 0.5, (s.dimensions, 2)), np.zeros(2)
    cost = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) if s.balanced else np.ones(len(y))
    per_epoch = -(-len(y) // s.batch)
    epochs = max(s.epochs, -(-s.least_steps // per_epoch))
    steps, done = epochs * per_epoch, 0
    # A mean over thousands of subwords moves each vector by a thousandth: rates are per document, not per subword.
    squares = np.full(s.buckets, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), s.batch):
            rows = order[at : at + s.batch]
            rate_now = s.rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([features[r][0] for r in rows])
            w = np.concatenate([features[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(features[r][0]) for r in rows])
            means = np.zeros((len(rows), s.dimensions))
            picked = vectors[ids]
            for d in range(s.dimensions):
                means[:, d] = np.bincount(owner, picked[:, d] * w, len(rows))
            logits = means @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= cost[rows, None] / len(rows)
            back = p @ weights.T
            weights -= rate_now * means.T @ p
            bias -= rate_now * 0.1 * p.sum(0)
            unique, where = np.unique(ids, return_inverse=True)
            step = np.empty((len(unique), s.dimensions))
            for d in range(s.dimensions):
                step[:, d] = np.bincount(where, back[owner, d] * w, len(unique))
            squares[unique] += (step**2).mean(1)
            vectors[unique] -= rate_now * 0.2 * step / np.sqrt(squares[unique])[:, None]
    return Model(s, vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str, s: Settings, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Trains on at most ``rows_per_label`` texts of either label, never of held-out ids.

    The bounded sample is trained on in one task of an executor; the driver sees the model alone.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, s.rows_per_label, doc_id, text, F.length("_text") <= s.train_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((crc32(t.encode("utf-8", "replace")), y, t) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if rows:
            model = fit([t for _, _, t in rows], [y for _, y, _ in rows], s)
            yield pa.RecordBatch.from_arrays([pa.array([model.share.tobytes()], pa.binary()), pa.array([model.bias])], ["share", "bias"])

    found = sample.select("_text", F.col("_label").cast("long").alias("_label")).coalesce(1).mapInArrow(run, "share binary, bias double").collect()
    return Model(s, np.frombuffer(bytes(found[0]["share"])), found[0]["bias"]) if found else fit([], [], s)


def scorer(docs: DataFrame, model: Model) -> Column:
    """A pandas UDF: text -> probability of label 1; the model is of fixed size and broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, label: str, s: Settings, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every whole text.

    Only the text is an input of a score. Null and empty texts get the model's prior. One row for each row;
    null ids are kept (and aren't held out); further columns are left out; an empty table gives none.
    """
    model = train(docs, labels, label, s, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), scorer(docs, model)(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: Insults hide in ordinary prose, so case and punctuation are dropped and word forms matter.
TOXICITY = Settings()
#: Junk shows in case, punctuation and symbols as much as in words.
QUALITY = Settings(lower=False, pattern=r"\S+", shortest=2, longest=4, rows_per_label=(1500, 3000), epochs=5, again=True)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = TOXICITY, threshold: float = 0.5) -> DataFrame:
    return score_documents(docs, labels, "toxic", settings, threshold)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = QUALITY, threshold: float = 0.3) -> DataFrame:
    return score_documents(docs, labels, "quality", settings, threshold)
