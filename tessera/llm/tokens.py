"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: Texts of over CHUNK characters are encoded in chunks that share OVERLAP characters at first.
CHUNK, OVERLAP = 1 << 14, 1 << 10
#: Characters before a cut's end whose words may still change: longer than any special token's string.
MARGIN = 64
#: Pieces between spaces, and words, that a worker remembers; once more as many from before.
PIECES, WORDS = 400_000, 100_000
#: What ends a word and is a word of its own.
PUNCTUATION = frozenset(".,;:!?")

_TWO_SPACES = re.compile(r"\s\s")
_BEFORE_WORD = re.compile(r"(?= \S)")
#: Fixed value: how a byte-level tokenizer of this kind cuts words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text on either side of a space that shows whether a tokenizer's words go across it.
PROBES = ["a", "Z", "é", "ß", "漢", "1", "²", "'s", "'", "!", "<", "_", "\n", "\t", "\u00a0", "\u3000", "😀", "\u0301", "\u200d", "\u0130"]


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def at_every_space(text: str) -> list[str]:
    return text.split(" ")


def before_words(text: str) -> list[str]:
    """At spaces before words alone, as further white space stays together."""
    if _TWO_SPACES.search(text):
        first, *rest = _BEFORE_WORD.split(text)
        return [first, *(p[1:] for p in rest)]
    return text.split(" ")


def whole(text: str) -> list[str]:
    return [text]


def splitter(tokenizer) -> tuple:
    """A function that cuts a text at spaces, and what to put before all pieces but the first to encode them apart.

    Whether a space parts words, and whether it belongs to the one after it, is asked of the tokenizer's own
    normalizer and pre-tokenizer. Where it doesn't, or an added token reaches over white space, a text is one piece.
    """

    def words(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    def apart(text: str, split, lead: str) -> list[str]:
        first, *rest = split(text)
        return words(first) + [w for piece in rest for w in words(lead + piece)]

    reaching = any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokenizer.get_added_tokens_decoder().values())
    probes = [f"{x}{gap}{y}" for x in PROBES for y in PROBES for gap in (" ", "  ", "   ")]
    for split, lead in () if reaching else ((at_every_space, ""), (before_words, " ")):
        if all(words(text) == apart(text, split, lead) for text in probes):
            return split, lead
    return whole, ""


# The one normalizer, besides none, that ``word_spelling`` stands in for.
SPACED_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def word_spelling(tokenizer):
    """How Latin text is spelt to the model, or None: functions that lower its case (or don't), that find its words
    and that write a word as the model knows it; and the model, which remembers nothing itself.

    They do what normalizer and pre-tokenizer do to such text, in a tenth of their time: these lower the case or
    nothing, cut by a pattern and write each byte as a printable character.
    """
    import json

    import regex
    from tokenizers import models

    told = json.loads(tokenizer.to_str())
    steps = lambda part, inner: [] if part is None else part[inner] if part["type"] == "Sequence" else [part]
    changes = steps(told["normalizer"], "normalizers")
    *cuts, last = steps(told["pre_tokenizer"], "pretokenizers") or [{}]
    byte_level = last.get("type") == "ByteLevel" and not last["add_prefix_space"]
    if not byte_level or told["model"]["type"] != "BPE" or told["model"]["dropout"]:
        return None
    if not changes and not cuts and last["use_regex"]:
        lower, pattern = False, BYTE_LEVEL_WORDS
    elif changes == SPACED_LOWER and len(cuts) == 1 and not last["use_regex"] and cuts[0].get("behavior") == "Removed" and cuts[0]["invert"]:
        lower, pattern = True, cuts[0]["pattern"]["Regex"]
    else:
        return None
    find = regex.compile(pattern).findall
    # Fixed value: the usual map of bytes to printable characters; the rest follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    written = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def write(word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", written[32])
        return word.encode().decode("latin-1").translate(written)

    model = told["model"]
    named = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges") if model.get(k)}
    bare = models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], cache_capacity=0, **named)
    return str.lower if lower else str, find, write, bare


class Recent(dict):
    """Values of the keys that were asked for last, made at the first time: ``size`` of them and as many from before."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.before = size, make, {}

    def __missing__(self, key: str):
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """``value`` of the ids of a text, put together by ``join`` from those of pieces that are encoded once."""

    def __init__(self, path: str, value, join):
        self.tokenizer, self.value, self.join = load_tokenizer(path), value, join
        self.split, self.lead = splitter(self.tokenizer)
        self.lower, self.find, self.write, self.model = word_spelling(self.tokenizer) or (None,) * 4
        self.marks = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.words, self.firsts = Recent(WORDS, self._word), Recent(PIECES, self._piece)
        self.pieces = Recent(PIECES, lambda piece: self._piece(piece, self.lead)) if self.lead else self.firsts

    def _word(self, word: str):
        return self.value([token.id for token in self.model.tokenize(self.write(word))])

    def _piece(self, piece: str, lead: str = ""):
        """Latin words, and ASCII without a special token, go to the model word by word; all else to the library whole."""
        low = self.lower(piece) if self.find else ""
        if self.find and (low.isascii() or max(low) < "\u0250"):
            if low.isalpha():
                return self._word(lead + low)
            if low[-1:] in PUNCTUATION and low[:-1].isalpha():
                return self.join(((self.pieces if lead else self.firsts)[piece[:-1]], self.words[low[-1]]))
            if (low.isascii() or low.strip(" .,;:!?'").isalpha()) and self.marks.isdisjoint(low):
                return self.join(map(self.words.__getitem__, self.find(lead + low)))
        return self.value(self.tokenizer.encode(lead + piece, add_special_tokens=False).ids)

    def of(self, text: str):
        pieces = self.split(text)
        if self.lead:
            return self.join((self.firsts[pieces[0]], *map(self.pieces.__getitem__, pieces[1:])))
        return self.join(map(self.pieces.__getitem__, pieces))


def _word_starts(encoded, base: int) -> dict[int, int]:
    """Character position in the whole text of each word's first token -> the token's index."""
    starts, last = {}, object()
    for i, (word, (begin, _)) in enumerate(zip(encoded.word_ids, encoded.offsets)):
        if word is None or word != last:
            starts.setdefault(base + begin, i)
        last = word if word is not None else object()
    return starts


def _common_start(a, a_from: int, a_to: int, b, b_from: int, after: int) -> int | None:
    """The first position where a word starts in both encodings and from which they give the same tokens.

    Words are cut from left to right and encoded one by one, so from a common start on, both chunks go
    through the same states; only words near the end of ``a`` may have lost their right context. Four
    words that agree before that end are asked for as well.
    """
    ours, theirs = _word_starts(a, a_from), _word_starts(b, b_from)
    shared = sorted(p for p in ours.keys() & theirs.keys() if max(after, b_from + MARGIN) < p < a_to - MARGIN)
    for p, q in zip(shared, shared[4:]):
        if a.ids[ours[p] : ours[q]] == b.ids[theirs[p] : theirs[q]]:
            return p
    return None


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by splicing overlapping chunks; equal to encoding the text as a whole."""
    encode = functools.partial(tokenizer.encode, add_special_tokens=False)
    begin, end, done, total = 0, min(len(text), chunk), 0, 0
    current = encode(text[:end])
    while end < len(text):
        wide, size = overlap, chunk
        while True:
            next_begin = max(begin, end - wide)
            next_end = min(len(text), max(end, next_begin) + size)
            following = encode(text[next_begin:next_end])
            if next_begin == begin:  # the overlap is the whole chunk: it has grown instead
                current, end = following, next_end
                break
            cut = _common_start(current, begin, end, following, next_begin, done)
            if cut is not None:
                total += sum(done <= begin + o[0] < cut for o in current.offsets)
                current, begin, end, done = following, next_begin, next_end, cut
                break
            wide, size = wide * 2, size * 2
    return total + sum(done <= begin + o[0] for o in current.offsets)


@functools.lru_cache(maxsize=2)
def counting(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, len, sum)


def token_counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """A pandas UDF: text -> number of tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = counting(path)
        for texts in batches:
            yield pd.Series([encoder.of(t) if len(t) <= chunk else count_long(encoder.tokenizer, t, chunk, overlap) for t in texts], dtype="int64")

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    No begin, end or added tokens; strings of special tokens inside a text count as the library's default
    has it. Null and empty texts count 0. One row for each row, repeated ones too; null ids are kept;
    further columns are left out; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), token_counter(tokenizer_path)(body).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> Encoder:
    """The ids of whole texts as little-endian unsigned 32-bit numbers; one for all tasks of a worker."""
    return Encoder(path, _packed, b"".join)
