"""Token counts by rank-synchronous merging of a byte-pair vocabulary.

Texts are split into pre-tokens; those not seen before in the task are held as
one ragged numpy array of symbols.  In each round every sequence applies its
lowest-rank pair, all its occurrences at once, until no sequence has a pair
left; what survives is counted.  Merging a pair only makes pairs of higher
rank, so a round equals the library's one-at-a-time order.

The vocabulary file's path is a parameter, read once on the driver; its tables
(about 50,000 merges) are broadcast.  Supported files: a ``tokenizers`` JSON
with NFC, white-space folding, lower-casing, a split pattern and word-end
suffixes.  Special strings inside a text count as one token each, as by the
library's default.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import python_ready

LIMIT = 2048
SLOT_BITS = 20
#: Pre-tokens whose counts a task remembers; the store is emptied when full.
REMEMBERED = 1 << 18
#: Symbols merged together in one ragged array.
SYMBOLS = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    first: np.ndarray      # symbol of each byte inside a word
    last: np.ndarray       # symbol of each byte that ends a word
    pair: np.ndarray       # sorted left << 32 | right
    rank: np.ndarray       # rank of each pair
    merged: np.ndarray     # symbol by rank
    split: str
    rare: str              # characters that the library's Unicode tables class otherwise
    rare_split: str        # the pattern for texts that hold one of them
    specials: list[str]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def ranges(points: set[int]) -> str:
    """A character class body for the code points."""
    out, rest = [], sorted(points)
    for c in rest:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def adapted(split: str) -> tuple[str, str]:
    """Characters whose class differs between the library's Unicode tables and
    those of ``regex``, and the split pattern with the library's classes."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[int] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pieces = pre_tokenizers.Split(Regex(name), "removed", invert=True).pre_tokenize_str(every)
        theirs, ours = {ord(p) for p, _ in pieces}, {ord(c) for c in regex.findall(name, every)}
        more, less = theirs - ours, ours - theirs
        odd |= more | less
        kind = f"[{name}--[{ranges(less)}]]" if less else name
        split = split.replace(name, f"[{kind}||[{ranges(more)}]]" if more else kind)
    return ranges(odd), "(?V1)" + split


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    ids, letters = model["vocab"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pair = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(pair, kind="stable")
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(np.array([ids[c] for c in letters], np.int64),
                      np.array([ids[c + end] for c in letters], np.int64), pair[order],
                      order.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int64),
                      split, *adapted(split), [t["content"] for t in spec["added_tokens"]])


class Merger:
    """Counts the symbols of pre-tokens after all merges."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        slot = self._slot(vocabulary.pair)
        self.table = np.full(1 << SLOT_BITS, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot[self.table[slot] != np.arange(len(slot))]] = True

    @staticmethod
    def _slot(pair):
        return (pair.view(np.uint64) * MULTIPLIER >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, pair: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        slot = self._slot(pair)
        at = self.table[slot]
        miss = (at < 0) | (self.v.pair[at] != pair)
        again = np.flatnonzero(miss & self.shared[slot])
        if len(again):
            found = np.minimum(np.searchsorted(self.v.pair, pair[again]), len(self.v.pair) - 1)
            hit = self.v.pair[found] == pair[again]
            at[again[hit]] = found[hit]
            miss[again[hit]] = False
        return np.where(miss, len(self.v.pair), self.v.rank[at])

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.v.first[raw]
        ends = np.cumsum(size) - 1
        symbol[ends[size > 0]] = self.v.last[raw[ends[size > 0]]]
        owner = np.repeat(np.arange(len(words)), size)
        out, none = size.copy(), len(self.v.pair)
        while len(symbol) > 1:
            pair = symbol[:-1] << 32 | symbol[1:]
            rank = np.full(len(pair), none, np.int64)
            near = owner[1:] == owner[:-1]
            rank[near] = self.ranks(pair[near])
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.append(rank, none), begin)
            alive = best < none
            length = np.diff(np.append(begin, len(owner)))
            chosen = np.repeat(best, length)[:-1]
            merge = (rank == chosen) & near & (chosen < none)
            merge &= ~self._second_of_run(merge)
            at = np.flatnonzero(merge)
            symbol[at] = self.v.merged[rank[at]]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            out -= np.bincount(owner[at], minlength=len(words))
            keep = np.repeat(alive, length) & ~gone
            symbol, owner = symbol[keep], owner[keep]
        return out

    @staticmethod
    def _second_of_run(merge: np.ndarray) -> np.ndarray:
        """Of overlapping matches (equal symbols in a row) every second one."""
        index = np.arange(len(merge))
        begin = merge & ~np.r_[False, merge[:-1]]
        start = np.maximum.accumulate(np.where(begin, index, 0))
        return merge & ((index - start) % 2 == 1)


class Counting:
    """Tokens of texts; remembers pre-tokens across batches of a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.merger = Merger(vocabulary)
        self.split = regex.compile(vocabulary.split)
        specials = sorted(vocabulary.specials, key=len, reverse=True)     # the longest that fits is taken
        self.special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        self.rare = re.compile(f"[{vocabulary.rare}]" if vocabulary.rare else r"(?!)")
        self.rare_split = regex.compile(vocabulary.rare_split)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Special tokens of the text, and the pre-tokens between them.

        No pre-token holds white space, so folding it changes nothing."""
        parts = self.special.split(text) if any(s in text for s in self.merger.v.specials) else [text]
        out: list[str] = []
        for p in parts:
            if p.isascii():
                out += self.split.findall(p.lower())
                continue
            p = unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()
            out += (self.rare_split if self.rare.search(p) else self.split).findall(p)
        return len(parts) - 1, out

    def learn(self, words: list[str]) -> None:
        lo = 0
        while lo < len(words):
            hi, size, raw = lo, 0, []
            while hi < len(words) and (hi == lo or size < SYMBOLS):
                raw.append(words[hi].encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                hi += 1
            self.known.update(zip(words[lo:hi], self.merger.counts(raw).tolist()))
            lo = hi

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        seen = set().union(*(words for _, words in split))
        fresh = seen - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, seen
        self.learn(list(fresh))
        return [n + sum(map(self.known.__getitem__, words)) for n, words in split]


def _count(vocabulary):
    def run(batches):
        counting = Counting(vocabulary.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            counts: list[int] = []
            for lo in range(0, len(texts), 100):
                counts += counting.count(texts[lo:lo + 100])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = python_ready(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
