"""Encoding of texts by a public byte-level BPE vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern; each is merged with a hierarchical-bitmap
rank queue: a bucket per merge rank holds places in a linked list of parts, three levels of bitmaps over
the ranks find the next rank to merge by find-first-set, and entries whose pair has changed meanwhile are
skipped. The work on a pre-token of n bytes grows as n log n, so a text without any break costs no more
per byte than prose. Merged words are kept in a bounded cache; it changes the time, never the ids.

Defined results: null and empty texts have the empty list of ids; a row comes out for every row that
goes in; special tokens in a text are ordinary text. Rows stay in their partition, there is no shuffle.
The vocabulary is read once by the driver from ``vocab`` and broadcast: its size is fixed and checked.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from casetrail.session import ship

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCAB_BYTES = 32 << 20
#: Fixed value: the vocabulary's own pattern of pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE_WORDS = 400_000
CACHE_CHARS = 64


class RankQueue:
    """Places by merge rank; three levels of 64-way bitmaps find the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] &= word - 1
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        places, self.buckets[rank] = self.buckets[rank], None
        return rank, places


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.names = {i: b for b, i in ranks.items()}
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}

    def merged(self, left: int, right: int) -> int:
        """The id of two parts as one, or -1."""
        key = (left, right)
        if (got := self.pairs.get(key)) is None:
            got = self.pairs[key] = self.ranks.get(self.names[left] + self.names[right], -1)
        return got

    def merge(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        ids = [self.bytes[b] for b in word]
        n, merged, queue = len(ids), self.merged, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := merged(ids[i], ids[i + 1])) >= 0:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, places = got
            places.sort()
            for i in places:
                j = after[i]
                if ids[i] < 0 or j >= n or merged(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := merged(rank, ids[k])) >= 0:
                        queue.push(r, i)
                if (h := before[i]) >= 0 and (r := merged(ids[h], rank)) >= 0:
                    queue.push(r, h)
        return [x for x in ids if x >= 0]

    def _cut(self, text: str) -> tuple[int, ...]:
        pieces = self.find(text)
        if len(pieces) == 1:
            return tuple(self.merge(text.encode("utf-8", "replace")))
        return tuple(chain.from_iterable([self._word(self.pieces, p, None) for p in pieces]))

    def encode(self, text: str | None) -> list[int]:
        """Pre-tokens never reach over a single blank before a word, so words are looked up whole;
        texts with a blank beside other white space go through the pattern as they are."""
        if not text:
            return []
        for cache in (self.first, self.later, self.pieces):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        words = text.split(" ")
        out = list(map(self.later.get, words))
        out[0] = self.first.get(words[0])
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    w = words[i]
                    if not w or w[0].isspace() or w[-1].isspace():
                        return list(self._cut(text))
                    if not i:
                        out[0] = self._word(self.first, w, w)
                        continue
                    out[i] = self._word(self.later, w, " " + w)
        return list(chain.from_iterable(out))

    def _word(self, cache: dict, key: str, text: str | None) -> tuple[int, ...]:
        if (got := cache.get(key)) is None:
            got = tuple(self.merge(key.encode("utf-8", "replace"))) if text is None else self._cut(text)
            if len(key) <= CACHE_CHARS:
                cache[key] = got
        return got


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    data = shared.value
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data))
    return _encoders[key]


def broadcast_vocab(spark, vocab: str):
    with open(vocab, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary {vocab} has over {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, key: str, text: str, vocab: str = VOCAB) -> DataFrame:
    """(key, ids): the ids of every row's text."""
    ship(df.sparkSession)
    source = df.select(key, text)
    schema = StructType([source.schema[key], StructField("ids", ArrayType(IntegerType(), False))])
    shared = broadcast_vocab(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared).encode
        for batch in batches:
            ids = [enc(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, vocab: str = VOCAB) -> DataFrame:
    """(key, n_tokens): the number of ids of every row's text."""
    ship(df.sparkSession)
    source = df.select(key, text)
    schema = StructType([source.schema[key], StructField("n_tokens", IntegerType())])
    shared = broadcast_vocab(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared).encode
        for batch in batches:
            n = [len(enc(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    return source.mapInArrow(run, schema)
