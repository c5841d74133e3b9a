"""Encoding of a corpus with a public byte-level BPE vocabulary.

The merges of a pre-token run over a linked list of its pieces. Open merges wait in a queue
by rank: a bucket of positions for each rank and a two-level bitmap of the ranks that have
any, whose lowest set bit is the next merge. A position whose pair has changed since it was
queued is stale and skipped. The work is near-linear in the length of the pre-token, so that
junk strings of tens of thousands of characters cost no more than ordinary text.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.shared import tokenizer_folder

#: Fixed value: the public pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORD = 256
_CACHED_CHARS = 48
_CACHE_ENTRIES = 400_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class RankQueue:
    """Positions by merge rank; a bit of `words` is set for each rank with a bucket, one of `top` for each such word."""

    def __init__(self, ranks: int):
        self.words = [0] * (-(-ranks // _WORD))
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank // _WORD
            self.words[w] |= 1 << (rank % _WORD)
            self.top |= 1 << w
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right; the queue must hold one."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        self.words[w] = word ^ low
        if word == low:
            self.top &= self.top - 1
        rank = w * _WORD + low.bit_length() - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions

    def __bool__(self) -> bool:
        return self.top != 0


class Encoder:
    """Ids of texts; special tokens' strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known = _Known(self)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        piece = [raw[k : k + 1] for k in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that starts here, -1 for none or a piece that is gone
        queue = self.queue
        for k in range(n - 1):
            r = ranks.get(raw[k : k + 2])
            if r is not None:
                pair[k] = r
                queue.push(r, k)
        while queue:
            rank, positions = queue.pop()
            for done, k in enumerate(positions):
                if pair[k] != rank:
                    continue  # stale
                gone = after[k]
                piece[k] += piece[gone]
                pair[gone] = -1
                right = after[gone]
                after[k] = right
                lowest = rank
                if right < n:
                    before[right] = k
                    r = ranks.get(piece[k] + piece[right], -1)
                    pair[k] = r
                    if r >= 0:
                        queue.push(r, k)
                        lowest = min(lowest, r)
                else:
                    pair[k] = -1
                left = before[k]
                if left >= 0:
                    r = ranks.get(piece[left] + piece[k], -1)
                    pair[left] = r
                    if r >= 0:
                        queue.push(r, left)
                        lowest = min(lowest, r)
                if lowest < rank:  # a lower merge has become possible: it goes first
                    for later in positions[done + 1 :]:
                        queue.push(rank, later)
                    break
        ids = []
        k = 0
        while k < n:
            ids.append(ranks[piece[k]])
            k = after[k]
        return ids

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        return [] if not text else np.frombuffer(self.packed(text), dtype="<i4").tolist()


class _Known(dict):
    """Packed ids by pre-token; pre-tokens recur so often that most are never merged twice."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: str) -> bytes:
        ids = self.encoder.merge(token.encode("utf-8", "replace"))
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(token) <= _CACHED_CHARS:
            if len(self) >= _CACHE_ENTRIES:
                self.clear()
            self[token] = packed
        return packed


_ENCODERS: dict[int, Encoder] = {}


def _encoder(raw: bytes, pattern: str) -> Encoder:
    key = hash((raw, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(raw), pattern)
    return _ENCODERS[key]


def _run(vocabulary, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, pattern)
        for batch in batches:
            ids_of = batch.column(0)
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 2_000):
                part = texts.slice(lo, 2_000)
                packed = [encoder.packed(x) if x else b"" for x in part.to_pylist()]
                size = np.fromiter((len(p) // 4 for p in packed), dtype=np.int32, count=len(packed))
                columns = [ids_of.slice(lo, 2_000)]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                columns.append(pa.array(size))
                yield pa.RecordBatch.from_arrays(columns, names=["id"] + ["ids"] * with_ids + ["n_tokens"])

    return run


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> bytes:
    """The bytes of a vocabulary file of the public tokenizers (under 1 MB)."""
    with open(os.path.join(folder or tokenizer_folder(), name), "rb") as file:
        return file.read()


def encoded(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
    folder: str | None = None,
    pattern: str = PATTERN,
) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row; without `with_ids` only (doc_id, n_tokens).

    Empty and null texts have an empty list and 0 tokens. No special tokens are added, and
    their strings in a text are ordinary text. A null or repeated doc_id is kept as it is;
    other columns are ignored. The vocabulary is read on the driver and sent to the workers.
    """
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(vocabulary_file(folder=folder))
    taken = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("x"))
    schema = "id bigint, " + "ids array<int>, " * with_ids + "n_tokens int"
    out = taken.mapInArrow(_run(vocabulary, pattern, with_ids), schema)
    return out.withColumnRenamed("id", doc_id)
