"""Exactly one copy of each message, by exact quotient hash tables.

An identifier is laid out in fixed-width words (its width is a multiple of 8 bytes and its
length fills the last word), and the words are permuted by an invertible mixing. The high
bits of the permuted identifier are the quotient: they name the shard and, inside it, the
home slot. All other bits, the complete remainder, are stored, so that two identifiers
meet in a slot only if they are the same: there are no false matches and no false misses.

Each input partition first runs its own table, so that a message delivered very often is
reduced before the shuffle; the survivors then meet in the table of their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.shared import stripped, tasks

ROUNDS = 3
SHARD_BITS = 16
_LATE = np.int64(2**63 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_key(r: int, i: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (97 * r + i + 1)) & 0xFFFFFFFFFFFFFFFF)


def permute(words: np.ndarray) -> np.ndarray:
    """A permutation of the identifiers of one width: each step adds to a word a function of its neighbour."""
    out = words.copy()
    width = out.shape[1]
    for r in range(ROUNDS):
        for i in range(width):
            out[:, i] ^= _mix(out[:, (i - 1) % width] + _round_key(r, i))
    return out


def unpermute(words: np.ndarray) -> np.ndarray:
    """The inverse of `permute`; the tests use it to show that nothing is lost."""
    out = words.copy()
    width = out.shape[1]
    for r in reversed(range(ROUNDS)):
        for i in reversed(range(width)):
            out[:, i] ^= _mix(out[:, (i - 1) % width] + _round_key(r, i))
    return out


def words_of(keys: list[bytes], width: int) -> np.ndarray:
    """Identifiers of at most 8 * (width - 1) bytes as rows of `width` words; the last word is the length."""
    size = 8 * (width - 1)
    out = np.zeros((len(keys), width), dtype=np.uint64)
    if keys:
        out[:, :-1] = np.frombuffer(b"".join(k.ljust(size, b"\0") for k in keys), dtype="<u8").reshape(len(keys), -1)
        out[:, -1] = [len(k) for k in keys]
    return out


class QuotientTable:
    """Open addressing on the quotient with complete remainders; holds for each identifier its best copy."""

    def __init__(self, width: int, bits: int = 10):
        self.width = width
        self.count = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.used = np.zeros(1 << bits, dtype=bool)
        self.rest = np.zeros((1 << bits, self.width), dtype=np.uint64)
        self.t = np.full(1 << bits, _LATE)
        self.i = np.full(1 << bits, _LATE)

    def _place(self, words: np.ndarray) -> np.ndarray:
        """The slot of each identifier; new ones take the first free slot after their quotient."""
        mask = (1 << self.bits) - 1
        # the top bits chose the shard: the home slot takes the bits below them
        home = (words[:, 0] << np.uint64(SHARD_BITS)) >> np.uint64(64 - self.bits)
        slot = home.astype(np.int64)
        todo = np.arange(len(words))
        while len(todo):
            at = slot[todo]
            free = ~self.used[at]
            if free.any():
                where, first = np.unique(at[free], return_index=True)
                self.rest[where] = words[todo[free][first]]
                self.used[where] = True
                self.count += len(where)
            other = (self.rest[at] != words[todo]).any(axis=1)
            todo = todo[other]
            slot[todo] = (slot[todo] + 1) & mask
        return slot

    def insert(self, words: np.ndarray, t: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Insert copies; returns the ids of the copies that lost, whether new or held before."""
        if not len(words):
            return np.empty(0, dtype=np.int64)
        bits = self.bits
        while (self.count + len(words)) * 2 > (1 << bits):
            bits += 1
        if bits != self.bits:
            keep = self.used
            rest, t0, i0 = self.rest[keep], self.t[keep], self.i[keep]
            self._make(bits)
            self.count = 0
            slot = self._place(rest)
            self.t[slot], self.i[slot] = t0, i0
        before = self.count
        slot = self._place(words)
        order = np.lexsort((i, t, slot))
        s, tt, ii = slot[order], t[order], i[order]
        lead = np.ones(len(s), dtype=bool)
        lead[1:] = s[1:] != s[:-1]
        lost = [ii[~lead]]
        s, tt, ii = s[lead], tt[lead], ii[lead]
        held = self.i[s] != _LATE if before else np.zeros(len(s), dtype=bool)
        better = ~held | (tt < self.t[s]) | ((tt == self.t[s]) & (ii < self.i[s]))
        lost += [self.i[s[held & better]], ii[held & ~better]]
        win = s[better]
        self.t[win], self.i[win] = tt[better], ii[better]
        return np.concatenate(lost)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(identifiers, time, id) of the best copies."""
        return self.rest[self.used], self.t[self.used], self.i[self.used]


_SCHEMA = "ident binary, shard int, t bigint, i bigint, lost boolean"


def _lost_rows(ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"ident": None, "shard": (ids & 0x7FFF).astype("int32"), "t": _LATE, "i": ids, "lost": True})


def _best_rows(tables: dict[int, QuotientTable]) -> Iterator[pd.DataFrame]:
    for width, held in tables.items():
        words, t, i = held.best()
        shard = (words[:, 0] >> np.uint64(64 - SHARD_BITS)).astype("int32")
        for lo in range(0, len(words), 20_000):
            part = np.ascontiguousarray(words[lo : lo + 20_000]).astype("<u8")
            raw = part.tobytes()
            size = 8 * width
            yield pd.DataFrame(
                {
                    "ident": [raw[k : k + size] for k in range(0, len(raw), size)],
                    "shard": shard[lo : lo + 20_000],
                    "t": t[lo : lo + 20_000],
                    "i": i[lo : lo + 20_000],
                    "lost": False,
                }
            )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: lay out, permute and insert the identifiers of one input partition."""
    tables: dict[int, QuotientTable] = {}
    for batch in batches:
        keys = batch["key"].to_numpy()
        t, i = batch["t"].to_numpy(dtype=np.int64), batch["i"].to_numpy(dtype=np.int64)
        width = np.array([-(-len(k) // 8) + 1 for k in keys], dtype=np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            held = tables.setdefault(int(w), QuotientTable(int(w)))
            lost = held.insert(permute(words_of([bytes(k) for k in keys[rows]], int(w))), t[rows], i[rows])
            if len(lost):
                yield _lost_rows(lost)
    yield from _best_rows(tables)


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """After the shuffle: all copies of an identifier are here."""
    tables: dict[int, QuotientTable] = {}
    for batch in batches:
        gone = batch["lost"].to_numpy(dtype=bool)
        if gone.any():
            yield _lost_rows(batch["i"].to_numpy(dtype=np.int64)[gone])
        live = batch[~gone]
        size = live["ident"].map(len).to_numpy(dtype=np.int64) // 8
        for w in np.unique(size):
            rows = live[size == w]
            words = np.frombuffer(b"".join(bytes(x) for x in rows["ident"]), dtype="<u8").reshape(-1, int(w))
            held = tables.setdefault(int(w), QuotientTable(int(w)))
            lost = held.insert(words.astype(np.uint64), rows["t"].to_numpy(dtype=np.int64), rows["i"].to_numpy(dtype=np.int64))
            if len(lost):
                yield _lost_rows(lost)
    yield from _best_rows(tables)


def message_copies(rows: DataFrame, key: list[Column], received: str, copy_id: str) -> DataFrame:
    """(copy_id, is_kept): which copy of each message is kept.

    Messages are the same if all columns of `key` are equal; nulls in any but the first are
    equal to each other. Rows whose first key column is null have no identifier and don't
    come out. The copy with the earliest `received` is kept, nulls last, then the smallest
    `copy_id` (an integer, unique). An empty table gives no rows.
    """
    spark = rows.sparkSession
    # a null is a sign of its own, which no text with its length before it is
    part = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    laid = rows.where(key[0].isNotNull()).select(
        F.concat_ws("\x1f", *[part(k.cast("string")) for k in key]).cast("binary").alias("key"),
        F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(int(_LATE))).alias("t"),
        F.col(copy_id).cast("bigint").alias("i"),
    )
    local = laid.mapInPandas(_combine, _SCHEMA)
    met = local.repartition(tasks(spark), "shard").mapInPandas(_shard, _SCHEMA)
    return met.select(F.col("i").alias(copy_id), (~F.col("lost")).alias("is_kept"))


def delivery_copies(deliveries: DataFrame) -> DataFrame:
    """`message_copies` of prediction deliveries: custom_id without surrounding white space, within run_condition."""
    return message_copies(
        deliveries, [stripped(F.col("custom_id")), F.col("run_condition")], "received_ts", "delivery_id"
    )


def delivered_once(deliveries: DataFrame) -> DataFrame:
    """The rows of `deliveries`, one copy of each message; rows without custom_id are no copies and stay."""
    lost = delivery_copies(deliveries).where(~F.col("is_kept")).select("delivery_id")
    return deliveries.join(lost, "delivery_id", "left_anti")
