"""Near-duplicate records with small edits, by pigeonhole blocks.

A text's fingerprint is its multiset of words as a set of elements, the k-th occurrence of a
word being one element; the Hamming distance of two fingerprints is the number of elements
that only one of them has. Similarity s / (a + b - s) of at least t bounds that distance, for
a text of a elements by d = floor(a (1 - t) / t) whatever its partner.

The space of elements is split into blocks by hash. An element on which two texts differ
spoils one block, so that of a text's blocks all but d are equal in a close partner's
fingerprint: if both put d + 1 of their blocks, the first in one order of all blocks, into
the join, they share one of them. This needs more than d blocks that aren't empty, so that
their number grows with the texts: a pair is split into four blocks or more for each element
of the longer one's size class (powers of two), at least 512, and a text enters its own class
and the next one if a partner may be there. A text whose elements fall into d blocks or fewer
by chance (unlikely, but possible) is joined on single elements instead, with all texts. So no
pair is lost, whatever the lengths. The order takes the rarest blocks first, by a table of
hashed counts of fixed size, since blocks of common words pair texts for nothing. Candidates
are then verified by their exact distance.

Texts with equal fingerprints are one class and are joined as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.shared import tasks, written

_WORD = re.compile(r"\w+")
#: Blocks of the shortest texts, those of fewer than 2 * BLOCKS / PER_ELEMENT elements.
BLOCKS = 512
#: Blocks for each element of the least size of a class.
PER_ELEMENT = 4
#: Elements of texts that are taken at once, a single longer text aside.
_AT_ONCE = 2_000_000
#: Counters of the table of block frequencies, one for all texts however many there are.
COUNTERS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """A 64-bit hash of each word, kept for words that recur."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= 500_000:
            self.clear()
        self[word] = h
        return h


def elements(texts: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of the texts, one after another, and the number of each text; in the order of their hashes."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    of = known.__getitem__
    for k, text in enumerate(texts):
        found = _WORD.findall(text.lower())
        hashes += map(of, found)
        sizes[k] = len(found)
    h = np.array(hashes, dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    # the k-th occurrence of a word in its text
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.empty(0, dtype=np.int64)
    nth = (np.arange(len(h)) - start).astype(np.uint64)
    e = _mix(h + nth * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((e, row))
    return e[order], sizes


def most_spoiled(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The greatest distance d that a text of each size can have from a close partner."""
    return np.floor(sizes * (1 - threshold) / threshold + 1e-9).astype(np.int64)


def size_classes(sizes: np.ndarray, threshold: float, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(text, blocks): the numbers of blocks that each text is split into, one for each class its partners may be in."""
    first = int(np.log2(blocks // PER_ELEMENT))
    low = np.maximum(np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64), first)
    longest = np.floor(sizes / threshold + 1e-9)
    high = np.maximum(np.floor(np.log2(np.maximum(longest, 1))).astype(np.int64), first)
    times = high - low + 1
    text = np.repeat(np.arange(len(sizes)), times)
    step = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
    return text, np.int64(PER_ELEMENT) << (low[text] + step)


def block_signatures(e: np.ndarray, sizes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit signature of each non-empty block of each text, and its text; `blocks` is the number for each text."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    of = blocks.astype(np.uint64)[row]
    block = e % of
    order = np.lexsort((block, row))
    b, r, x = block[order] + (of[order] << np.uint64(32)), row[order], e[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(_mix(x), start) if len(x) else np.empty(0, dtype=np.uint64)
    return _mix(total + _mix(b[start])), r[start]


def _parts(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, elements, sizes) of stretches of a list column that are small enough to be worked on at once."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    e = lists.values.to_numpy().view(np.uint64)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _AT_ONCE, side="right")) - 1)
        yield lo, e[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1])
        lo = hi


def _split(e: np.ndarray, sizes: np.ndarray, threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, entry of each, text of each entry): an entry is a text in one of its classes."""
    text, per_entry = size_classes(sizes, threshold, blocks)
    start = np.cumsum(sizes) - sizes
    n = sizes[text]
    at = np.repeat(start[text] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    sig, entry = block_signatures(e[at], n, per_entry)
    return sig, entry, text


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        texts, lo = batch.column(1).to_pylist(), 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < _AT_ONCE) and hi < lo + 2_000:
                chars += len(texts[hi])
                hi += 1
            e, sizes = elements(texts[lo:hi], known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int32)), _lists(_signed(e), sizes)],
                names=["class_id", "size", "e"],
            )
            lo = hi


def _class_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of the sorted words of each text that has any."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, keys = [], []
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _WORD.findall(text.lower())
            if found:
                found.sort()
                ids.append(row_id)
                keys.append(digest(" ".join(found).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"]
        )


def _block_counts(threshold: float, blocks: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for _, e, sizes in _parts(batch.column(0)):
                sig, _, _ = _split(e, sizes, threshold, blocks)
                total += np.bincount((sig % np.uint64(counters)).astype(np.int64), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    return run


def _first_blocks(counts, threshold: float, blocks: int):
    """(block, id, size) of the first d + 1 blocks of each text in each of its classes; a null block marks a text that
    has no more than d in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, e, sizes in _parts(batch.column(1)):
                sig, entry, text = _split(e, sizes, threshold, blocks)
                often = table[(sig % np.uint64(len(table))).astype(np.int64)]
                order = np.lexsort((sig, often, entry))
                sig, entry = sig[order], entry[order]
                filled = np.bincount(entry, minlength=len(text))
                most = most_spoiled(sizes, threshold)[text] + 1
                place = np.arange(len(entry)) - (np.cumsum(filled) - filled)[entry]
                keep = place < most[entry]
                few = np.unique(text[(filled < most) & (sizes[text] > 0)])
                row = np.concatenate([text[entry[keep]], few])
                none = np.zeros(len(row), dtype=bool)
                none[len(row) - len(few) :] = True
                block = np.concatenate([_signed(sig[keep]), np.zeros(len(few), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, mask=none), pa.array(ids[lo + row]), pa.array(sizes[row].astype(np.int32))],
                    names=["block", "id", "size"],
                )

    return run


def _first_elements(threshold: float):
    """(block, id, size): the first d + 1 elements of each text, each as a block of its own; they are in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, e, sizes in _parts(batch.column(1)):
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(e)) - (np.cumsum(sizes) - sizes)[row]
                keep = place <= most_spoiled(sizes, threshold)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(e[keep])), pa.array(ids[lo + row[keep]]), pa.array(sizes[row[keep]].astype(np.int32))],
                    names=["block", "id", "size"],
                )

    return run


def text_classes(rows: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(membership, texts): (id, class_id) of every text with a word, and (class_id, x) of one text of each class.

    Texts with the same words, as often each, are one class, named by its smallest id.
    """
    taken = rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
    )
    keys = written(taken.mapInArrow(_class_keys, "id bigint, key binary"), "keys")
    class_of = keys.groupBy("key").agg(F.min("id").alias("class_id"))
    members = written(keys.join(class_of, "key").select("id", "class_id"), "classes")
    leaders = members.where("id = class_id").select("id")
    return members, taken.join(leaders, "id", "left_semi").withColumnRenamed("id", "class_id")


def close_classes(
    texts: DataFrame, threshold: float = 0.75, blocks: int = BLOCKS, counters: int = COUNTERS
) -> DataFrame:
    """(class_a, class_b, similarity) of all pairs of `texts` (class_id, x) with similarity of at least
    `threshold` (above 0.5, so that a partner is in the same size class or a neighbouring one), class_a < class_b."""
    spark = texts.sparkSession
    fingerprints = written(
        texts.select("class_id", "x").mapInArrow(_fingerprints, "class_id bigint, size int, e array<bigint>"),
        "fingerprints",
    )
    per_counter = (
        fingerprints.select("e")
        .mapInArrow(_block_counts(threshold, blocks, counters), "at int, n bigint")
        .groupBy("at")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most `counters` rows
    )
    table = np.zeros(counters, dtype=np.int64)
    table[per_counter["at"].to_numpy(dtype=np.int64)] = per_counter["n"].to_numpy(dtype=np.int64)
    counts = spark.sparkContext.broadcast(table)
    lists = fingerprints.select("class_id", "e")
    chosen = lists.mapInArrow(_first_blocks(counts, threshold, blocks), "block bigint, id bigint, size int")
    chosen = chosen.repartition(tasks(spark), "block")  # the only exchange of all blocks: both uses below share it
    wanted = chosen.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR block IS NULL").select("block")
    live = written(chosen.join(wanted, chosen["block"].eqNullSafe(wanted["block"]), "left_semi"), "blocks")
    t = F.lit(threshold)

    def met(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        fits = (F.col("a.size") >= t * F.col("b.size")) & (F.col("b.size") >= t * F.col("a.size"))
        apart = F.col("a.id") < F.col("b.id") if once else F.col("a.id") != F.col("b.id")
        both = a.join(b, (F.col("a.block") == F.col("b.block")) & apart & fits)
        return both.select(F.least("a.id", "b.id").alias("class_a"), F.greatest("a.id", "b.id").alias("class_b"))

    pairs = met(live, live, True)
    few = live.where("block IS NULL").select(F.col("id").alias("few_id")).distinct()
    if not few.isEmpty():
        single = lists.mapInArrow(_first_elements(threshold), "block bigint, id bigint, size int")
        pairs = pairs.union(met(single.join(few, F.col("id") == F.col("few_id"), "left_semi"), single, False))
    candidates = written(pairs.distinct(), "candidates")
    asked = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    needed = written(fingerprints.join(asked, "class_id", "left_semi"), "asked")
    left = needed.select(F.col("class_id").alias("class_a"), F.col("size").alias("na"), F.col("e").alias("ea"))
    right = needed.select(F.col("class_id").alias("class_b"), F.col("size").alias("nb"), F.col("e").alias("eb"))
    # with the distance h = a + b - 2 s: s / (a + b - s) = (a + b - h) / (a + b + h)
    both = F.col("na") + F.col("nb")
    distance = both - 2 * F.size(F.array_intersect("ea", "eb"))
    return (
        candidates.join(left, "class_a")
        .join(right, "class_b")
        .withColumn("h", distance)
        .select("class_a", "class_b", ((both - F.col("h")) / (both + F.col("h"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def near_duplicates(rows: DataFrame, row_id: str, text: str, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): the class of every row, and the pairs of classes that are near-duplicates.

    `membership` is (id, class_id), `pairs` is (class_a, class_b, similarity). Words are maximal
    runs of letters, digits and underscores, lower-cased. Rows with a null id or text, and texts
    without words, are in no class; ids must be integers, repeated ones count as one row each.
    An empty table gives two empty tables.
    """
    members, texts = text_classes(rows, row_id, text)
    return members, close_classes(texts, threshold)


def near_duplicate_rows(rows: DataFrame, row_id: str, text: str, threshold: float = 0.75) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows whose texts are near-duplicates, copies included."""
    members, pairs = near_duplicates(rows, row_id, text, threshold)
    a = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    across = pairs.join(a, "class_a").join(b, "class_b").select("x", "y")
    same = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_links(rows: DataFrame, row_id: str, text: str, threshold: float = 0.75) -> DataFrame:
    """(id, class_id, copies, links) of every row with words: the size of its class and the number of other
    classes that are near-duplicates of it."""
    members, pairs = near_duplicates(rows, row_id, text, threshold)
    links = (
        pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
        .groupBy("class_id")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    copies = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    return (
        members.join(copies, "class_id")
        .join(links, "class_id", "left")
        .select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
