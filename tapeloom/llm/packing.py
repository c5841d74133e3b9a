"""Filling containers of fixed capacity with items, by minimum bin slack.

What matters of the items is how many there are of each length, at most `capacity` numbers
however large the corpus. On these counts containers are filled one pattern after another:
the largest length that is left opens the container, and a subset-sum over the lengths that
are left, a bitset of reachable sums, finds the filling closest to the capacity; going back
through the bitsets gives the counts. A pattern is used as often as the counts allow, so that
the number of fillings depends on the capacity and not on the corpus. Afterwards every item
finds its container from its rank among the items of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.bpe import encoded
from tapeloom.shared import beside, tasks, written

CAPACITY = 2048


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length of `counts` fill `room` as far as can be, longest lengths first."""
    reach = 1
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    steps: list[tuple[int, int, int]] = []
    for size in sorted(counts, reverse=True):
        most = min(counts[size], room // size) if size <= room else 0
        if not most:
            continue
        steps.append((size, most, reach))
        left, step = most, 1
        while left:
            step = min(step, left)
            reach |= (reach << (size * step)) & mask
            left -= step
            step *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, most, before in reversed(steps):
        for k in range(most + 1):
            if at >= k * size and before >> (at - k * size) & 1:
                if k:
                    used[size] = k
                at -= k * size
                break
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by length, times) of containers that hold all items of `counts`."""
    left = {s: c for s, c in counts.items() if c}
    out = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        used = best_filling({s: c for s, c in rest.items() if c}, capacity - largest)
        used[largest] = used.get(largest, 0) + 1
        times = min(left[s] // k for s, k in used.items())
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        out.append((used, times))
    return out


def _plan(found: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, items in a container, and first container of each use of a pattern."""
    at: dict[int, int] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for used, times in found:
        for size, k in used.items():
            spans.setdefault(size, []).append((at.get(size, 0), k, container))
            at[size] = at.get(size, 0) + k * times
        container += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in spans.items()}


def _assign(plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size, rank = batch["n_tokens"].to_numpy(), batch["rank"].to_numpy(dtype=np.int64)
            container = np.zeros(len(batch), dtype=np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                first, each, base = plan[int(s)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                container[rows] = base[k] + (rank[rows] - first[k]) // each[k]
            yield batch[["doc_id", "part_no", "n_tokens"]].assign(container_id=container)

    return run


def packed(sizes: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, n_tokens, container_id): every item of positive size in a container.

    An item longer than `capacity` is cut into full parts and a rest; all others stay whole
    (part_no 0). Null and non-positive sizes have no place and don't come out; items of equal
    size are interchangeable and go in the order of their hash, doc_id and part_no. An empty
    table gives no rows.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(doc_id).alias("doc_id"), F.col(size).cast("int").alias("n")).where(F.col("n") > 0)
    parts = items.select(
        "doc_id",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("part_no"),
        "n",
    ).select("doc_id", "part_no", F.least(F.col("n") - F.col("part_no") * capacity, F.lit(capacity)).alias("n_tokens"))
    # one length may be that of a third of the items: ranks are counted by shards of each length
    shards = tasks(spark)
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)).cast("int"))
    parts = written(parts, "items")
    per_shard = parts.groupBy("n_tokens", "shard").agg(F.count(F.lit(1)).alias("items"))
    by_length = per_shard.groupBy("n_tokens").agg(F.sum("items").alias("items"))
    counts = {r["n_tokens"]: r["items"] for r in by_length.collect()}  # at most `capacity` rows
    plan = _plan(patterns(counts, capacity))
    earlier = Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_shard.select(
        "n_tokens", "shard", F.coalesce(F.sum("items").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "part_no")
    ranked = (
        parts.withColumn("k", F.row_number().over(inside))
        .join(offset, ["n_tokens", "shard"])
        .select("doc_id", "part_no", "n_tokens", (F.col("offset") + F.col("k") - 1).alias("rank"))
    )
    kind = dict(sizes.dtypes)[doc_id]
    return ranked.mapInPandas(
        _assign(plan), f"doc_id {kind}, part_no int, n_tokens int, container_id bigint"
    ).withColumnRenamed("doc_id", doc_id)


def packed_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`packed` of texts by their number of tokens of byte_bpe_50k; empty and null texts have none."""
    return packed(encoded(documents, with_ids=False), capacity=capacity)


def filling(sizes: DataFrame, placed: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row on a packing: containers, least_containers (that could hold all tokens), overfull containers, items with lost or
    added tokens, short items that were cut, and unused_share of the room. `sizes` are the items, `placed` what `packed` gave."""
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("filled"))
    full = per.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("filled") / capacity).alias("least_containers"),
        F.count_if(F.col("filled") > capacity).alias("overfull"), (1 - F.sum("filled") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
    got = placed.groupBy(doc_id).agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("parts"))
    want = sizes.where(F.col(size) > 0).groupBy(doc_id).agg(F.sum(size).alias("want"), F.max(size).alias("longest"))
    both = want.join(got, doc_id, "full_outer")
    items = both.agg(
        F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("wrong_items"), F.count_if((F.col("longest") <= capacity) & (F.col("parts") > 1)).alias("cut_short_items")
    )
    return beside(full, items)
