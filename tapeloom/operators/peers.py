"""Peer pairs: self-joins of rows that share a scope and a state, and what is measured on them.

Pairs are made by an equi-join on (scope, signature), never by a product; a large group is a
skewed key, which AQE splits. A pair is scored once, whatever is asked of it later.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.diff import distance
from tapeloom.functions.distances import Batch, Joined
from tapeloom.shared import tasks

TAUS = (0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)


def peer_pairs(
    rows: DataFrame, scope: list[str], signature: str | None, actor: str, row_id: str, payload: Sequence[str] = (), directed: bool = True
) -> DataFrame:
    """(scope, signature, a, b, actor_a, actor_b, payload_a, payload_b) of different actors with one scope and signature.

    Directed pairs come both ways, undirected ones once with a < b. Null scopes and signatures pair with nothing.
    Without a signature, all of a scope are peers.
    """
    keys = [*scope, *([signature] if signature else [])]
    take = lambda s: rows.select(
        *keys, F.col(row_id).alias(s), F.col(actor).alias(f"actor_{s}"), *[F.col(p).alias(f"{p}_{s}") for p in payload]
    )
    pairs = take("a").join(take("b"), keys).where(F.col("actor_a") != F.col("actor_b"))
    return pairs if directed else pairs.where(F.col("a") < F.col("b"))


#: Texts that are compared with one another in one task: of each pair's first and second texts.
FIRST, SECOND = 256, 512
#: So few are compared one by one, so many as bits of words of their own.
FEW, MANY = 2, 200


def _tile(rows: pd.DataFrame, limit: float | None = None) -> pd.DataFrame:
    """(a, b, distance) of the first texts with the second ones after them that are another actor's."""
    x, y = (rows[rows["second"] == k].sort_values("place") for k in (False, True))
    ids, actors, places, texts = y["id"].to_numpy(), y["actor"].to_numpy(), y["place"].to_numpy(), list(y["text"])
    out, batch, joined = [], None, None
    length = np.array([len(t) for t in texts], dtype=np.int64)
    for own, actor, place, text in zip(x["id"], x["actor"], x["place"], x["text"]):
        both = np.maximum(length + len(text), 1)
        take = (places > place) & (actors != actor)
        if limit is not None:
            take &= np.abs(length - len(text)) / both <= limit
        spots = np.flatnonzero(take)
        if len(spots):
            low, high = int(spots[0]), int(spots[-1]) + 1
            if len(spots) < FEW:
                edits = np.array([distance(text, texts[k]) for k in spots])
            elif high - low < MANY:
                joined = joined or Joined(texts)
                edits = np.array(joined.to(text, low, high))[spots - low]
            else:
                batch = batch or Batch(texts)
                edits = batch.to(text)[spots]
            far = edits / both[spots]
            out.append(pd.DataFrame({"a": np.minimum(ids[spots], own), "b": np.maximum(ids[spots], own), "distance": far}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": "int64", "b": "int64"})


def text_distances(rows: DataFrame, scope: list[str], actor: str, row_id: str, text: str, limit: float | None = None) -> DataFrame:
    """(scope, a, b, distance) of all pairs a < b of different actors in one scope: `code_distance` of their texts.

    A scope's texts are laid out by length and cut into tiles, each of which is one task's and compares a text with
    hundreds at a time. Null texts, actors and scopes pair with nothing; `row_id` is a number. Pairs whose lengths alone
    put them beyond `limit` are left out.
    """
    live = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*scope, actor, text)))
    live = live.select(*scope, F.col(row_id).cast("bigint").alias("id"), F.col(actor).alias("actor"), F.col(text).alias("text"))
    inside = Window.partitionBy(*scope)
    laid = live.withColumn("place", F.row_number().over(inside.orderBy(F.length("text"), "id")) - 1).withColumn("_n", F.count(F.lit(1)).over(inside))
    i, j = F.floor(F.col("place") / FIRST), F.floor(F.col("place") / SECOND)
    last_i, last_j = F.floor((F.col("_n") - 1) / FIRST), F.floor((F.col("_n") - 1) / SECOND)
    kinds = F.array(F.lit(False), F.lit(True))
    sent = laid.withColumn("second", F.explode(kinds))
    own = F.when(F.col("second"), F.sequence(F.lit(0).cast("bigint"), F.least(last_i, (j + 1) * (SECOND // FIRST) - 1))).otherwise(F.sequence(F.floor(i * FIRST / SECOND), last_j))
    sent = sent.withColumn("_k", F.explode(own))
    sent = sent.withColumn("_i", F.when(F.col("second"), F.col("_k")).otherwise(i)).withColumn("_j", F.when(F.col("second"), j).otherwise(F.col("_k")))
    sent = sent.select(*scope, "_i", "_j", "id", "actor", "text", "place", "second")
    sent = sent.repartition(4 * tasks(rows.sparkSession), *scope, "_i", "_j")  # a tile is small but long: tiles aren't put together by bytes

    def tile(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        done = _tile(frame, limit)
        for c, v in zip(scope, key):
            done[c] = v
        return done[[*scope, "a", "b", "distance"]]

    kinds_of = ", ".join(f"`{c}` {live.schema[c].dataType.simpleString()}" for c in scope)
    return sent.groupBy(*scope, "_i", "_j").applyInPandas(tile, f"{kinds_of}, a bigint, b bigint, distance double")


def threshold_sweep(pairs: DataFrame, distance: str, taus: Sequence[float] = TAUS) -> DataFrame:
    """For each tau the number of pairs within it and of rows that have one: (tau, n_pairs, n_rows).

    One pass over the pairs, each of which is made once: a row has a pair within tau if its least distance is.
    """
    side = lambda c, first: F.struct(F.col(c).alias("row"), F.lit(first).alias("first"))
    ends = pairs.select(F.explode(F.array(side("a", True), side("b", False))).alias("e"), F.col(distance).alias("x")).select("e.*", "x")
    per = ends.groupBy("row").agg(F.min("x").alias("least"), *[F.count_if(F.col("first") & (F.col("x") <= float(t))).alias(f"n{k}") for k, t in enumerate(taus)])
    one = per.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(taus))], *[F.count_if(F.col("row").isNotNull() & (F.col("least") <= float(t))).alias(f"r{k}") for k, t in enumerate(taus)])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col(f"n{k}").alias("n_pairs"), F.col(f"r{k}").alias("n_rows")) for k, t in enumerate(taus)]))
    return one.select(each.alias("e")).select("e.*")


def discrimination(pairs: DataFrame, scope: list[str], group: list[str], sender: str, own: str, other: str) -> dict[str, DataFrame]:
    """How much better predictions fit their own outcome than a peer's: DataFrames `summary`, `per_sender`,
    `per_group`, `per_scope`.

    AUC counts ties as a half; the delta is averaged over pairs, per group over senders, per scope over groups;
    the sign counts are those of the group means. Pairs with a null score are left out.
    """
    scored = pairs.where(F.col(own).isNotNull() & F.col(other).isNotNull()).withColumn("delta", F.col(own) - F.col(other))
    keys = list(dict.fromkeys([*scope, *group]))
    senders = scored.groupBy(*keys, sender).agg(
        F.first(own).alias("self"), F.avg(other).alias("mean_other"), F.count(F.lit(1)).alias("n_pairs")
    ).withColumn("delta", F.col("self") - F.col("mean_other"))
    groups = senders.groupBy(*keys).agg(F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), F.count(F.lit(1)).alias("n_senders"))
    scopes = groups.groupBy(*scope).agg(F.avg("mean_delta").alias("mean_delta"), F.median("mean_delta").alias("median_delta"), F.count(F.lit(1)).alias("n_groups"))
    pair_level = scored.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(own).alias("mean_self"), F.avg(other).alias("mean_other"),
        F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"),
        F.try_divide(F.count_if(F.col("delta") > 0) + 0.5 * F.count_if(F.col("delta") == 0), F.count(F.lit(1))).alias("auc"),
        F.count_distinct(*scope).alias("n_scopes"),
    )
    return {"summary": pair_level, "per_sender": senders, "per_group": groups, "per_scope": scopes,
            "signs": groups.agg(F.count_if(F.col("mean_delta") > 0).alias("n_positive"), F.count_if(F.col("mean_delta") < 0).alias("n_negative"), F.count(F.lit(1)).alias("n_groups"))}


def pair_similarity(pairs: DataFrame, scope: list[str], group: list[str], value: str) -> DataFrame:
    """Mean similarity of pairs per group, and of groups per scope: (scope, n_groups, n_pairs, mean_similarity)."""
    keys = list(dict.fromkeys([*scope, *group]))
    groups = pairs.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_pairs"), F.avg("m").alias("mean_similarity")
    )


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, left, right, delta, side): two tables matched on unique keys; side is both, left or right."""
    a = left.select(*keys, F.col(value).alias("left"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right"), F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return both.select(*keys, "left", "right", (F.col("left") - F.col("right")).alias("delta"), side.alias("side"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """Numbers matched and not, and means over the pairs that have both values."""
    ok = F.col("delta").isNotNull()
    return pairs.agg(
        F.count_if(F.col("side") == "both").alias("n_both"), F.count_if(F.col("side") == "left").alias("n_left_only"),
        F.count_if(F.col("side") == "right").alias("n_right_only"), F.avg(F.when(ok, F.col("left"))).alias("mean_left"),
        F.avg(F.when(ok, F.col("right"))).alias("mean_right"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"),
    )


def shared_in_all(runs: DataFrame, run: str, key: str) -> DataFrame:
    """The keys that stand in every run."""
    total = runs.select(run).distinct().count()
    return runs.groupBy(key).agg(F.count_distinct(run).alias("n")).where(F.col("n") == total).select(key)


def donors(targets: DataFrame, candidates: DataFrame, same: list[str], differs: str, target_id: str, seed: int | None = None) -> DataFrame:
    """For each target one donor with equal `same` columns and another `differs`: the first in the order of
    `differs`, or of a seeded hash of both ids. Candidates must have been filtered for validity.

    The donor is the minimum over the group but for the target's own, so that two best ones per group suffice:
    no pairs are made.
    """
    order = F.col(differs).cast("string") if seed is None else F.md5(F.concat_ws(":", F.lit(seed), F.col(differs)))
    ranked = candidates.select(*same, F.struct(order.alias("o"), F.col(differs).alias("d")).alias("c")).distinct()
    first = ranked.groupBy(*same).agg(F.min("c").alias("c1"))
    second = ranked.join(first, same).where(F.col("c") != F.col("c1")).groupBy(*same).agg(F.min("c").alias("c2"))
    best = first.join(second, same, "left")
    chosen = F.when(F.col("c1.d") != F.col(differs), F.col("c1.d")).otherwise(F.col("c2.d"))
    return targets.join(best, same, "left").select(*same, target_id, F.col(differs).alias("own"), chosen.alias("donor"))
