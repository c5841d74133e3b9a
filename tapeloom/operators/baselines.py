"""Baselines: majority, leave-one-out, rotated and uniform distributions, lift over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, scope: list[str], value: str, order: str) -> DataFrame:
    """(scope, value, n, share): the commonest value of each scope; of equally common ones the first seen in `order`."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*scope, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("m"), "first"))
    return counts.groupBy(*scope).agg(best.alias("b"), F.sum("n").alias("total")).select(
        *scope, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"), (F.col("b.n") / F.col("total")).alias("share")
    )


def lift(rows: DataFrame, baseline: DataFrame, fallback: DataFrame, scope: list[str], key: str, value: str) -> DataFrame:
    """`value` of each row less that of its baseline row, or of the scope's where the row has none."""
    b = baseline.select(*scope, key, F.col(value).alias("_b"))
    f = fallback.select(*scope, F.col(value).alias("_f"))
    joined = rows.join(b, [*scope, key], "left").join(f, scope, "left")
    base = F.coalesce("_b", "_f")
    return joined.select(*scope, key, value, base.alias("baseline"), (F.col(value) - base).alias("lift"))


def leave_one_out(counts: DataFrame, scope: str, heads: list[str], label: str, n: str = "n") -> DataFrame:
    """(scope, heads, label, p): the distribution of all other scopes together; null where they have nothing.

    Every label of a head gets a row for every scope of that head.
    """
    total = counts.groupBy(*heads, label).agg(F.sum(n).alias("_t"))
    scopes = counts.select(scope, *heads).distinct()
    own = counts.groupBy(scope, *heads, label).agg(F.sum(n).alias("_n"))
    every = scopes.join(total, heads).join(own, [scope, *heads, label], "left")
    left = F.col("_t") - F.coalesce("_n", F.lit(0))
    rest = every.withColumn("_r", left)
    whole = rest.groupBy(scope, *heads).agg(F.sum("_r").alias("_s"))
    return rest.join(whole, [scope, *heads]).select(scope, *heads, label, F.when(F.col("_s") > 0, F.col("_r") / F.col("_s")).alias("p"))


def rotated(distributions: DataFrame, scope: str, heads: list[str], label: str, p: str = "p") -> DataFrame:
    """Each scope with the distribution of the next scope in order, the last with that of the first."""
    scopes = distributions.select(scope).distinct()
    w = Window.orderBy(scope)  # one row per scope
    follow = scopes.select(scope, F.lead(scope).over(w).alias("_n"), F.min(scope).over(w).alias("_f"))
    follow = follow.select(F.col(scope).alias("_to"), F.coalesce("_n", "_f").alias(scope))
    return distributions.join(follow, scope).select(F.col("_to").alias(scope), *heads, label, p)


def uniform(distributions: DataFrame, keys: list[str], label: str) -> DataFrame:
    """1 / k for each of the k labels."""
    k = distributions.groupBy(*keys).agg(F.count_distinct(label).alias("_k"))
    return distributions.select(*keys, label).distinct().join(k, keys).select(*keys, label, (1.0 / F.col("_k")).alias("p"))


def fixed_labels(counts: DataFrame, keys: list[str], label: str, labels: list[str], n: str = "n") -> DataFrame:
    """Counts over a fixed set of labels, zeros included."""
    every = counts.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, labels))).alias(label))
    return every.join(counts, [*keys, label], "left").na.fill(0, [n])


def chance_levels(rows: DataFrame, label: str) -> DataFrame:
    """One row: accuracy of always guessing the commonest label, and of guessing by the labels' shares."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("random"))
