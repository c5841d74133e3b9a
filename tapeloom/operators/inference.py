"""Inference: cluster bootstrap, sign flips, sign test, Wilcoxon, Spearman, quantiles.

Resampling works on one (sum, count) row per cluster, never on pairs or rows. Draws come from a
hash of (seed, draw, place), so that they are the same on any cluster and in other engines, or
from a list that the caller gives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.shared import beside

EXACT_FLIPS = 20


def quantile(c: Column | str, q: float, kind: str = "linear") -> Column:
    """Aggregate: a quantile by linear interpolation, nearest rank, or the floor or ceiling of an index.

    linear: at q (n - 1), between neighbours. nearest: element ceil(q n). floor_index: element int(q (n - 1)) from 0.
    ceil_index: element ceil(q n) - 1 from 0. All are null for no values.
    """
    if kind == "linear":
        return F.percentile(c, q)
    x = F.array_sort(F.collect_list(c))
    n = F.size(x)
    at = {
        "nearest": F.greatest(F.ceil(q * n).cast("int"), F.lit(1)) - 1,
        "floor_index": F.floor(q * (n - 1)).cast("int"),
        "ceil_index": F.greatest(F.ceil(q * n).cast("int"), F.lit(1)) - 1,
    }[kind]
    return F.get(x, at)


def draw(seed: int, b: Column, i: Column, n: Column) -> Column:
    """A number in [0, n) from the first 8 digits of the md5 of `seed:b:i`."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b, i)), 1, 8), 16, 10).cast("bigint") % F.greatest(n, F.lit(1))


def cluster_sums(pairs: DataFrame, cluster: list[str], value: str) -> DataFrame:
    """(cluster, s, n): sum and number of values of each cluster; nulls and NaN don't count."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return pairs.where(ok).groupBy(*cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))


def contrast_clusters(left: DataFrame, right: DataFrame, cluster: list[str], value: str) -> DataFrame:
    """(cluster, sl, nl, sr, nr) of the clusters that both sides have."""
    a = cluster_sums(left, cluster, value).select(*cluster, F.col("s").alias("sl"), F.col("n").alias("nl"))
    b = cluster_sums(right, cluster, value).select(*cluster, F.col("s").alias("sr"), F.col("n").alias("nr"))
    return a.join(b, cluster)


def bootstrap_means(clusters: DataFrame, order: list[str], samples: int, seed: int) -> DataFrame:
    """(b, theta): of each resample of whole clusters, sum(sl) / sum(nl) - sum(sr) / sum(nr).

    `clusters` is one row per cluster, numbered in `order`; each resample draws as many as there are.
    """
    spark = clusters.sparkSession
    numbered = clusters.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).select("i", "sl", "nl", "sr", "nr")
    k = numbered.count()
    # counted out by the executors: a sequence of literals would be made on the driver and stand in the plan
    rows = spark.range(samples * max(k, 1)).select(F.expr(f"id div {max(k, 1)}").alias("b"), F.expr(f"id % {max(k, 1)}").alias("slot"))
    picked = rows.select("b", draw(seed, F.col("b"), F.col("slot"), F.lit(k)).alias("i")).join(numbered, "i")
    return picked.groupBy("b").agg((F.sum("sl") / F.sum("nl") - F.sum("sr") / F.sum("nr")).alias("theta"))


def cluster_bootstrap(clusters: DataFrame, order: list[str], samples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: observed difference of pooled means, 95 % percentile interval, share of resamples above 0."""
    seen = clusters.agg((F.sum("sl") / F.sum("nl") - F.sum("sr") / F.sum("nr")).alias("observed"), F.count(F.lit(1)).alias("n_clusters"))
    boot = bootstrap_means(clusters, order, samples, seed).agg(
        F.percentile("theta", 0.025).alias("low"), F.percentile("theta", 0.975).alias("high"),
        F.avg((F.col("theta") > 0).cast("double")).alias("share_positive"),
    )
    return beside(seen, boot)


def over_collapse_clusters(twin_l: DataFrame, real_l: DataFrame, twin_r: DataFrame, real_r: DataFrame, cluster: list[str], value: str) -> DataFrame:
    """Clusters of the difference of differences (twin - reality, left - right) with equal numbers of pairs within each condition."""
    a = contrast_clusters(twin_l, real_l, cluster, value).select(*cluster, (F.col("sl") - F.col("sr")).alias("sl"), "nl")
    b = contrast_clusters(twin_r, real_r, cluster, value).select(*cluster, (F.col("sl") - F.col("sr")).alias("sr"), F.col("nl").alias("nr"))
    return a.join(b, cluster)


def contributions(clusters: DataFrame, cluster: list[str]) -> DataFrame:
    """(cluster, c): (sl - sr) / N; they add up to the difference of the pooled means of equal pair sets."""
    total = clusters.agg(F.sum("nl").alias("_n")).first()[0] or 0  # one number
    return clusters.select(*cluster, ((F.col("sl") - F.col("sr")) / F.lit(float(total or 1))).alias("c"))


def sign_flip(contribution: DataFrame, order: list[str], samples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row (p, n_assignments, exact): share of sign assignments whose |sum| is at least the observed one.

    All 2^n assignments up to 20 clusters; beyond, `samples` random ones with (hits + 1) / (samples + 1).
    """
    spark = contribution.sparkSession
    numbered = contribution.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).select("i", "c")
    n, observed = numbered.agg(F.count(F.lit(1)), F.sum("c")).first()  # two numbers
    exact = n <= EXACT_FLIPS
    total = 1 << n if exact else samples
    rows = spark.range(total).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("i"))
    bit = F.expr("shiftright(b, CAST(i AS INT)) & 1") if exact else draw(seed, F.col("b"), F.col("i"), F.lit(2))
    flipped = rows.withColumn("g", F.when(bit == 1, -1.0).otherwise(1.0)).join(numbered, "i").groupBy("b").agg(F.sum(F.col("g") * F.col("c")).alias("x"))
    hits = F.count_if(F.abs("x") + 1e-12 >= abs(observed or 0.0))
    p = hits / total if exact else (hits + 1) / (total + 1)
    return flipped.agg(p.alias("p"), F.lit(total).cast("bigint").alias("n_assignments"), F.lit(bool(exact)).alias("exact"))


def paired_bootstrap(pairs: DataFrame, delta: str, order: list[str], samples: int = 2_000, seed: int = 42, unit: list[str] | None = None) -> DataFrame:
    """One row (mean, low, high): rows, or clusters by `unit`, resampled; limits at index int(q (N - 1))."""
    keys = unit or order
    sums = pairs.where(F.col(delta).isNotNull()).groupBy(*keys).agg(F.sum(delta).alias("sl"), F.count(F.lit(1)).alias("nl"))
    sums = sums.withColumn("sr", F.lit(0.0)).withColumn("nr", F.lit(1))
    boot = bootstrap_means(sums, keys, samples, seed)
    mean = sums.agg((F.sum("sl") / F.sum("nl")).alias("mean"))
    return beside(mean, boot.agg(quantile("theta", 0.025, "floor_index").alias("low"), quantile("theta", 0.975, "floor_index").alias("high")))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_two_sided(positives: int, n: int) -> float:
    """Sum of the fair binomial's masses that are at most that of `positives`; NaN for no trials."""
    if not n:
        return math.nan
    at = _log_choose(n, positives)
    return min(1.0, sum(math.exp(_log_choose(n, k) - n * math.log(2)) for k in range(n + 1) if _log_choose(n, k) <= at + 1e-12))


@F.pandas_udf(T.DoubleType())
def sign_test_p(positives: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided sign test from counts of positive and of non-zero differences; NaN for none."""
    return pd.Series([binomial_two_sided(int(p), int(m)) for p, m in zip(positives, n)])


def sign_test(rows: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """(keys, n_positive, n_nonzero, p): zeros and nulls don't count; NaN where nothing is left."""
    counted = rows.groupBy(*keys).agg(F.count_if(F.col(delta) > 0).alias("n_positive"), F.count_if(F.col(delta) != 0).alias("n_nonzero"))
    return counted.withColumn("p", F.coalesce(sign_test_p("n_positive", "n_nonzero"), F.lit(math.nan)))  # Arrow makes NaN null


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str = "rank", buckets: int = 200) -> DataFrame:
    """Ranks from 1 within the keys, equal values sharing the mean of theirs; rows with a null key or value are left out.

    Values are counted, the counts cut into about `buckets` ranges of values, and summed up inside each range and over
    the ranges, so that no key is sorted in one task however many values it has.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts if not math.isnan(float(c))})
    edge = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    laid = counts.withColumn("_b", F.size(F.filter(edge, lambda c: c < F.col(value).cast("double"))))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = laid.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_o"))
    ranks = laid.withColumn("_l", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(offset, [*keys, "_b"])
    ranks = ranks.select(*keys, value, (F.col("_o") + F.col("_l") + (F.col("_c") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def wilcoxon_p(w_plus: float, n: int, ties: float, variant: str = "auto", has_ties: bool = True) -> float:
    """Two-sided p of a signed-rank sum: exact up to 50 differences without ties, else the normal approximation with
    tie correction (variant "auto"), or always the approximation with continuity correction ("corrected").
    1 for no difference."""
    if n == 0:
        return 1.0
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if variant == "auto" and n <= 50 and not has_ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        low = int(min(w_plus, n * (n + 1) / 2 - w_plus))
        return float(min(1.0, 2 * ways[: low + 1].sum() / 2.0**n))
    if var <= 0:
        return 1.0
    off = w_plus - mean
    if variant == "corrected" and off:
        off -= math.copysign(0.5, off)
    return math.erfc(abs(off) / math.sqrt(var) / math.sqrt(2))


def wilcoxon(rows: DataFrame, keys: list[str], delta: str, variant: str = "auto") -> DataFrame:
    """(keys, n, w_plus, p): signed-rank test of differences; zeros and nulls are dropped, ties share ranks."""
    live = rows.where(F.col(delta).isNotNull() & (F.col(delta) != 0)).withColumn("_a", F.abs(delta))
    ranked = average_ranks(live, keys, "_a", "_r").groupBy(*keys, "_a").agg(
        F.count(F.lit(1)).alias("_t"), F.sum(F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0)).alias("_w")
    )
    sums = ranked.groupBy(*keys).agg(
        F.sum("_t").alias("n"), F.sum("_w").alias("w_plus"), F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties")
    )

    @F.pandas_udf(T.DoubleType())
    def p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(a, int(b), c, variant, c > 0) for a, b, c in zip(w, n, ties)])

    return sums.withColumn("p", p("w_plus", "n", "_ties")).drop("_ties")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho, p): correlation of average ranks and its t-test; null for fewer than 2 pairs or no spread."""
    live = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(live, keys, x, "_x"), keys, y, "_y")
    rho = F.corr("_x", "_y")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(~F.isnan(rho), rho).alias("rho"))

    @F.pandas_udf(T.DoubleType())
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        def one(a: float, m: int) -> float | None:
            if a is None or math.isnan(a) or m < 3:
                return None
            return 0.0 if abs(a) >= 1 else student_t_two_sided(a * math.sqrt((m - 2) / (1 - a * a)), m - 2)

        return pd.Series([one(a, int(m)) for a, m in zip(r, n)], dtype="float64")

    return out.withColumn("p", p("rho", "n"))
