"""Reports composed of the other operators: slice summaries, head scores and ablations, condition studies,
sensitivity of draws, the run report of scored peers, the comparison of two runs, and the selection of a cohort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.code import pass_signature
from tapeloom.operators import contracts as K
from tapeloom.operators import inference as N
from tapeloom.operators import peers as P
from tapeloom.operators import selection as L
from tapeloom.operators.views import log_loss
from tapeloom.shared import beside, written


def union_disjoint(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all parts; a key that stands in two parts is an error."""
    named = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, named)
    K.require_none(every.groupBy(key).agg(F.count_distinct("_part").alias("n")).where("n > 1"), f"{key} in several parts")
    return every.drop("_part")


def slice_summary(attempts: DataFrame, keys: list[str], actor: str, index: str, vector: str) -> DataFrame:
    """Per slice: attempts by depth (0, 1, 2_plus), actors, share of actors who pass all tests in the end and of those
    who fail before, and mean passes by depth. `attempts` has one row per attempt with its result vector."""
    n_pass = F.size(F.filter(vector, lambda x: x))
    solved = F.coalesce(n_pass == F.size(vector), F.lit(False))
    rows = attempts.withColumn("_solved", solved).withColumn("_pass", n_pass)
    per = rows.groupBy(*keys, actor).agg(F.max("_solved").alias("done"), F.min_by("_solved", index).alias("at_once"))
    actors = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_actors"), F.avg(F.col("done").cast("double")).alias("success_rate"),
        F.avg((F.col("done") & ~F.col("at_once")).cast("double")).alias("failure_before_success_rate"),
    )
    depth = lambda c: F.when(c, F.col("_pass"))
    i = F.col(index)
    return rows.groupBy(*keys).agg(
        F.count_if(i == 0).alias("n_depth_0"), F.count_if(i == 1).alias("n_depth_1"), F.count_if(i >= 2).alias("n_depth_2_plus"),
        F.avg(depth(i == 0)).alias("passes_0"), F.avg(depth(i == 1)).alias("passes_1"), F.avg(depth(i >= 2)).alias("passes_2_plus"),
    ).join(actors, keys)


def top_failed_tests(attempts: DataFrame, keys: list[str], vector: str, k: int = 5) -> DataFrame:
    """(keys, test, n, rate): the k tests that fail most often, ties by number."""
    total = attempts.where(F.col(vector).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    bad = attempts.select(*keys, F.posexplode(vector).alias("test", "ok")).where(~F.col("ok")).groupBy(*keys, "test").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "test")
    return bad.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).join(total, keys).select(*keys, "test", "n", (F.col("n") / F.col("total")).alias("rate"))


def head_scores(distributions: DataFrame, truths: DataFrame, keys: list[str], top_k: int = 2) -> DataFrame:
    """(head, n, top1_rate, topk_rate, mean_truth_mass, mean_brier, mean_log_loss) of distributions (keys, head, label, p)
    against truths (keys, head, truth); equal probabilities rank by label."""
    w = Window.partitionBy(*keys, "head").orderBy(F.desc("p"), "label")
    ranked = distributions.withColumn("rank", F.row_number().over(w)).join(truths, [*keys, "head"])
    hit = F.col("label") == F.col("truth")
    per = ranked.groupBy(*keys, "head").agg(
        F.max(F.when(hit, F.col("p"))).alias("mass"), F.max(F.when(hit, F.col("rank"))).alias("at"),
        F.sum(F.pow(F.col("p") - hit.cast("int"), F.lit(2))).alias("brier"),
    )
    mass = F.coalesce("mass", F.lit(0.0))
    return per.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("at") == 1, F.lit(False)).cast("double")).alias("top1_rate"),
        F.avg(F.coalesce(F.col("at") <= top_k, F.lit(False)).cast("double")).alias("topk_rate"), F.avg(mass).alias("mean_truth_mass"),
        F.avg(F.col("brier") + F.when(F.col("at").isNull(), 1.0).otherwise(0.0)).alias("mean_brier"), F.avg(log_loss(mass)).alias("mean_log_loss"),
    )


def head_ablation(matches: DataFrame, keys: list[str], predictor: str, heads: list[str]) -> DataFrame:
    """(predictor, heads, match_rate, place): for every subset of the heads how often all of them match; `matches` has
    keys, predictor and a boolean column for each head. place ranks the predictors within a subset."""
    subsets = [s for n in range(1, len(heads) + 1) for s in combinations(heads, n)]
    both = lambda s: reduce(lambda a, b: a & b, [F.coalesce(F.col(h), F.lit(False)) for h in s])
    long = matches.select(predictor, F.explode(F.array(*[F.struct(F.lit("+".join(s)).alias("heads"), both(s).alias("m")) for s in subsets])).alias("x"))
    rate = long.groupBy(predictor, "x.heads").agg(F.avg(F.col("x.m").cast("double")).alias("match_rate"))
    return rate.withColumn("place", F.rank().over(Window.partitionBy("heads").orderBy(F.desc("match_rate"))))


def condition_study(rows: DataFrame, key: str, metrics: list[str], left: str, right: str, samples: int = 2_000, seed: int = 42) -> DataFrame:
    """(metric, n, mean_left, mean_right, delta, low, high, p): paired rows (condition, key, metric columns) of two
    conditions, with bootstrap limits and a signed-rank test; pairs with a null don't count."""
    a, b = rows.where(F.col("condition") == left), rows.where(F.col("condition") == right)
    parts = []
    for k, m in enumerate(metrics):
        pairs = P.paired(a, b, [key], m).where("delta IS NOT NULL")
        means = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("left").alias("mean_left"), F.avg("right").alias("mean_right"))
        test = N.wilcoxon(pairs.withColumn("_g", F.lit(0)), ["_g"], "delta").agg(F.max("p").alias("p"))
        limits = N.paired_bootstrap(pairs, "delta", [key], samples, seed + 1000 * k)
        parts.append(beside(means, limits, test).withColumn("metric", F.lit(m)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("metric", "n", "mean_left", "mean_right", F.col("mean").alias("delta"), "low", "high", F.coalesce("p", F.lit(1.0)).alias("p"))


def run_grid(spark: SparkSession, kinds: Sequence[str], seeds: int) -> DataFrame:
    """(name, kind, seed) of the runs of a sensitivity study: a full one, a deterministic one, and seeds 1, 2, ... of each kind."""
    rows = [("full", "full", None), ("fixed", "deterministic", None)] + [(f"{k}_{s}", k, s) for k in kinds for s in range(1, seeds + 1)]
    return spark.createDataFrame(rows, "name string, kind string, seed int")


def draw_sensitivity(study: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, n_draws, n_significant, n_positive, n_negative, unstable) of studies (metric, draw, delta, p) of several
    draws; unstable if significant draws disagree in sign or not all draws are alike."""
    sig = F.col("p") < alpha
    out = study.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_draws"), F.count_if(sig).alias("n_significant"),
        F.count_if(sig & (F.col("delta") > 0)).alias("n_positive"), F.count_if(sig & (F.col("delta") < 0)).alias("n_negative"),
    )
    mixed = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    return out.withColumn("unstable", mixed | ((F.col("n_significant") > 0) & (F.col("n_significant") < F.col("n_draws"))))


def run_report(
    rows: DataFrame, scope: list[str], actor: str, row_id: str, score: Column, taus: Sequence[float] = P.TAUS, own: str = "own", within: list[str] | None = None
) -> DataFrame:
    """(tau, n_pairs, n_scopes, mean_self, mean_other, mean_delta, auc) of directed peers with equal result vectors: all
    of them (tau null), and those whose programs are within each tau.

    `rows` has vector, code and `own`, the score of a row's prediction on its own outcome; `score` is that of A's on B's,
    an expression on the other columns with suffix _a and _b. Each pair is made and scored once, for all taus. Two
    different programs with one vector are measured once for all scopes alike in `within`, some columns of `scope` (else
    all of them), whatever rows hold them and in whichever direction; the pairs hold numbers of programs, not programs.
    """
    within = scope if within is None else within
    keyed = rows.withColumn("sig", pass_signature(F.col("vector"))).where("sig IS NOT NULL")
    take = [c for c in rows.columns if c not in (*scope, actor, row_id, "code", "vector")]
    held = F.struct(*dict.fromkeys([*[c for c in scope if c not in within], actor, row_id, *take]))
    per = keyed.groupBy(*within, "sig", "code").agg(F.collect_list(held).alias("_rows")).withColumn("_text", F.monotonically_increasing_id())
    per = written(per, "texts")  # numbers are given once
    texts = per.select(*within, "sig", "_text", "code")
    far = P.text_distances(texts.withColumn("_own", F.col("_text")), [*within, "sig"], "_own", "_text", "code", max(taus, default=0.0))
    text = F.when(F.col("code").isNotNull(), F.col("_text")).alias("_text")
    light = per.select(*within, "sig", text, F.explode("_rows").alias("_r")).select(*within, "sig", "_text", "_r.*")
    pairs = P.peer_pairs(light, scope, "sig", actor, row_id, [*take, "_text"]).withColumn("other", score)
    live = pairs.where(F.col(f"{own}_a").isNotNull() & F.col("other").isNotNull()).withColumn("delta", F.col(f"{own}_a") - F.col("other"))
    x, y = F.col("_text_a"), F.col("_text_b")
    live = live.select(*scope, F.col(f"{own}_a"), "other", "delta", (x == y).alias("same"), F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)).alias("a"), F.greatest(x, y).alias("b"))
    measured = live.join(far.select("a", "b", "distance"), ["a", "b"], "left").withColumn("distance", F.when(F.col("same"), 0.0).otherwise(F.col("distance")))
    grid = F.array(F.lit(None).cast("double"), *[F.lit(float(t)) for t in taus])
    each = measured.withColumn("tau", F.explode(F.filter(grid, lambda t: t.isNull() | (F.col("distance") <= t))))
    return each.groupBy("tau").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(*scope).alias("n_scopes"), F.avg(f"{own}_a").alias("mean_self"),
        F.avg("other").alias("mean_other"), F.avg("delta").alias("mean_delta"),
        ((F.count_if(F.col("delta") > 0) + 0.5 * F.count_if(F.col("delta") == 0)) / F.count(F.lit(1))).alias("auc"),
    )


def compare_runs(left: DataFrame, right: DataFrame, cluster: list[str], pair: list[str], value: str, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Contrast of two runs with the same pairs: bootstrap over clusters and sign-flip test in one row. Different sets of
    pairs or repeated pairs are an error."""
    K.require_none(K.duplicate_keys(left, pair), "repeated pair")
    K.require_none(K.key_differences(left, right, pair), "pair of one run only")
    clusters = N.contrast_clusters(left, right, cluster, value)
    boot = N.cluster_bootstrap(clusters, cluster, samples, seed)
    flip = N.sign_flip(N.contributions(clusters, cluster), cluster, samples, seed)
    return beside(boot, flip)


def select_cohort(
    scopes: DataFrame, candidates: DataFrame, scope: list[str], actor: str, least_attempts: int, target: int, seed: int
) -> dict[str, DataFrame]:
    """The stages of a selection: scopes that aren't canonical, their tertiles, candidates deep enough, groups of one
    state, and a stratified sample of scopes. DataFrames tertiles, kept, matched, dropped and sample.

    `candidates` has the scope, actor, total_attempt_count and vector; `scopes` mean_pairwise_dist and canonical_80.
    """
    cut = L.tertiles(scopes.where(~F.col("canonical_80")), "mean_pairwise_dist")
    kept = candidates.join(cut.select(*scope, "tertile"), scope).where(F.col("total_attempt_count") >= least_attempts)
    kept = kept.withColumn("signature", pass_signature(F.col("vector")))
    matched = L.matched_groups(kept, scope, "signature", actor)
    live = matched.select(*scope, "tertile").distinct().withColumn("_k", F.concat_ws(":", *scope))
    sample = L.stratified_sample(live, "tertile", "_k", target, seed, ["T1", "T2", "T3"]).drop("_k")
    return {"tertiles": cut, "kept": kept, "matched": matched, "dropped": L.dropped_scopes(kept, scope, "signature", actor), "sample": sample}
