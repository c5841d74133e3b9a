"""Hypotheses with probabilities: views, ranks, distributions, proper scores and the metric templates on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_WEIGHTS = (0.5, 0.3, 0.2)


def views(scores: Column, probabilities: Column, weights: Sequence[float] = RANK_WEIGHTS) -> Column:
    """Struct of the five views of scores of hypotheses: oracle, expected, rank_weighted, top_1, best_rank.

    Hypotheses rank by probability, the first of equal ones first; best_rank is the least rank that attains the
    oracle. Both arrays have one element for each hypothesis.
    """
    rows = F.transform(
        F.arrays_zip(scores.alias("s"), probabilities.alias("p")), lambda x, i: F.struct((-x["p"]).alias("q"), i.alias("i"), x["s"].alias("s"))
    )
    ranked = F.array_sort(rows)
    best = F.array_max(scores)
    w = F.array(*map(F.lit, weights))
    total = F.aggregate(
        F.transform(ranked, lambda x, i: x["s"] * F.coalesce(F.get(w, i), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
    )
    return F.struct(
        best.alias("oracle"),
        F.aggregate(F.zip_with(scores, probabilities, lambda s, p: s * p), F.lit(0.0), lambda a, x: a + x).alias("expected"),
        total.alias("rank_weighted"),
        F.get(ranked, 0)["s"].alias("top_1"),
        F.array_min(F.transform(F.filter(F.transform(ranked, lambda x, i: F.struct(x["s"].alias("s"), (i + 1).alias("r"))), lambda x: x["s"] == best), lambda x: x["r"])).alias("best_rank"),
    )


def distribution(hypotheses: DataFrame, keys: list[str], label: Column, p: str = "p") -> DataFrame:
    """(keys, label, p): probability by label; a null label is "None"."""
    return hypotheses.groupBy(*keys, F.coalesce(label.cast("string"), F.lit("None")).alias("label")).agg(F.sum(p).alias("p"))


def normalised(weights: DataFrame, keys: list[str]) -> DataFrame:
    """`p` divided by its sum over the keys."""
    total = weights.groupBy(*keys).agg(F.sum("p").alias("_t"))
    return weights.join(total, keys).withColumn("p", F.when(F.col("_t") > 0, F.col("p") / F.col("_t"))).drop("_t")


def categorical_metric(distributions: DataFrame, truths: DataFrame, keys: list[str], truth: str = "truth") -> DataFrame:
    """Per example: truth mass, rank of the truth (order -p, label), top-1 label (ties: largest), hits, reciprocal
    rank, Brier score over all labels and the truth's, and log-loss clipped at 1e-12.

    `distributions` is (keys, label, p). An example without hypotheses has no row. A null truth is "None".
    """
    t = truths.select(*keys, F.coalesce(F.col(truth).cast("string"), F.lit("None")).alias("_t"))
    per = distributions.groupBy(*keys).agg(F.collect_list(F.struct((-F.col("p")).alias("q"), "label", "p")).alias("d")).join(t, keys)
    mine = F.filter("d", lambda x: x["label"] == F.col("_t"))
    mass = F.coalesce(F.get(mine, 0)["p"], F.lit(0.0))
    order = F.transform(F.array_sort("d"), lambda x: x["label"])
    rank = F.when(F.size(mine) > 0, F.array_position(order, F.col("_t")).cast("bigint"))
    top = F.array_max(F.transform("d", lambda x: F.struct(x["p"].alias("p"), x["label"].alias("label"))))["label"]
    brier = F.aggregate("d", F.lit(0.0), lambda a, x: a + F.pow(x["p"] - F.when(x["label"] == F.col("_t"), 1.0).otherwise(0.0), F.lit(2.0)))
    brier = brier + F.when(F.size(mine) > 0, 0.0).otherwise(1.0)
    return per.select(
        *keys, F.col("_t").alias("truth"), mass.alias("truth_mass"), rank.alias("truth_rank"), top.alias("top_label"),
        (top == F.col("_t")).alias("top1_match"), F.coalesce(rank <= 2, F.lit(False)).alias("top2_hit"),
        F.coalesce(rank <= 3, F.lit(False)).alias("top3_hit"), F.coalesce(1.0 / rank, F.lit(0.0)).alias("mrr"),
        brier.alias("brier"), log_loss(mass).alias("log_loss"),
    )


def log_loss(p: Column, epsilon: float = 1e-12) -> Column:
    """-ln of a probability clipped to [epsilon, 1]."""
    return -F.log(F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0)))


def binary_metric(examples: DataFrame, keys: list[str], p_true: Column, observed: Column) -> DataFrame:
    """Per example: predicted probability of true, match of its side, mass of the truth, Brier and log-loss."""
    y = observed.cast("double")
    mass = F.when(observed, p_true).otherwise(1 - p_true)
    return examples.select(
        *keys, p_true.alias("p_true"), observed.alias("observed"), ((p_true >= 0.5) == observed).alias("match"),
        mass.alias("truth_mass"), F.pow(p_true - y, F.lit(2.0)).alias("brier"), log_loss(mass).alias("log_loss"),
    )


def tolerance_metric(examples: DataFrame, keys: list[str], predicted: Column, observed: Column, tolerances: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Per example whether the predicted line is within each tolerance; null without truth, false without prediction."""
    hit = lambda t: F.when(observed.isNotNull(), F.coalesce(F.abs(predicted - observed) <= t, F.lit(False)))
    return examples.select(*keys, *[hit(t).alias(f"within_{t}") for t in tolerances])


def sequence_metric(hypotheses: DataFrame, keys: list[str], score: Column, p: str = "p", label: str = "label") -> DataFrame:
    """Per example the score of the top hypothesis (ties of p: largest label) and the expected score."""
    rows = hypotheses.withColumn("_s", score)
    return rows.groupBy(*keys).agg(
        F.max_by("_s", F.struct(p, label)).alias("top1_score"), F.sum(F.col(p) * F.col("_s")).alias("expected_score")
    )


class MetricRegistry:
    """Named metrics: a function of examples that gives rows, and columns whose means summarise them."""

    def __init__(self):
        self._metrics: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {}

    def register(self, name: str, rows: Callable[[DataFrame], DataFrame], means: Sequence[str]) -> None:
        """Add a metric; a name can be used once."""
        if name in self._metrics:
            raise ValueError(f"metric {name} is registered already")
        self._metrics[name] = (rows, tuple(means))

    def names(self) -> list[str]:
        return list(self._metrics)

    def evaluate(self, name: str, examples: DataFrame) -> DataFrame:
        """Rows of one metric."""
        return self._metrics[name][0](examples)

    def summary(self, examples: DataFrame) -> DataFrame:
        """(metric, field, mean, n) of every metric; nulls don't count, a field of nulls only has a null mean."""
        parts = []
        for name, (rows, means) in self._metrics.items():
            done = rows(examples)
            for c in means:
                x = F.col(c).cast("double")
                parts.append(done.agg(F.avg(x).alias("mean"), F.count(x).alias("n")).select(F.lit(name).alias("metric"), F.lit(c).alias("field"), "mean", "n"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def kl_divergence(pairs: DataFrame, keys: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """(keys, kl): base 2; labels with p of 0 don't count; null where q is 0 and p isn't."""
    bad = F.max(((F.col(p) > 0) & (F.coalesce(F.col(q), F.lit(0.0)) <= 0)).cast("int"))
    term = F.when((F.col(p) > 0) & (F.col(q) > 0), F.col(p) * F.log2(F.col(p) / F.col(q)))
    return pairs.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("_kl"), bad.alias("_bad")).select(
        *keys, F.when(F.col("_bad") == 0, F.col("_kl")).alias("kl")
    )


def distribution_distance(pairs: DataFrame, keys: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """(keys, l1, js): sum of absolute differences and Jensen-Shannon divergence in bits; a missing label has 0."""
    a, b = F.coalesce(F.col(p), F.lit(0.0)), F.coalesce(F.col(q), F.lit(0.0))
    m = (a + b) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return pairs.groupBy(*keys).agg(F.sum(F.abs(a - b)).alias("l1"), (F.sum(part(a)) / 2 + F.sum(part(b)) / 2).alias("js"))


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, entropy, perplexity) in bits of counts per label; labels without counts don't matter."""
    total = F.sum(n)
    # -sum p log2 p = log2 N - sum n log2 n / N
    h = F.log2(total) - F.sum(F.when(F.col(n) > 0, F.col(n) * F.log2(F.col(n)))) / total
    return counts.groupBy(*keys).agg(h.alias("entropy")).withColumn("perplexity", F.pow(F.lit(2.0), F.col("entropy")))


def field_means(rows: DataFrame, metric: str, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, field, mean, n) of numeric or boolean columns in one pass; nulls don't count, a field of nulls only has a null mean."""
    aggs = [F.struct(F.lit(f).alias("field"), F.avg(F.col(f).cast("double")).alias("mean"), F.count(F.col(f)).alias("n")) for f in fields]
    one = rows.groupBy(*keys).agg(F.array(*aggs).alias("_x"))
    return one.select(*keys, F.lit(metric).alias("metric"), F.explode("_x").alias("_x")).select(*keys, "metric", "_x.*")
