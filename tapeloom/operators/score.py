"""Scoring of predictions: each (row, hypothesis) or pair is scored once, into one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.diff import score_names, score_udf
from tapeloom.operators.views import views


def scored_hypotheses(rows: DataFrame, keys: list[str], version: str = "v2", radius: int = 1) -> DataFrame:
    """(keys, hyp, p, family, metric, value) of rows with before_code, observed_code, observed_steps and
    hyps (array of p, code, steps); hyp counts from 0. A gain without a change to gain from is null."""
    one = rows.select(*keys, "before_code", "observed_code", "observed_steps", F.posexplode("hyps").alias("hyp", "h"))
    score = score_udf(version, radius)
    done = one.withColumn("s", score("before_code", F.col("h.code"), "observed_code", F.col("h.steps"), "observed_steps"))
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(m).alias("metric"), F.col(f"s.{m}").alias("value")) for f, m in score_names(version)]))
    return done.select(*keys, "hyp", F.col("h.p").alias("p"), long.alias("x")).select(*keys, "hyp", "p", "x.*")


def view_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, metric, oracle, expected, rank_weighted, top_1, best_rank) of scored hypotheses."""
    rows = F.array_sort(F.collect_list(F.struct("hyp", "p", "value")))
    per = scores.groupBy(*keys, "family", "metric").agg(rows.alias("r"))
    view = views(F.transform("r", lambda x: x["value"]), F.transform("r", lambda x: x["p"]))
    return per.select(*keys, "family", "metric", view.alias("v")).select(*keys, "family", "metric", "v.*")


def truth_hypotheses(code: Column, steps: Column) -> Column:
    """The truth as three hypotheses, the first with almost all probability."""
    p = (0.999998, 1e-6, 1e-6)
    return F.array(*[F.struct(F.lit(x).alias("p"), code.alias("code"), steps.alias("steps")) for x in p])


def same_hypotheses(code: Column, steps: Column) -> Column:
    """A baseline as three equal hypotheses."""
    return F.array_repeat(F.struct(F.lit(1 / 3).alias("p"), code.alias("code"), steps.alias("steps")), 3)


def pair_scores(pairs: DataFrame, keys: list[str], version: str = "v2", radius: int = 1) -> DataFrame:
    """(keys, family, metric, value): prediction of A on the truth of B, with B's program as the one before.

    `pairs` has before_b, predicted_a, observed_b, steps_a and steps_b.
    """
    score = score_udf(version, radius)
    done = pairs.withColumn("s", score("before_b", "predicted_a", "observed_b", "steps_a", "steps_b"))
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(m).alias("metric"), F.col(f"s.{m}").alias("value")) for f, m in score_names(version)]))
    return done.select(*keys, long.alias("x")).select(*keys, "x.*")
