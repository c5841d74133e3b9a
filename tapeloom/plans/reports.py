"""Queries of composed reports (survey G05, G11-G13, G21, M, and the pipelines of §3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.code import pass_signature
from tapeloom.operators import reports as R
from tapeloom.operators import views as V
from tapeloom.plans.cohorts import SCOPE
from tapeloom.plans.inputs import PROGRAMS_SQL, SCORED_SQL, programs, scored
from tapeloom.plans.sqlparts import boot_row, flip_row, hash_draw, signed_ranks
from tapeloom.plans.studies import _HYP, hypotheses
from tapeloom.shared import table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _attempts(spark: SparkSession, root: str) -> DataFrame:
    s = scored(spark, root)
    w = Window.partitionBy("scope", "student_id").orderBy("delivery_id")
    return s.where("attempt_n_pass_fail_vector IS NOT NULL").withColumn("i", F.row_number().over(w) - 1).withColumnRenamed("attempt_n_pass_fail_vector", "v")


_ATT = f"(SELECT *, row_number() OVER (PARTITION BY scope, student_id ORDER BY delivery_id) - 1 AS i, attempt_n_pass_fail_vector AS v, len(list_filter(attempt_n_pass_fail_vector, lambda x: x)) AS np FROM {SCORED_SQL} WHERE attempt_n_pass_fail_vector IS NOT NULL)"


@query(f"""WITH a AS {_ATT}, p AS (SELECT scope, student_id, bool_or(np = len(v)) AS done, arg_min(np = len(v), i) AS at_once FROM a GROUP BY ALL),
   q AS (SELECT scope, count(*) AS n_actors, round(avg(CASE WHEN done THEN 1 ELSE 0 END), 9) AS success_rate, round(avg(CASE WHEN done AND NOT at_once THEN 1 ELSE 0 END), 9) AS failure_before_success_rate FROM p GROUP BY scope)
   SELECT a.scope, count(*) FILTER (i = 0) AS n_depth_0, count(*) FILTER (i = 1) AS n_depth_1, count(*) FILTER (i >= 2) AS n_depth_2_plus, any_value(n_actors) AS n_actors, any_value(success_rate) AS success_rate, any_value(failure_before_success_rate) AS failure_before_success_rate,
     round(avg(np) FILTER (i = 0), 9) AS passes_0, round(avg(np) FILTER (i >= 2), 9) AS passes_2_plus FROM a JOIN q USING (scope) GROUP BY a.scope""")
def g05_slice_summary(spark: SparkSession, root: str) -> DataFrame:
    """Summary of each scope's attempts."""
    s = R.slice_summary(_attempts(spark, root), ["scope"], "student_id", "i", "v")
    return s.select("scope", "n_depth_0", "n_depth_1", "n_depth_2_plus", "n_actors", *[F.round(c, 9).alias(c) for c in ("success_rate", "failure_before_success_rate", "passes_0", "passes_2_plus")])


@query(f"""WITH e AS (SELECT scope, generate_subscripts(v, 1) - 1 AS test, unnest(v) AS ok FROM {_ATT}), b AS (SELECT scope, test, count(*) AS n FROM e WHERE NOT ok GROUP BY ALL)
   SELECT scope, CAST(test AS INTEGER) AS test, n, round(n / t.total, 9) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, test) AS k FROM b) JOIN (SELECT scope, count(*) AS total FROM {_ATT} GROUP BY scope) t USING (scope) WHERE k <= 5""")
def g05_top_failed_tests(spark: SparkSession, root: str) -> DataFrame:
    """The five tests of each scope that fail most often."""
    return R.top_failed_tests(_attempts(spark, root), ["scope"], "v").withColumn("rate", F.round("rate", 9))


_HD = f"(SELECT id, head, coalesce(lab, 'None') AS label, sum(p) AS p FROM (SELECT id, p, unnest(['scope', 'outcome']) AS head, unnest([label, outcome]) AS lab FROM {_HYP}) GROUP BY 1, 2, 3)"
_HT = f"(SELECT id, unnest(['scope', 'outcome']) AS head, coalesce(unnest([label, outcome]), 'None') AS truth FROM {_HYP} WHERE hyp_rank = 1)"


def _heads(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    h = hypotheses(spark, root)
    both = F.explode(F.array(F.struct(F.lit("scope").alias("head"), F.col("label").alias("lab")), F.struct(F.lit("outcome").alias("head"), F.col("outcome").alias("lab"))))
    long = h.select("id", "hyp_rank", "p", both.alias("x")).select("id", "hyp_rank", "p", "x.*")
    truth = long.where("hyp_rank = 1").select("id", "head", F.coalesce("lab", F.lit("None")).alias("truth"))
    return V.distribution(long, ["id", "head"], F.col("lab")), truth


@query(f"""WITH r AS (SELECT id, head, label, p, row_number() OVER (PARTITION BY id, head ORDER BY p DESC, label) AS rk, truth FROM {_HD} JOIN {_HT} USING (id, head)),
   x AS (SELECT id, head, max(p) FILTER (label = truth) AS mass, max(rk) FILTER (label = truth) AS a, sum(power(p - CASE WHEN label = truth THEN 1 ELSE 0 END, 2)) AS b FROM r GROUP BY id, head)
   SELECT head, count(*) AS n, round(avg(CASE WHEN a = 1 THEN 1 ELSE 0 END), 9) AS top1_rate, round(avg(CASE WHEN a <= 2 THEN 1 ELSE 0 END), 9) AS topk_rate, round(avg(coalesce(mass, 0)), 8) AS mean_truth_mass, round(avg(b + CASE WHEN a IS NULL THEN 1 ELSE 0 END), 8) AS mean_brier FROM x GROUP BY head""")
def g11_g13_head_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores of two heads' distributions."""
    s = R.head_scores(*_heads(spark, root), ["id"])
    return s.select("head", "n", *[F.round(c, d).alias(c) for c, d in (("top1_rate", 9), ("topk_rate", 9), ("mean_truth_mass", 8), ("mean_brier", 8))])


@query(f"""WITH m AS (SELECT run_condition, coalesce(signature LIKE 'P%', false) AS a, coalesce(top_1_score > 0.5, false) AS b FROM {SCORED_SQL}),
   r AS (SELECT run_condition AS predictor, h AS heads, avg(CASE WHEN CASE h WHEN 'first' THEN a WHEN 'high' THEN b ELSE a AND b END THEN 1 ELSE 0 END) AS match_rate FROM m, (SELECT unnest(['first', 'high', 'first+high']) AS h) GROUP BY ALL)
   SELECT predictor, heads, round(match_rate, 9) AS match_rate, CAST(rank() OVER (PARTITION BY heads ORDER BY match_rate DESC) AS INTEGER) AS place FROM r""")
def g12_head_ablation(spark: SparkSession, root: str) -> DataFrame:
    """Match rates of all subsets of heads."""
    m = scored(spark, root).select("custom_id", F.col("run_condition").alias("predictor"), F.col("signature").startswith("P").alias("first"), (F.col("top_1_score") > 0.5).alias("high"))
    return R.head_ablation(m, ["custom_id"], "predictor", ["first", "high"]).withColumn("match_rate", F.round("match_rate", 9))


def _paired(metric: str, where: str = "true") -> str:
    """Paired rows of two conditions: custom_id, x, y and their difference."""
    return f"""(SELECT a.custom_id, a.{metric} AS x, b.{metric} AS y, a.{metric} - b.{metric} AS delta, 0 AS g FROM {SCORED_SQL} a JOIN {SCORED_SQL} b ON a.custom_id = b.custom_id
       WHERE a.run_condition = 'full_trace' AND b.run_condition = 'no_trace' AND a.{metric} - b.{metric} IS NOT NULL AND {where.format(s='a.scope')} AND {where.format(s='b.scope')})"""


def _study(metric: str, k: int, samples: int, where: str = "true") -> str:
    """A row of `reports.condition_study`; the seed of the k-th metric is 42 + 1000 k."""
    return f"""SELECT '{metric}' AS metric, m.*, t.low, t.high, coalesce(w.p, 1.0) AS p FROM (SELECT count(*) AS n, round(avg(x), 9) AS mean_left, round(avg(y), 9) AS mean_right, round(avg(delta), 9) AS delta FROM {_paired(metric, where)}) m,
       (WITH p AS (SELECT *, row_number() OVER (ORDER BY custom_id) - 1 AS i FROM {_paired(metric, where)}), k AS (SELECT count(*) AS k FROM p), r AS (SELECT b.range AS b, {hash_draw(42 + 1000 * k, 'b.range', 's.range', 'k.k')} AS i FROM range({samples}) b, k, LATERAL (SELECT * FROM range(k.k)) s),
        t AS (SELECT b, avg(delta) AS theta FROM r JOIN p USING (i) GROUP BY b) SELECT round(list_sort(list(theta))[CAST(floor(0.025 * {samples - 1}) AS BIGINT) + 1], 9) AS low, round(list_sort(list(theta))[CAST(floor(0.975 * {samples - 1}) AS BIGINT) + 1], 9) AS high FROM t) t
       LEFT JOIN {signed_ranks(_paired(metric, where), 'g')} w ON true"""


_METRICS = ("top_1_score", "expected_score")


@query(" UNION ALL ".join(_study(m, k, 50) for k, m in enumerate(_METRICS)))
def m49_m51_condition_study(spark: SparkSession, root: str) -> DataFrame:
    """Two conditions over their pairs: means, bootstrap limits and signed-rank p of two metrics."""
    s = R.condition_study(scored(spark, root).withColumnRenamed("run_condition", "condition"), "custom_id", list(_METRICS), "full_trace", "no_trace", samples=50)
    return s.select("metric", "n", *[F.round(c, 9).alias(c) for c in ("mean_left", "mean_right", "delta", "low", "high")], F.round("p", 7).alias("p"))


def _draw_sql(k: int) -> str:
    return f"CAST('0x' || substr(md5('{k}:' || {{s}}), 1, 8) AS BIGINT) % 2 = 0"


_DRAWS = " UNION ALL ".join(f"SELECT {k} AS draw, metric, delta, p FROM ({_study(m, i, 50, _draw_sql(k))})" for k in range(3) for i, m in enumerate(_METRICS))


@query(f"""SELECT metric, count(*) AS n_draws, count(*) FILTER (p < 0.05) AS n_significant, count(*) FILTER (p < 0.05 AND delta > 0) AS n_positive, count(*) FILTER (p < 0.05 AND delta < 0) AS n_negative,
   (count(*) FILTER (p < 0.05 AND delta > 0) > 0 AND count(*) FILTER (p < 0.05 AND delta < 0) > 0) OR (count(*) FILTER (p < 0.05) > 0 AND count(*) FILTER (p < 0.05) < count(*)) AS unstable FROM ({_DRAWS}) GROUP BY metric""")
def g21_i15_draw_sensitivity(spark: SparkSession, root: str) -> DataFrame:
    """Whether a result holds over several draws of scopes."""
    s = scored(spark, root).withColumnRenamed("run_condition", "condition")
    parts = None
    for k in range(3):
        some = s.where(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(k)), "scope")), 1, 8), 16, 10).cast("bigint") % 2 == 0)
        one = R.condition_study(some, "custom_id", list(_METRICS), "full_trace", "no_trace", samples=50).withColumn("draw", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    return R.draw_sensitivity(parts)


_RUN = f"""(SELECT a.scope, a.run_condition, a.top_1_score AS own, 1 - abs(a.expected_score - b.expected_score) AS other, pa.code_n AS ca, pb.code_n AS cb FROM {SCORED_SQL} a JOIN {SCORED_SQL} b ON a.scope = b.scope AND a.student_id <> b.student_id AND a.run_condition = b.run_condition AND a.signature = b.signature
   JOIN {PROGRAMS_SQL} pa ON pa.custom_id = a.custom_id JOIN {PROGRAMS_SQL} pb ON pb.custom_id = b.custom_id WHERE a.attempt_n_pass_fail_vector IS NOT NULL AND b.attempt_n_pass_fail_vector IS NOT NULL)"""


@query(f"""WITH d AS (SELECT *, levenshtein(ca, cb) / (length(ca) + length(cb)) AS x FROM {_RUN} WHERE own IS NOT NULL AND other IS NOT NULL), t AS (SELECT unnest([NULL, 0.3, 0.45, 0.5])::DOUBLE AS tau)
   SELECT tau, count(*) AS n_pairs, count(DISTINCT (scope, run_condition)) AS n_scopes, round((count(*) FILTER (own > other) + 0.5 * count(*) FILTER (own = other)) / count(*), 9) AS auc, round(avg(own), 9) AS mean_self, round(avg(other), 9) AS mean_other, round(avg(own - other), 9) AS mean_delta FROM t JOIN d ON tau IS NULL OR x <= tau GROUP BY tau""")
def run_report(spark: SparkSession, root: str) -> DataFrame:
    """Own against peers' scores, for all peers and within code distances, from one pass over the pairs (§3.1, D01-D07, M28)."""
    p = programs(spark, root).select("custom_id", F.col("code_n").alias("code"))
    s = scored(spark, root).join(p, "custom_id").withColumn("row", F.concat_ws("/", "custom_id", "run_condition"))
    rows = s.select("scope", "run_condition", "student_id", "row", "code", F.col("attempt_n_pass_fail_vector").alias("vector"), F.col("top_1_score").alias("own"), "expected_score")
    score = 1 - F.abs(F.col("expected_score_a") - F.col("expected_score_b"))
    r = R.run_report(rows, ["scope", "run_condition"], "student_id", "row", score, (0.3, 0.45, 0.5), within=["scope"])
    return r.select("tau", "n_pairs", "n_scopes", *[F.round(c, 9).alias(c) for c in ("mean_self", "mean_other", "mean_delta", "auc")])


_TWO = f"(SELECT * FROM {SCORED_SQL} WHERE top_1_score IS NOT NULL AND custom_id IN (SELECT custom_id FROM {SCORED_SQL} WHERE top_1_score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT run_condition) = 2))"
_RUNS = f"""(SELECT l.scope, sl, nl, sr, nr FROM (SELECT scope, sum(top_1_score) AS sl, count(*) AS nl FROM {_TWO} WHERE run_condition = 'full_trace' GROUP BY 1) l
   JOIN (SELECT scope, sum(top_1_score) AS sr, count(*) AS nr FROM {_TWO} WHERE run_condition = 'no_trace' GROUP BY 1) r ON l.scope = r.scope)"""


@query(f"SELECT * FROM {boot_row(_RUNS, 200)}, {flip_row(_RUNS, 200)}")
def compare_runs(spark: SparkSession, root: str) -> DataFrame:
    """Contrast of two conditions over the ids both have (§3.2, I03-I09)."""
    s = scored(spark, root).where("top_1_score IS NOT NULL")
    both = s.groupBy("custom_id").agg(F.count_distinct("run_condition").alias("n")).where("n = 2").select("custom_id")
    s = s.join(both, "custom_id")
    return R.compare_runs(s.where("run_condition = 'full_trace'"), s.where("run_condition = 'no_trace'"), ["scope"], ["custom_id"], "top_1_score", samples=200).select(
        "n_clusters", "n_assignments", "exact", *[F.round(c, 9).alias(c) for c in ("observed", "low", "high", "share_positive", "p")])


_SEL = f"""(SELECT v.*, t.tertile, array_to_string(list_transform(v.attempt_n_pass_fail_vector, lambda x: CASE WHEN x THEN 'P' ELSE 'F' END), '') AS sig FROM validated_candidate v JOIN
   (SELECT *, CASE WHEN mean_pairwise_dist <= (SELECT quantile_cont(mean_pairwise_dist, 0.33) FROM scope_record WHERE NOT canonical_80) THEN 'T1' WHEN mean_pairwise_dist <= (SELECT quantile_cont(mean_pairwise_dist, 0.67) FROM scope_record WHERE NOT canonical_80) THEN 'T2' WHEN mean_pairwise_dist IS NOT NULL THEN 'T3' END AS tertile
    FROM scope_record WHERE NOT canonical_80) t USING (class_id, assessment_id, exercise_id) WHERE total_attempt_count >= 4 AND attempt_n_pass_fail_vector IS NOT NULL)"""


@query(f"SELECT candidate_id, class_id, assessment_id, exercise_id, tertile, sig AS signature, n AS n_actors FROM {_SEL} JOIN (SELECT class_id, assessment_id, exercise_id, sig, count(DISTINCT student_id) AS n FROM {_SEL} GROUP BY ALL HAVING count(DISTINCT student_id) >= 2) USING (class_id, assessment_id, exercise_id, sig)")
def select_cohort(spark: SparkSession, root: str) -> DataFrame:
    """The matched candidates of a staged selection (§3.3, M31-M33, M48, C24, C25, H11, H14)."""
    c = table(spark, root, "validated_candidate").withColumnRenamed("attempt_n_pass_fail_vector", "vector")
    c = c.select("candidate_id", *SCOPE, "student_id", "total_attempt_count", "vector").where("vector IS NOT NULL")
    done = R.select_cohort(table(spark, root, "scope_record"), c, SCOPE, "student_id", 4, 20, 42)
    return done["matched"].select("candidate_id", *SCOPE, "tertile", "signature", "n_actors")


@query("SELECT array_to_string(list_transform(attempt_n_pass_fail_vector, lambda x: CASE WHEN x THEN 'P' ELSE 'F' END), '') AS signature, count(*) AS n FROM validated_candidate WHERE attempt_n_pass_fail_vector IS NOT NULL GROUP BY 1")
def g25_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Histogram of states."""
    c = table(spark, root, "validated_candidate").where("attempt_n_pass_fail_vector IS NOT NULL")
    return c.groupBy(pass_signature(F.col("attempt_n_pass_fail_vector")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
