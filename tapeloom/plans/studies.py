"""Queries on scored predictions: peers, views, metrics, baselines, inference (survey D, G, H, I, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import sequences as S
from tapeloom.operators import baselines as B
from tapeloom.operators import contracts as K
from tapeloom.operators import inference as N
from tapeloom.operators import intervals as I
from tapeloom.operators import peers as P
from tapeloom.operators import views as V
from tapeloom.plans.inputs import EVENTS_SQL, PROGRAMS_SQL, SCORED_SQL, events, programs, scored
from tapeloom.plans.sequences import _MOTIFS, ORDER
from tapeloom.plans.sqlparts import boot_row, flip_row, hash_draw, sequence_tables, signed_ranks, student_two_sided
from tapeloom.shared import stripped, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 9):
    return F.round(c, n)


GROUP = ["run_condition", "scope"]


def _pairs(spark: SparkSession, root: str, directed: bool = True) -> DataFrame:
    return P.peer_pairs(scored(spark, root).where("signature IS NOT NULL"), GROUP, "signature", "student_id", "custom_id", ["top_1_score", "expected_score"], directed)


_PAIRS = f"""(SELECT a.run_condition, a.scope, a.signature, a.custom_id AS a, b.custom_id AS b, a.top_1_score AS top_1_score_a, b.top_1_score AS top_1_score_b,
   a.expected_score AS expected_score_a, b.expected_score AS expected_score_b FROM {SCORED_SQL} a JOIN {SCORED_SQL} b
   ON a.run_condition = b.run_condition AND a.scope = b.scope AND a.signature = b.signature AND a.student_id <> b.student_id)"""


@query(f"SELECT run_condition, scope, signature, a, b FROM {_PAIRS}")
def d02_d03_directed_peers(spark: SparkSession, root: str) -> DataFrame:
    """Directed pairs of students with one state in one scope."""
    return _pairs(spark, root).select("run_condition", "scope", "signature", "a", "b")


_D = f"(SELECT *, top_1_score_a AS own, top_1_score_b AS other, top_1_score_a - top_1_score_b AS delta FROM {_PAIRS} WHERE top_1_score_a IS NOT NULL AND top_1_score_b IS NOT NULL)"
_SENDERS = f"(SELECT run_condition, scope, signature, a, any_value(own) - avg(other) AS delta FROM {_D} GROUP BY ALL)"
_GROUPS = f"(SELECT run_condition, scope, signature, avg(delta) AS mean_delta, median(delta) AS median_delta, count(*) AS n_senders FROM {_SENDERS} GROUP BY ALL)"


def _discrimination(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    pairs = _pairs(spark, root)
    return P.discrimination(pairs, ["scope"], ["run_condition", "scope", "signature"], "a", "top_1_score_a", "top_1_score_b")


@query(f"""SELECT count(*) AS n_pairs, round(avg(own), 9) AS mean_self, round(avg(other), 9) AS mean_other, round(avg(delta), 9) + 0.0 AS mean_delta, round(median(delta), 9) + 0.0 AS median_delta,
   round((count(*) FILTER (delta > 0) + 0.5 * count(*) FILTER (delta = 0)) / nullif(count(*), 0), 9) AS auc, count(DISTINCT scope) AS n_scopes FROM {_D}""")
def d03_identity_discrimination(spark: SparkSession, root: str) -> DataFrame:
    """Own against peers' score over all pairs."""
    s = _discrimination(spark, root)["summary"]
    return s.select("n_pairs", "n_scopes", *[(_r(c) + F.lit(0.0)).alias(c) for c in ("mean_self", "mean_other", "mean_delta", "median_delta", "auc")])


@query(f"SELECT run_condition, scope, signature, round(mean_delta, 9) + 0.0 AS mean_delta, round(median_delta, 9) + 0.0 AS median_delta, n_senders FROM {_GROUPS}")
def d03_per_match_group(spark: SparkSession, root: str) -> DataFrame:
    """Mean and median difference of each match group."""
    g = _discrimination(spark, root)["per_group"]
    return g.select("run_condition", "scope", "signature", (_r("mean_delta") + F.lit(0.0)).alias("mean_delta"), (_r("median_delta") + F.lit(0.0)).alias("median_delta"), "n_senders")


@query(f"SELECT scope, round(avg(mean_delta), 9) + 0.0 AS mean_delta, count(*) AS n_groups FROM {_GROUPS} GROUP BY scope")
def d03_per_scope(spark: SparkSession, root: str) -> DataFrame:
    """Mean of the group means of each scope."""
    return _discrimination(spark, root)["per_scope"].select("scope", (_r("mean_delta") + F.lit(0.0)).alias("mean_delta"), "n_groups")


@query(f"""SELECT scope, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_pairs, round(avg(m), 9) AS mean_similarity FROM (SELECT run_condition, scope, signature, count(*) AS n,
   avg(1 - abs(expected_score_a - expected_score_b)) AS m FROM {_PAIRS} WHERE expected_score_a IS NOT NULL AND expected_score_b IS NOT NULL GROUP BY ALL) GROUP BY scope""")
def d04_d05_pair_similarity(spark: SparkSession, root: str) -> DataFrame:
    """Similarity of two peers' predictions, group means first."""
    p = _pairs(spark, root).withColumn("sim", 1 - F.abs(F.col("expected_score_a") - F.col("expected_score_b")))
    return P.pair_similarity(p, ["scope"], ["run_condition", "scope", "signature"], "sim").withColumn("mean_similarity", _r("mean_similarity"))


_CODES = f"""(SELECT a.class_id, a.assessment_id, a.exercise_id, a.candidate_id AS a, b.candidate_id AS b, a.code_n AS code_a, b.code_n AS code_b, a.vector = b.vector AS l2a
   FROM {PROGRAMS_SQL} a JOIN {PROGRAMS_SQL} b USING (class_id, assessment_id, exercise_id) WHERE a.candidate_id < b.candidate_id AND a.student_id <> b.student_id AND a.code_n IS NOT NULL AND b.code_n IS NOT NULL)"""
_DIST = "levenshtein(code_a, code_b) / (length(code_a) + length(code_b))"


def _code_pairs(spark: SparkSession, root: str) -> DataFrame:
    return P.text_distances(programs(spark, root), ["class_id", "assessment_id", "exercise_id"], "student_id", "candidate_id", "code_n")


@query(f"""WITH d AS (SELECT a, b, {_DIST} AS x FROM {_CODES}), t AS (SELECT unnest([{', '.join(map(str, P.TAUS))}])::DOUBLE AS tau)
   SELECT tau, CAST(count(a) AS BIGINT) AS n_pairs, (SELECT count(DISTINCT r) FROM (SELECT unnest([a, b]) AS r FROM d WHERE x <= t.tau)) AS n_rows FROM t LEFT JOIN d ON x <= tau GROUP BY tau""")
def d06_d07_threshold_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Pairs and rows within each code distance, undirected."""
    return P.threshold_sweep(_code_pairs(spark, root), "distance")


@query(f"""SELECT class_id, assessment_id, exercise_id, count(*) AS n_pairs, round(avg({_DIST}), 9) AS mean_distance, round(quantile_cont({_DIST}, 0.1), 9) AS p10, round(quantile_cont({_DIST}, 0.9), 9) AS p90 FROM {_CODES} GROUP BY ALL""")
def g27_g45_scope_distances(spark: SparkSession, root: str) -> DataFrame:
    """Mean and quantiles of pairwise code distance by scope."""
    return _code_pairs(spark, root).groupBy("class_id", "assessment_id", "exercise_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), _r(F.avg("distance")).alias("mean_distance"), _r(N.quantile("distance", 0.1)).alias("p10"), _r(N.quantile("distance", 0.9)).alias("p90"))


_FULL = f"(SELECT * FROM {SCORED_SQL} WHERE run_condition = 'full_trace')"
_NONE = f"(SELECT * FROM {SCORED_SQL} WHERE run_condition = 'no_trace')"


def _conditions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, root)
    return s.where("run_condition = 'full_trace'"), s.where("run_condition = 'no_trace'")


@query(f"""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_left_only, count(*) FILTER (a IS NULL) AS n_right_only,
   round(avg(x) FILTER (x - y IS NOT NULL), 9) AS mean_left, round(avg(y) FILTER (x - y IS NOT NULL), 9) AS mean_right, round(avg(x - y), 9) AS mean_delta, round(median(x - y), 9) AS median_delta
   FROM (SELECT a.custom_id AS a, b.custom_id AS b, a.top_1_score AS x, b.top_1_score AS y FROM {_FULL} a FULL JOIN {_NONE} b ON a.custom_id = b.custom_id)""")
def d08_d14_paired_conditions(spark: SparkSession, root: str) -> DataFrame:
    """Two conditions paired on custom_id."""
    s = P.paired_summary(P.paired(*_conditions(spark, root), ["custom_id"], "top_1_score"))
    return s.select("n_both", "n_left_only", "n_right_only", *[_r(c).alias(c) for c in ("mean_left", "mean_right", "mean_delta", "median_delta")])


@query(f"SELECT custom_id, 'left' AS side FROM {_FULL} WHERE custom_id NOT IN (SELECT custom_id FROM {_NONE}) UNION ALL SELECT custom_id, 'right' FROM {_NONE} WHERE custom_id NOT IN (SELECT custom_id FROM {_FULL})")
def d01_d17_key_guard(spark: SparkSession, root: str) -> DataFrame:
    """Keys that only one condition has."""
    return K.key_differences(*_conditions(spark, root), ["custom_id"])


@query("SELECT custom_id, count(*) AS n FROM scored_row GROUP BY custom_id HAVING count(*) > 1")
def d18_a16_duplicate_guard(spark: SparkSession, root: str) -> DataFrame:
    """Keys that stand in several rows."""
    return K.duplicate_keys(table(spark, root, "scored_row"), ["custom_id"])


@query(f"SELECT custom_id FROM {SCORED_SQL} GROUP BY custom_id HAVING count(DISTINCT run_condition) = (SELECT count(DISTINCT run_condition) FROM {SCORED_SQL})")
def d19_shared_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids that every condition has."""
    return P.shared_in_all(scored(spark, root), "run_condition", "custom_id")


@query(f"""SELECT a.custom_id, c AS column_name FROM {_FULL} a JOIN {_NONE} b ON a.custom_id = b.custom_id, (SELECT unnest(['signature', 'top_1_score', 'scope']) AS c)
   WHERE CASE c WHEN 'signature' THEN a.signature IS DISTINCT FROM b.signature WHEN 'scope' THEN a.scope IS DISTINCT FROM b.scope ELSE a.top_1_score IS DISTINCT FROM b.top_1_score END""")
def d23_d24_column_guard(spark: SparkSession, root: str) -> DataFrame:
    """Columns that differ between two conditions."""
    return K.column_differences(*_conditions(spark, root), ["custom_id"], ["signature", "top_1_score", "scope"])


@query("""WITH s AS (SELECT DISTINCT class_id, assessment_id, exercise_id, student_id FROM (SELECT class_id, assessment_id, exercise_id, regexp_replace(student_id, '^\\s+|\\s+$', '', 'g') AS student_id FROM candidate_transition) WHERE student_id <> '')
   SELECT t.class_id, t.assessment_id, t.exercise_id, t.student_id AS own, (SELECT min(d.student_id) FROM s d WHERE d.class_id = t.class_id AND d.assessment_id = t.assessment_id AND d.exercise_id = t.exercise_id AND d.student_id <> t.student_id) AS donor FROM s t""")
def d10_d12_donors(spark: SparkSession, root: str) -> DataFrame:
    """A donor of the same slice for every student."""
    t = table(spark, root, "candidate_transition").withColumn("student_id", stripped(F.col("student_id"))).where("student_id <> ''")
    s = t.select("class_id", "assessment_id", "exercise_id", "student_id").distinct()
    return P.donors(s.withColumn("x", F.lit(1)), s, ["class_id", "assessment_id", "exercise_id"], "student_id", "x").drop("x")


@query("""WITH s AS (SELECT DISTINCT class_id, assessment_id, exercise_id, student_id FROM (SELECT class_id, assessment_id, exercise_id, regexp_replace(student_id, '^\\s+|\\s+$', '', 'g') AS student_id FROM candidate_transition) WHERE student_id <> '')
   SELECT t.class_id, t.assessment_id, t.exercise_id, t.student_id AS own, (SELECT arg_min(d.student_id, md5('42:' || d.student_id)) FROM s d WHERE d.class_id = t.class_id AND d.assessment_id = t.assessment_id AND d.exercise_id = t.exercise_id AND d.student_id <> t.student_id) AS donor FROM s t""")
def d12_d13_seeded_donors(spark: SparkSession, root: str) -> DataFrame:
    """A seeded random donor of the same slice."""
    t = table(spark, root, "candidate_transition").withColumn("student_id", stripped(F.col("student_id"))).where("student_id <> ''")
    s = t.select("class_id", "assessment_id", "exercise_id", "student_id").distinct()
    return P.donors(s.withColumn("x", F.lit(1)), s, ["class_id", "assessment_id", "exercise_id"], "student_id", "x", seed=42).drop("x")


# views and metrics over hypotheses
_HYP = """(SELECT regexp_replace(custom_id, '^\\s+|\\s+$', '', 'g') || '/' || run_condition AS id, hyp_rank, estimated_probability AS p, likely_edit_scope AS label, likely_next_test_outcome AS outcome
   FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(custom_id, '^\\s+|\\s+$', '', 'g'), run_condition, hyp_rank ORDER BY hyp_id) AS rn FROM next_move_hypothesis WHERE custom_id IS NOT NULL) WHERE rn = 1 AND estimated_probability IS NOT NULL)"""


def hypotheses(spark: SparkSession, root: str) -> DataFrame:
    """(id, hyp_rank, p, label, outcome): the first hypothesis of each rank."""
    h = table(spark, root, "next_move_hypothesis").where("custom_id IS NOT NULL").withColumn("c", stripped(F.col("custom_id")))
    w = Window.partitionBy("c", "run_condition", "hyp_rank").orderBy("hyp_id")
    h = h.withColumn("rn", F.row_number().over(w)).where("rn = 1 AND estimated_probability IS NOT NULL")
    return h.select(F.concat_ws("/", "c", "run_condition").alias("id"), "hyp_rank", F.col("estimated_probability").alias("p"), F.col("likely_edit_scope").alias("label"), F.col("likely_next_test_outcome").alias("outcome"))


@query(f"""SELECT custom_id, run_condition, round(list_max(s), 9) AS oracle, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: s[i] * p[i])), 9) AS expected,
   round(s[o[1]] * 0.5 + s[o[2]] * 0.3 + s[o[3]] * 0.2, 9) AS rank_weighted, s[o[1]] AS top_1, list_min(list_filter([1, 2, 3], lambda k: s[o[k]] = list_max(s))) AS best_rank
   FROM (SELECT *, list_transform(p, lambda x: round(abs(sin(x * 12)), 6)) AS s, list_transform(list_sort(list_transform(range(1, 4), lambda i: {{'q': -p[i], 'i': i}})), lambda x: x.i) AS o
   FROM (SELECT custom_id, run_condition, hyp_probabilities AS p FROM {SCORED_SQL} WHERE len(hyp_probabilities) = 3))""")
def h01_h02_views(spark: SparkSession, root: str) -> DataFrame:
    """The five views of three hypotheses' scores."""
    s = scored(spark, root).where(F.size("hyp_probabilities") == 3).select("custom_id", "run_condition", F.col("hyp_probabilities").alias("p"))
    s = s.withColumn("s", F.transform("p", lambda x: F.round(F.abs(F.sin(x * 12)), 6))).withColumn("v", V.views(F.col("s"), F.col("p")))
    return s.select("custom_id", "run_condition", *[_r(F.col(f"v.{c}")).alias(c) for c in ("oracle", "expected", "rank_weighted")], F.col("v.top_1").alias("top_1"), F.col("v.best_rank").cast("bigint").alias("best_rank"))


_DISTR = f"(SELECT id, coalesce(label, 'None') AS label, sum(p) AS p FROM {_HYP} GROUP BY 1, 2)"
_TRUTH = f"(SELECT id, coalesce(label, 'None') AS t FROM {_HYP} WHERE hyp_rank = 2)"
_CAT = f"""(SELECT id, t AS truth, coalesce(max(p) FILTER (label = t), 0) AS truth_mass, max(rk) FILTER (label = t) AS truth_rank, arg_max(label, (p, label)) AS top_label,
   sum(power(p - CASE WHEN label = t THEN 1 ELSE 0 END, 2)) + CASE WHEN count(*) FILTER (label = t) = 0 THEN 1 ELSE 0 END AS brier
   FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS rk FROM {_DISTR} JOIN {_TRUTH} USING (id)) GROUP BY id, t)"""


@query(f"""SELECT id, truth, round(truth_mass, 9) AS truth_mass, truth_rank, top_label, top_label = truth AS top1_match, coalesce(truth_rank <= 2, false) AS top2_hit, coalesce(truth_rank <= 3, false) AS top3_hit,
   round(coalesce(1.0 / truth_rank, 0), 9) AS mrr, round(brier, 9) AS brier, round(-ln(least(greatest(truth_mass, 1e-12), 1)), 9) + 0.0 AS log_loss FROM {_CAT}""")
def l01_l16_categorical_metric(spark: SparkSession, root: str) -> DataFrame:
    """Categorical metric: mass, rank, hits, Brier, log-loss."""
    h = hypotheses(spark, root)
    m = V.categorical_metric(V.distribution(h, ["id"], F.col("label")), h.where("hyp_rank = 2").select("id", F.col("label").alias("truth")), ["id"])
    return m.select("id", "truth", _r("truth_mass").alias("truth_mass"), "truth_rank", "top_label", "top1_match", "top2_hit", "top3_hit", _r("mrr").alias("mrr"), _r("brier").alias("brier"), (_r("log_loss") + F.lit(0.0)).alias("log_loss"))


@query(f"""SELECT id, round(pt, 9) AS p_true, obs AS observed, (pt >= 0.5) = obs AS match, round(CASE WHEN obs THEN pt ELSE 1 - pt END, 9) AS truth_mass, round(power(pt - CASE WHEN obs THEN 1 ELSE 0 END, 2), 7) AS brier,
   round(-ln(least(greatest(CASE WHEN obs THEN pt ELSE 1 - pt END, 1e-12), 1)), 9) + 0.0 AS log_loss FROM (SELECT id, least(1.0, coalesce(sum(p) FILTER (outcome = 'mixed'), 0)) AS pt, bool_or(hyp_rank = 1 AND coalesce(outcome, '') = 'mixed') AS obs FROM {_HYP} GROUP BY id)""")
def l04_l06_binary_metric(spark: SparkSession, root: str) -> DataFrame:
    """Binary presence metric."""
    e = hypotheses(spark, root).groupBy("id").agg(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("outcome") == "mixed", F.col("p"))), F.lit(0.0))).alias("pt"),
        F.bool_or((F.col("hyp_rank") == 1) & (F.coalesce("outcome", F.lit("")) == "mixed")).alias("obs"))
    m = V.binary_metric(e, ["id"], F.col("pt"), F.col("obs"))
    return m.select("id", _r("p_true").alias("p_true"), "observed", "match", _r("truth_mass").alias("truth_mass"), _r("brier", 7).alias("brier"), (_r("log_loss") + F.lit(0.0)).alias("log_loss"))


@query("""SELECT log_id, submit_index, a = b AS within_0, abs(a - b) <= 1 AS within_1, abs(a - b) <= 2 AS within_2 FROM (SELECT log_id, submit_index_0idx AS submit_index, arg_min(from_line_0idx, (ordinal_in_interval_1idx, event_id)) AS a,
   arg_max(from_line_0idx, (ordinal_in_interval_1idx, event_id)) AS b FROM change_micro_event WHERE from_line_0idx IS NOT NULL GROUP BY ALL)""")
def l07_j47_tolerance_metric(spark: SparkSession, root: str) -> DataFrame:
    """First line against last line within tolerances."""
    c = table(spark, root, "change_micro_event").where("from_line_0idx IS NOT NULL").groupBy("log_id", F.col("submit_index_0idx").alias("submit_index"))
    o = F.struct("ordinal_in_interval_1idx", "event_id")
    e = c.agg(F.min_by("from_line_0idx", o).alias("a"), F.max_by("from_line_0idx", o).alias("b"))
    return V.tolerance_metric(e, ["log_id", "submit_index"], F.col("a"), F.col("b"))


_CHAR = "CASE k WHEN 'change' THEN 'c' WHEN 'saida_testar' THEN 'r' WHEN 'submit' THEN 's' WHEN 'kill_program' THEN 'k' WHEN 'keyhandled' THEN 'h' ELSE 't' END"
_FAMCHAR = "CASE k WHEN 'change' THEN 'e' WHEN 'saida_testar' THEN 'r' WHEN 'submit' THEN 's' WHEN 'kill_program' THEN 'u' ELSE 'n' END"
_HYPS = f"""(SELECT log_id, interval_idx, p, label, list_transform(x, lambda k: {_CHAR}) AS a, list_transform(t, lambda k: {_CHAR}) AS b, list_transform(x, lambda k: {_FAMCHAR}) AS fa, list_transform(t, lambda k: {_FAMCHAR}) AS fb FROM (
   SELECT log_id, interval_idx, kinds AS t, unnest([0.7, 0.3]) AS p, unnest(['h1', 'h2']) AS label, unnest([lag(kinds, 1) OVER w, lag(kinds, 2) OVER w]) AS x, lag(kinds, 2) OVER w IS NOT NULL AS live FROM {_MOTIFS} WINDOW w AS (PARTITION BY log_id ORDER BY interval_idx)) WHERE live)"""
_SHARED = "list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda z: z = x)))))"


@query(f"""WITH h AS {_HYPS}, f AS (SELECT log_id, interval_idx, label, fa AS a, fb AS b FROM h), own AS {sequence_tables('h', 'log_id, interval_idx, label')}, fam AS {sequence_tables('f', 'log_id, interval_idx, label')},
   v AS (SELECT log_id, interval_idx, p, label, {_SHARED} / (len(a) + len(b) - {_SHARED}) AS overlap, 1 - levenshtein(array_to_string(a, ''), array_to_string(b, '')) / greatest(len(a), len(b)) AS edit, 1 - levenshtein(array_to_string(fa, ''), array_to_string(fb, '')) / greatest(len(a), len(b)) AS family_edit,
     own.lcs / greatest(len(a), len(b)) AS lcss, fam.lcs / greatest(len(a), len(b)) AS family_lcss, greatest(0, 1 - fam.dtw / greatest(len(a), len(b))) AS family_dtw, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) / greatest(len(a), len(b)) AS prefix
     FROM h JOIN own USING (log_id, interval_idx, label) JOIN fam USING (log_id, interval_idx, label)),
   l AS (UNPIVOT v ON overlap, edit, family_edit, lcss, family_lcss, family_dtw, prefix INTO NAME metric VALUE s)
   SELECT metric, log_id, interval_idx, round(arg_max(s, (p, label)), 9) AS top1_score, round(sum(p * s), 9) AS expected_score FROM l GROUP BY metric, log_id, interval_idx""")
def l09_l15_sequence_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Sequence metrics of a log's two earlier tapes as hypotheses for the next."""
    w = Window.partitionBy("log_id").orderBy("interval_idx")
    m = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind").select("log_id", "interval_idx", F.col("kinds").alias("t"))
    m = m.withColumn("h1", F.lag("t", 1).over(w)).withColumn("h2", F.lag("t", 2).over(w)).where("h2 IS NOT NULL")
    h = m.select("log_id", "interval_idx", "t", F.explode(F.array(F.struct(F.lit(0.7).alias("p"), F.lit("h1").alias("label"), F.col("h1").alias("x")), F.struct(F.lit(0.3).alias("p"), F.lit("h2").alias("label"), F.col("h2").alias("x")))).alias("h")).select("log_id", "interval_idx", "t", "h.*")
    fam = lambda c: F.transform(c, S.event_family)
    x, t = F.col("x"), F.col("t")
    specs = {"overlap": S.multiset_jaccard(x, t), "edit": S.edit_similarity(x, t), "family_edit": S.edit_similarity(fam(x), fam(t)), "lcss": S.lcss_ratio(x, t),
             "family_lcss": S.lcss_ratio(fam(x), fam(t)), "family_dtw": S.dtw_similarity(fam(x), fam(t)), "prefix": S.shared_prefix(x, t) / F.greatest(F.size(x), F.size(t))}
    out = None
    for name, score in specs.items():
        part = V.sequence_metric(h, ["log_id", "interval_idx"], score).select(F.lit(name).alias("metric"), "log_id", "interval_idx", _r("top1_score").alias("top1_score"), _r("expected_score").alias("expected_score"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""SELECT 'edit_scope' AS metric, f AS field, round(avg(v), 9) AS mean, count(v) AS n FROM (SELECT unnest(['brier', 'mrr', 'top1_match']) AS f, unnest([brier, coalesce(1.0 / truth_rank, 0), CASE WHEN top_label = truth THEN 1 ELSE 0 END]) AS v FROM {_CAT}) GROUP BY f""")
def g16_g18_metric_registry(spark: SparkSession, root: str) -> DataFrame:
    """Summary of registered metrics."""
    r = V.MetricRegistry()
    r.register("edit_scope", lambda h: V.categorical_metric(V.distribution(h, ["id"], F.col("label")), h.where("hyp_rank = 2").select("id", F.col("label").alias("truth")), ["id"]), ["top1_match", "mrr", "brier"])
    return r.summary(hypotheses(spark, root)).withColumn("mean", _r("mean"))


@query(f"SELECT truth, top_label, count(*) AS n FROM {_CAT} GROUP BY ALL")
def g19_confusion(spark: SparkSession, root: str) -> DataFrame:
    """Confusion counts of observed and predicted labels."""
    h = hypotheses(spark, root)
    m = V.categorical_metric(V.distribution(h, ["id"], F.col("label")), h.where("hyp_rank = 2").select("id", F.col("label").alias("truth")), ["id"])
    return m.groupBy("truth", "top_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, coalesce(label, 'None') AS label, round(sum(p) / any_value(t), 9) AS p FROM {_HYP} JOIN (SELECT id, sum(p) AS t FROM {_HYP} GROUP BY id) USING (id) GROUP BY 1, 2")
def g10_g14_marginals(spark: SparkSession, root: str) -> DataFrame:
    """Normalised distribution by label."""
    return V.normalised(V.distribution(hypotheses(spark, root), ["id"], F.col("label")), ["id"]).withColumn("p", _r("p"))


@query(f"SELECT id, coalesce(label, 'None') || '|' || coalesce(outcome, 'None') AS label, round(sum(p), 9) AS p FROM {_HYP} GROUP BY 1, 2")
def g15_joint_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Joint distribution over two heads."""
    joint = F.concat_ws("|", F.coalesce("label", F.lit("None")), F.coalesce("outcome", F.lit("None")))
    return V.distribution(hypotheses(spark, root), ["id"], joint).withColumn("p", _r("p"))


_CNT = f"(SELECT split_part(id, ':', 1) AS class_id, coalesce(label, 'None') AS label, count(*) AS n FROM {_HYP} GROUP BY 1, 2)"


def _class_counts(spark: SparkSession, root: str) -> DataFrame:
    h = hypotheses(spark, root)
    return h.groupBy(F.split("id", ":")[0].alias("class_id"), F.coalesce("label", F.lit("None")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_EVERY = f"(SELECT c.class_id, t.label, t.tot - coalesce(o.n, 0) AS r FROM (SELECT DISTINCT class_id FROM {_CNT}) c CROSS JOIN (SELECT label, sum(n) AS tot FROM {_CNT} GROUP BY label) t LEFT JOIN {_CNT} o ON o.class_id = c.class_id AND o.label = t.label)"


@query(f"SELECT class_id, 'scope' AS head, label, round(r / sum(r) OVER (PARTITION BY class_id), 9) AS p FROM {_EVERY}")
def g07_leave_one_out(spark: SparkSession, root: str) -> DataFrame:
    """Label distribution of all other classes."""
    c = _class_counts(spark, root).withColumn("head", F.lit("scope"))
    return B.leave_one_out(c, "class_id", ["head"], "label").withColumn("p", _r("p"))


@query(f"""WITH d AS (SELECT class_id, label, n / sum(n) OVER (PARTITION BY class_id) AS p FROM {_CNT}), f AS (SELECT class_id, coalesce(lead(class_id) OVER (ORDER BY class_id), min(class_id) OVER ()) AS nxt FROM (SELECT DISTINCT class_id FROM d))
   SELECT f.class_id, 'scope' AS head, d.label, round(d.p, 9) AS p FROM f JOIN d ON d.class_id = f.nxt""")
def g08_rotated(spark: SparkSession, root: str) -> DataFrame:
    """Each class with the distribution of the next."""
    c = V.normalised(_class_counts(spark, root).withColumnRenamed("n", "p"), ["class_id"]).withColumn("head", F.lit("scope"))
    return B.rotated(c, "class_id", ["head"], "label").withColumn("p", _r("p"))


@query(f"SELECT class_id, label, round(1.0 / count(*) OVER (PARTITION BY class_id), 9) AS p FROM {_CNT}")
def g09_uniform(spark: SparkSession, root: str) -> DataFrame:
    """Uniform distribution over the labels of a class."""
    return B.uniform(_class_counts(spark, root), ["class_id"], "label").withColumn("p", _r("p"))


_LABELS = ["local_1_to_2_lines", "regional_3_to_5_lines", "broad_6_plus_lines"]


@query(f"SELECT c.class_id, l.label, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT class_id FROM {_CNT}) c CROSS JOIN (SELECT unnest({_LABELS}) AS label) l LEFT JOIN {_CNT} o ON o.class_id = c.class_id AND o.label = l.label")
def g06_fixed_labels(spark: SparkSession, root: str) -> DataFrame:
    """Counts over a fixed set of labels with zeros."""
    return B.fixed_labels(_class_counts(spark, root), ["class_id"], "label", _LABELS)


@query(f"""WITH d AS (SELECT class_id, label, n / sum(n) OVER (PARTITION BY class_id) AS p FROM {_CNT}), q AS (SELECT class_id, label, r / sum(r) OVER (PARTITION BY class_id) AS q FROM {_EVERY}),
   j AS (SELECT q.class_id, coalesce(p, 0) AS p, q FROM q LEFT JOIN d ON d.class_id = q.class_id AND d.label = q.label)
   SELECT class_id, round(sum(abs(p - q)), 9) AS l1, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 9) AS js FROM j GROUP BY class_id""")
def g11_i22_i23_distances(spark: SparkSession, root: str) -> DataFrame:
    """Distance of a class's distribution from that of the others."""
    c = _class_counts(spark, root).withColumn("head", F.lit("scope"))
    p = V.normalised(c.withColumnRenamed("n", "p"), ["class_id"]).select("class_id", "label", "p")
    q = B.leave_one_out(c, "class_id", ["head"], "label").select("class_id", "label", F.col("p").alias("q"))
    return V.distribution_distance(p.join(q, ["class_id", "label"], "full_outer"), ["class_id"]).select("class_id", _r("l1").alias("l1"), _r("js").alias("js"))


@query(f"SELECT class_id, round(entropy(label), 9) AS entropy FROM (SELECT class_id, label FROM {_CNT}, range(n)) GROUP BY class_id")
def i24_g41_entropy(spark: SparkSession, root: str) -> DataFrame:
    """Entropy of a class's labels in bits."""
    return V.entropy(_class_counts(spark, root), ["class_id"]).select("class_id", _r("entropy").alias("entropy"))


@query(f"""SELECT scope, arg_min(signature, (-n, first)) AS signature, CAST(max(n) AS BIGINT) AS n, round(max(n) / sum(n), 9) AS share FROM (SELECT scope, signature, count(*) AS n, min(delivery_id) AS first FROM {SCORED_SQL} WHERE signature IS NOT NULL GROUP BY ALL) GROUP BY scope""")
def g03_g04_majority(spark: SparkSession, root: str) -> DataFrame:
    """Commonest state of each scope, first seen of equal ones."""
    return B.majority(scored(spark, root), ["scope"], "signature", "delivery_id").withColumn("share", _r("share"))


@query(f"""SELECT f.scope, f.custom_id, f.top_1_score, coalesce(n.top_1_score, m.x) AS baseline, round(f.top_1_score - coalesce(n.top_1_score, m.x), 9) AS lift FROM {_FULL} f LEFT JOIN {_NONE} n ON n.scope = f.scope AND n.custom_id = f.custom_id
   LEFT JOIN (SELECT scope, min(top_1_score) AS x FROM {_NONE} GROUP BY scope) m ON m.scope = f.scope""")
def d09_lift(spark: SparkSession, root: str) -> DataFrame:
    """Score over a baseline row, or over the scope's."""
    f, n = _conditions(spark, root)
    back = n.groupBy("scope").agg(F.min("top_1_score").alias("top_1_score"))
    return B.lift(f, n, back, ["scope"], "custom_id", "top_1_score").withColumn("lift", _r("lift"))


@query(f"SELECT round(max(n) / sum(n), 9) AS majority, round(sum(n * n) / power(sum(n), 2), 9) AS random FROM (SELECT motif, count(*) AS n FROM {_MOTIFS} GROUP BY motif)")
def g20_chance_levels(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy of guessing the commonest motif, and by shares."""
    m = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind")
    return B.chance_levels(m, "motif").select(_r("majority").alias("majority"), _r("random").alias("random"))


@query(f"SELECT run_condition, v AS view, round(avg(x), 9) AS mean, round(median(x), 9) AS median, count(x) AS n FROM (SELECT run_condition, unnest(['top_1', 'expected']) AS v, unnest([top_1_score, expected_score]) AS x FROM {SCORED_SQL}) GROUP BY ALL")
def g01_g02_aggregate(spark: SparkSession, root: str) -> DataFrame:
    """Mean, median and number per condition and view."""
    long = scored(spark, root).select("run_condition", F.explode(F.array(F.struct(F.lit("top_1").alias("view"), F.col("top_1_score").alias("x")), F.struct(F.lit("expected").alias("view"), F.col("expected_score").alias("x")))).alias("e")).select("run_condition", "e.*")
    return long.groupBy("run_condition", "view").agg(_r(F.avg("x")).alias("mean"), _r(F.median("x")).alias("median"), F.count("x").alias("n"))


# inference
_CL = f"""(SELECT l.scope, sl, nl, sr, nr FROM (SELECT scope, sum(top_1_score) AS sl, count(*) AS nl FROM {_FULL} WHERE top_1_score IS NOT NULL GROUP BY scope) l
   JOIN (SELECT scope, sum(top_1_score) AS sr, count(*) AS nr FROM {_NONE} WHERE top_1_score IS NOT NULL GROUP BY scope) r USING (scope))"""


@query(f"SELECT * FROM {boot_row(_CL, 500)}")
def i03_i07_cluster_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Cluster bootstrap of the difference of two conditions."""
    c = N.contrast_clusters(*_conditions(spark, root), ["scope"], "top_1_score")
    return N.cluster_bootstrap(c, ["scope"], samples=500).select("n_clusters", *[_r(x).alias(x) for x in ("observed", "low", "high", "share_positive")])


_TWINS = f"""(SELECT run_condition, scope, sum(1 - abs(expected_score_a - expected_score_b)) AS st, count(expected_score_a - expected_score_b) AS nt, sum(1 - abs(top_1_score_a - top_1_score_b)) AS sr, count(top_1_score_a - top_1_score_b) AS nr FROM {_PAIRS}
   GROUP BY ALL HAVING count(expected_score_a - expected_score_b) > 0 AND count(top_1_score_a - top_1_score_b) > 0)"""
_COLLAPSE = f"(SELECT l.scope, l.st - l.sr AS sl, l.nt AS nl, r.st - r.sr AS sr, r.nt AS nr FROM {_TWINS} l JOIN {_TWINS} r ON l.scope = r.scope WHERE l.run_condition = 'full_trace' AND r.run_condition = 'no_trace')"


@query(f"SELECT * FROM {boot_row(_COLLAPSE, 200)}")
def i06_over_collapse(spark: SparkSession, root: str) -> DataFrame:
    """Bootstrap of a difference of differences."""
    p = _pairs(spark, root)
    side = lambda c, v: p.where(F.col("run_condition") == c).withColumn("v", v)
    twin, real = 1 - F.abs(F.col("expected_score_a") - F.col("expected_score_b")), 1 - F.abs(F.col("top_1_score_a") - F.col("top_1_score_b"))
    c = N.over_collapse_clusters(side("full_trace", twin), side("full_trace", real), side("no_trace", twin), side("no_trace", real), ["scope"], "v")
    return N.cluster_bootstrap(c, ["scope"], samples=200).select("n_clusters", *[_r(x).alias(x) for x in ("observed", "low", "high", "share_positive")])


@query(f"SELECT * FROM {flip_row(_CL, 10_000)}")
def i08_sign_flip(spark: SparkSession, root: str) -> DataFrame:
    """Sign-flip test over all clusters: exact up to 20, hashed draws beyond."""
    c = N.contributions(N.contrast_clusters(*_conditions(spark, root), ["scope"], "top_1_score"), ["scope"])
    return N.sign_flip(c, ["scope"]).withColumn("p", _r("p"))


@query(f"SELECT * FROM {flip_row(_CL, 500)}")
def i08_sign_flip_sampled(spark: SparkSession, root: str) -> DataFrame:
    """Sign-flip test over all clusters."""
    c = N.contributions(N.contrast_clusters(*_conditions(spark, root), ["scope"], "top_1_score"), ["scope"])
    return N.sign_flip(c, ["scope"], samples=500).withColumn("p", _r("p"))


@query(f"""WITH p AS (SELECT a.custom_id, a.top_1_score - b.top_1_score AS d, row_number() OVER (ORDER BY a.custom_id) - 1 AS i FROM {_FULL} a JOIN {_NONE} b ON a.custom_id = b.custom_id WHERE a.top_1_score - b.top_1_score IS NOT NULL), k AS (SELECT count(*) AS k FROM p),
   r AS (SELECT b.range AS b, {hash_draw(42, 'b.range', 's.range', 'k.k')} AS i FROM range(100) b, k, LATERAL (SELECT * FROM range(k.k)) s), t AS (SELECT b, avg(d) AS theta FROM r JOIN p USING (i) GROUP BY b)
   SELECT round((SELECT avg(d) FROM p), 9) AS mean, round(list_sort(list(theta))[CAST(floor(0.025 * 99) AS BIGINT) + 1], 9) AS low, round(list_sort(list(theta))[CAST(floor(0.975 * 99) AS BIGINT) + 1], 9) AS high FROM t""")
def i10_i13_paired_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Bootstrap of a paired difference with index limits."""
    p = P.paired(*_conditions(spark, root), ["custom_id"], "top_1_score")
    return N.paired_bootstrap(p, "delta", ["custom_id"], samples=100).select(_r("mean").alias("mean"), _r("low").alias("low"), _r("high").alias("high"))


_PD = f"(SELECT a.custom_id, split_part(a.custom_id, ':', 1) AS class_id, round(a.top_1_score - b.top_1_score, 6) AS delta, a.top_1_score AS x, b.top_1_score AS y FROM {_FULL} a JOIN {_NONE} b ON a.custom_id = b.custom_id WHERE a.top_1_score - b.top_1_score IS NOT NULL)"


def _deltas(spark: SparkSession, root: str) -> DataFrame:
    p = P.paired(*_conditions(spark, root), ["custom_id"], "top_1_score").where("delta IS NOT NULL")
    return p.select("custom_id", F.split("custom_id", ":")[0].alias("class_id"), F.round("delta", 6).alias("delta"), F.col("left").alias("x"), F.col("right").alias("y"))


@query(f"""WITH c AS (SELECT class_id, count(*) FILTER (delta > 0) AS k, count(*) FILTER (delta <> 0) AS n FROM {_PD} GROUP BY class_id),
   m AS (SELECT class_id, k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS l, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) AS own FROM c, LATERAL (SELECT range AS i FROM range(n + 1)))
   SELECT class_id, k AS n_positive, n AS n_nonzero, CASE WHEN n = 0 THEN 'nan'::DOUBLE ELSE round(least(1, sum(CASE WHEN l <= own + 1e-9 THEN exp(l - n * ln(2)) ELSE 0 END)), 7) END AS p FROM m GROUP BY class_id, k, n""")
def i01_i02_sign_test(spark: SparkSession, root: str) -> DataFrame:
    """Exact sign test per class."""
    return N.sign_test(_deltas(spark, root), ["class_id"], "delta").withColumn("p", _r("p", 7))


@query(f"SELECT class_id, n, w_plus, p FROM {signed_ranks(_PD, 'class_id')}")
def i11_i12_h26_signed_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Signed-rank test per class: sums of ranks and p."""
    return N.wilcoxon(_deltas(spark, root), ["class_id"], "delta").select("class_id", "n", _r("w_plus", 6).alias("w_plus"), _r("p", 7).alias("p"))


_WHOLE = f"(SELECT 0 AS g, delta FROM {_PD})"


@query(f"SELECT n, w_plus, p FROM {signed_ranks(_WHOLE, 'g')}")
def i11_wilcoxon(spark: SparkSession, root: str) -> DataFrame:
    """Signed-rank test over all pairs, with ties."""
    return N.wilcoxon(_deltas(spark, root).withColumn("g", F.lit(0)), ["g"], "delta").select("n", _r("w_plus", 6).alias("w_plus"), _r("p", 7).alias("p"))


_RHO = f"(SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM {_PD}))"


@query(f"SELECT n, round(rho, 9) AS rho, round({student_two_sided('t', 'df')}, 7) AS p FROM (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM {_RHO})")
def i16_spearman(spark: SparkSession, root: str) -> DataFrame:
    """Rank correlation of two conditions' scores with its t test (I16)."""
    d = _deltas(spark, root).withColumn("all", F.lit(1))
    return N.spearman(d, ["all"], "x", "y").select("n", _r("rho").alias("rho"), _r("p", 7).alias("p"))


@query(f"""SELECT class_id, count(*) AS n, round(min(x), 9) AS lo, round(quantile_cont(x, 0.5), 9) AS median, round(list_sort(list(x))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1], 9) AS p90_floor,
   round(list_sort(list(x))[CAST(ceil(0.9 * count(*)) AS BIGINT)], 9) AS p90_nearest, round(stddev_pop(x), 9) AS sd FROM {_PD} GROUP BY class_id""")
def g33_g44_quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Numbers and quantiles of several kinds per class."""
    return _deltas(spark, root).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), _r(F.min("x")).alias("lo"), _r(N.quantile("x", 0.5)).alias("median"), _r(N.quantile("x", 0.9, "floor_index")).alias("p90_floor"),
                                                        _r(N.quantile("x", 0.9, "nearest")).alias("p90_nearest"), _r(F.stddev_pop("x")).alias("sd"))
