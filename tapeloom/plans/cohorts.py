"""Queries on cohorts and collections of texts (survey G, H, J53-J64, C24-C27, D22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import words as W
from tapeloom.operators import intervals as I
from tapeloom.operators import prose as P
from tapeloom.operators import selection as L
from tapeloom.operators import views as V
from tapeloom.plans.inputs import PROGRAMS_SQL, SCORED_SQL, SUMMARIES_SQL, ascii_sql, events, programs, scored, summaries
from tapeloom.plans.scalars import _NG, _STOP, _WORDS
from tapeloom.plans.sequences import _ISL, ORDER
from tapeloom.shared import stripped, table, written

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SCOPE = ["class_id", "assessment_id", "exercise_id"]
_TERT = """(SELECT *, CASE WHEN mean_pairwise_dist <= (SELECT quantile_cont(mean_pairwise_dist, 0.33) FROM scope_record) THEN 'T1' WHEN mean_pairwise_dist <= (SELECT quantile_cont(mean_pairwise_dist, 0.67) FROM scope_record) THEN 'T2' WHEN mean_pairwise_dist IS NOT NULL THEN 'T3' END AS tertile FROM scope_record)"""


@query(f"SELECT class_id, assessment_id, exercise_id, tertile, CASE WHEN mean_pairwise_dist IS NULL THEN NULL ELSE CAST(mean_pairwise_dist >= 0.1 AS INTEGER) + CAST(mean_pairwise_dist >= 0.2 AS INTEGER) + CAST(mean_pairwise_dist >= 0.4 AS INTEGER) END AS bin FROM {_TERT}")
def h11_h13_tertiles(spark: SparkSession, root: str) -> DataFrame:
    """Tertiles and fixed bins of scopes."""
    s = L.tertiles(table(spark, root, "scope_record"), "mean_pairwise_dist")
    return s.select(*SCOPE, "tertile", L.fixed_bins(F.col("mean_pairwise_dist"), [0.1, 0.2, 0.4]).alias("bin"))


@query("SELECT class_id, assessment_id, exercise_id FROM scope_record WHERE NOT canonical_80")
def c24_canonical_exclusion(spark: SparkSession, root: str) -> DataFrame:
    """Scopes whose programs aren't nearly all the same."""
    return table(spark, root, "scope_record").where(~F.col("canonical_80")).select(*SCOPE)


def _key(alias: str = "") -> str:
    return "class_id || ':' || assessment_id || ':' || exercise_id"


@query(f"""WITH c AS (SELECT tertile, count(*) AS n FROM {_TERT} WHERE tertile IS NOT NULL GROUP BY tertile), r AS (SELECT *, row_number() OVER (PARTITION BY tertile ORDER BY md5('42:' || {_key()}), {_key()}) AS pick FROM {_TERT})
   SELECT class_id, assessment_id, exercise_id, tertile FROM r WHERE pick <= 7 AND tertile IN ('T1', 'T2', 'T3') AND NOT (tertile = 'T3' AND pick > 6)""")
def h15_h16_stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    """Twenty scopes by quota per tertile."""
    s = L.tertiles(table(spark, root, "scope_record"), "mean_pairwise_dist").withColumn("k", F.concat_ws(":", *SCOPE))
    return L.stratified_sample(s, "tertile", "k", 20, 42, ["T1", "T2", "T3"]).select(*SCOPE, "tertile")


@query(f"SELECT custom_id, run_condition, scope, signature, n AS n_actors FROM {SCORED_SQL} JOIN (SELECT scope, signature, count(DISTINCT student_id) AS n FROM {SCORED_SQL} WHERE signature IS NOT NULL GROUP BY ALL HAVING count(DISTINCT student_id) >= 2) USING (scope, signature)")
def h14_matched_groups(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose state two students or more share in a scope."""
    return L.matched_groups(scored(spark, root), ["scope"], "signature", "student_id").select("custom_id", "run_condition", "scope", "signature", "n_actors")


@query(f"""SELECT scope, CASE WHEN s = 0 THEN 'no_signature' WHEN a < 2 THEN 'one_actor' ELSE 'no_shared_state' END AS reason FROM (SELECT scope, count(DISTINCT student_id) AS a, count(signature) AS s FROM {SCORED_SQL} GROUP BY scope)
   WHERE scope NOT IN (SELECT scope FROM {SCORED_SQL} WHERE signature IS NOT NULL GROUP BY scope, signature HAVING count(DISTINCT student_id) >= 2)""")
def h14_dropped_scopes(spark: SparkSession, root: str) -> DataFrame:
    """Scopes without such a group, and why."""
    return L.dropped_scopes(scored(spark, root), ["scope"], "signature", "student_id")


_CT = "(SELECT DISTINCT log_id, class_id, assessment_id, regexp_replace(student_id, '^\\s+|\\s+$', '', 'g') AS student_id, transition_index_0idx, total_attempt_count FROM candidate_transition WHERE student_id IS NOT NULL)"


def _transitions(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "candidate_transition").where("student_id IS NOT NULL").withColumn("student_id", stripped(F.col("student_id")))
    return t.select("log_id", "class_id", "assessment_id", "student_id", "transition_index_0idx", "total_attempt_count").distinct()


_RR = f"""(SELECT *, row_number() OVER (PARTITION BY class_id, assessment_id ORDER BY k, student_id) AS cycle FROM (SELECT *, row_number() OVER (PARTITION BY class_id, assessment_id, student_id ORDER BY transition_index_0idx, log_id) AS k FROM {_CT}))"""


@query(f"SELECT log_id, transition_index_0idx, CAST(cycle AS BIGINT) AS cycle FROM {_RR} ORDER BY cycle, class_id, assessment_id LIMIT 50")
def h17_h18_round_robin(spark: SparkSession, root: str) -> DataFrame:
    """Fifty transitions by turns of slices and students."""
    r = L.round_robin(_transitions(spark, root), ["class_id", "assessment_id"], "student_id", ["transition_index_0idx", "log_id"], 50)
    return r.select("log_id", "transition_index_0idx", F.col("cycle").cast("bigint").alias("cycle"))


@query(f"SELECT log_id, transition_index_0idx, CAST(cycle AS BIGINT) AS cycle FROM {_RR} WHERE total_attempt_count >= 4 ORDER BY cycle, class_id, assessment_id LIMIT 50")
def h21_h22_lazy_round_robin(spark: SparkSession, root: str) -> DataFrame:
    """The same where some candidates only use up their turn."""
    r = L.round_robin(_transitions(spark, root), ["class_id", "assessment_id"], "student_id", ["transition_index_0idx", "log_id"], 50, F.col("total_attempt_count") >= 4)
    return r.select("log_id", "transition_index_0idx", F.col("cycle").cast("bigint").alias("cycle"))


@query(f"SELECT log_id, CASE WHEN count(*) = 2 THEN min(transition_index_0idx) ELSE max(transition_index_0idx) END AS transition_index_0idx FROM {_CT} GROUP BY log_id")
def h19_deepest(spark: SparkSession, root: str) -> DataFrame:
    """The deepest transition of each log, the first of two."""
    return L.deepest(_transitions(spark, root), ["log_id"], "transition_index_0idx").select("log_id", "transition_index_0idx")


@query(f"SELECT log_id, transition_index_0idx FROM {_CT} WHERE total_attempt_count >= 2 ORDER BY CASE WHEN total_attempt_count >= 3 THEN 0 ELSE 1 END, log_id, transition_index_0idx LIMIT 40")
def h20_history_first(spark: SparkSession, root: str) -> DataFrame:
    """Forty transitions, those with a longer history first."""
    return L.history_first(_transitions(spark, root), F.col("total_attempt_count"), ["log_id", "transition_index_0idx"], 40).select("log_id", "transition_index_0idx")


@query(f"""SELECT class_id, assessment_id, log_id, n AS group_size, 'S' || lpad(CAST(row_number() OVER (ORDER BY n DESC, class_id, assessment_id) AS VARCHAR), 2, '0') AS alias FROM (SELECT *, count(*) OVER (PARTITION BY class_id, assessment_id) AS n,
   row_number() OVER (PARTITION BY class_id, assessment_id ORDER BY log_id, transition_index_0idx) - 1 AS k FROM {_CT}) WHERE k = n // 2 ORDER BY n DESC, class_id, assessment_id LIMIT 10""")
def h23_representatives(spark: SparkSession, root: str) -> DataFrame:
    """The middle transition of the ten largest slices."""
    return L.representatives(_transitions(spark, root), ["class_id", "assessment_id"], ["log_id", "transition_index_0idx"], 10).select("class_id", "assessment_id", "log_id", "group_size", "alias")


@query(f"""SELECT * FROM (SELECT custom_id, run_condition, top_1_score, 'low' AS "end" FROM {SCORED_SQL} WHERE top_1_score IS NOT NULL ORDER BY top_1_score, custom_id, run_condition LIMIT 5) UNION ALL
   SELECT * FROM (SELECT custom_id, run_condition, top_1_score, 'high' FROM {SCORED_SQL} WHERE top_1_score IS NOT NULL ORDER BY top_1_score DESC, custom_id, run_condition LIMIT 5)""")
def h25_extremes(spark: SparkSession, root: str) -> DataFrame:
    """Five lowest and five highest scores."""
    return L.extremes(scored(spark, root), "top_1_score", ["custom_id", "run_condition"]).select("custom_id", "run_condition", "top_1_score", "end")


@query("""SELECT class_id, count(*) AS n_all, count(*) FILTER (student_id IS NOT NULL) AS n_student, count(*) FILTER (student_id IS NOT NULL AND total_attempt_count >= 4) AS n_depth, count(*) FILTER (student_id IS NOT NULL AND total_attempt_count >= 4 AND visible_run_count > 0) AS n_runs,
   round(count(*) FILTER (student_id IS NOT NULL AND total_attempt_count >= 4 AND visible_run_count > 0) / count(*), 9) AS share_runs FROM candidate_transition GROUP BY class_id""")
def g23_g26_funnel(spark: SparkSession, root: str) -> DataFrame:
    """Funnel of transitions per class."""
    f = L.funnel(table(spark, root, "candidate_transition"), ["class_id"], {"student": F.col("student_id").isNotNull(), "depth": F.col("total_attempt_count") >= 4, "runs": F.col("visible_run_count") > 0})
    return f.select("class_id", "n_all", "n_student", "n_depth", "n_runs", F.round("share_runs", 9).alias("share_runs"))


_REASON = "CASE WHEN student_id IS NULL THEN 'no_student' WHEN total_attempt_count < 4 THEN 'too_few_attempts' WHEN assessment_title IS NULL THEN 'no_title' END"


@query(f"SELECT reason, count(*) AS n, list_sort(list(log_id))[1:10] AS examples FROM (SELECT {_REASON} AS reason, log_id FROM candidate_transition) WHERE reason IS NOT NULL GROUP BY reason")
def g24_c09_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Reasons of exclusion with up to ten examples."""
    why = F.when(F.col("student_id").isNull(), "no_student").when(F.col("total_attempt_count") < 4, "too_few_attempts").when(F.col("assessment_title").isNull(), "no_title")
    return L.reasons(table(spark, root, "candidate_transition").withColumn("reason", why), "reason", "log_id")


@query("SELECT class_id, assessment_id, exercise_id FROM scope_record WHERE n_students >= 10 ORDER BY n_students DESC, distinct_codes DESC, class_id, assessment_id, exercise_id LIMIT 15")
def g28_h24_ranked_scopes(spark: SparkSession, root: str) -> DataFrame:
    """Scopes by several keys in mixed order."""
    return L.ranked_slices(table(spark, root, "scope_record"), [F.desc("n_students"), F.desc("distinct_codes"), *map(F.col, SCOPE)], F.col("n_students") >= 10, 15).select(*SCOPE)


@query(f"""WITH p AS (SELECT class_id, assessment_id, exercise_id, code_n, count(*) AS n FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL GROUP BY ALL), s AS (SELECT class_id, assessment_id, exercise_id, count(DISTINCT student_id) AS n_students FROM {PROGRAMS_SQL} GROUP BY ALL)
   SELECT s.class_id, s.assessment_id, s.exercise_id, n_students, c.distinct_codes, c.share >= 0.8 AS canonical_80 FROM s LEFT JOIN (SELECT class_id, assessment_id, exercise_id, count(*) AS distinct_codes, max(n) / sum(n) AS share FROM p GROUP BY ALL) c USING (class_id, assessment_id, exercise_id)""")
def g27_scope_profile(spark: SparkSession, root: str) -> DataFrame:
    """How alike the programs of each scope are."""
    return L.scope_profile(programs(spark, root), SCOPE, "student_id", "code_n").select(*SCOPE, "n_students", "distinct_codes", "canonical_80")


_ENC = f"(SELECT log_id, interval_idx, count(*) AS n, count(*) FILTER (kind = 'change') AS c, count(*) FILTER (kind = 'saida_testar') AS r, count(*) FILTER (kind = 'submit') AS s, count(*) FILTER (kind = 'kill_program') AS k FROM {_ISL} GROUP BY ALL)"


@query(f"""SELECT log_id, interval_idx, CASE WHEN n <= 1 AND s = 1 AND c = 0 THEN 'submit_only' WHEN c = 0 AND r >= 1 THEN 'run_heavy_no_change' WHEN n >= 400 OR c >= 350 THEN 'large_dense' ELSE 'repair_focused' END AS case_type,
   list_filter([CASE WHEN n <= 5 THEN 'very_small_event_log' END, CASE WHEN c = 0 THEN 'no_code_edits' END, CASE WHEN r >= 2 AND c < 3 THEN 'run_heavy_with_few_edits' END, CASE WHEN r >= 20 THEN 'many_local_runs' END, CASE WHEN k >= 1 THEN 'contains_kill_program' END], lambda x: x IS NOT NULL) AS flags FROM {_ENC}""")
def c13_c14_encoding(spark: SparkSession, root: str) -> DataFrame:
    """Case and flags of intervals."""
    r = I.islands(events(spark, root), ["log_id"], ORDER, F.col("kind") == "submit")
    c = I.interval_counts(r, ["log_id", "interval_idx"], "kind", ["change", "saida_testar", "submit", "kill_program"])
    n = F.col
    return c.select("log_id", "interval_idx", L.encoding_case(n("n_events"), n("n_submit"), n("n_change"), n("n_saida_testar")).alias("case_type"),
                    L.encoding_flags(n("n_events"), n("n_change"), n("n_saida_testar"), F.lit(0), n("n_kill_program")).alias("flags"))


# texts
_TFIDF = f"""tok AS (SELECT custom_id || '/' || run_condition AS doc, exercise_id, student_id, unnest({_WORDS}) AS token FROM {SUMMARIES_SQL}), tf AS (SELECT doc, exercise_id, token, count(*) AS n FROM tok GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), raw AS (SELECT doc, exercise_id, token, n * (ln((1.0 + (SELECT count(*) FROM {SUMMARIES_SQL})) / (1 + df)) + 1) AS x FROM tf JOIN df USING (token)),
  v AS (SELECT doc, exercise_id, token, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM raw), pr AS (SELECT a.doc AS a, b.doc AS b, a.exercise_id AS ea, b.exercise_id AS eb, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.token = b.token AND a.doc < b.doc GROUP BY ALL)"""


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return summaries(spark, root).withColumn("doc", F.concat_ws("/", "custom_id", "run_condition"))


@query(f"""WITH {_TFIDF}, n AS (SELECT count(DISTINCT doc) AS n FROM v), g AS (SELECT exercise_id, count(DISTINCT doc) AS n FROM v GROUP BY 1)
   SELECT 'all' AS kind, n AS n_docs, CAST(n * (n - 1) / 2 AS BIGINT) AS n_pairs, round((SELECT sum(s) FROM pr) / (n * (n - 1) / 2), 7) AS mean_similarity FROM n
   UNION ALL SELECT exercise_id, n, CAST(n * (n - 1) / 2 AS BIGINT), CASE WHEN n > 1 THEN round((SELECT coalesce(sum(s), 0) FROM pr WHERE ea = g.exercise_id AND eb = g.exercise_id) / (n * (n - 1) / 2), 7) END FROM g""")
def d22_j53_mean_similarity(spark: SparkSession, root: str) -> DataFrame:
    """Mean TF-IDF cosine over all pairs and within exercises, without making the pairs."""
    w = written(P.weights(_docs(spark, root), ["doc", "exercise_id"], "summary"), "weights")  # four branches read it
    every = P.mean_similarity(w, []).select(F.lit("all").alias("kind"), "n_docs", "n_pairs", "mean_similarity")
    per = P.mean_similarity(w, ["exercise_id"]).select(F.col("exercise_id").alias("kind"), "n_docs", "n_pairs", "mean_similarity")
    return every.unionByName(per).withColumn("mean_similarity", F.round("mean_similarity", 7))


def a_fiftieth(w: DataFrame) -> DataFrame:
    """The rows of a fiftieth of the texts, chosen by a hash."""
    return w.where(F.conv(F.substring(F.md5("doc"), 1, 6), 16, 10).cast("bigint") % 50 == 0)


@query(f"""WITH {_TFIDF} SELECT q AS query, d AS doc, round(s, 7) AS similarity FROM (SELECT a AS q, b AS d, s FROM pr UNION ALL SELECT b, a, s FROM pr)
   WHERE CAST('0x' || substr(md5(q), 1, 6) AS BIGINT) % 50 = 0""")
def j55_similarity_to_queries(spark: SparkSession, root: str) -> DataFrame:
    """Cosine of a fiftieth of the texts, chosen by a hash, with all."""
    w = P.word_lists(_docs(spark, root), [], "doc", "summary")
    return P.similarity_to(a_fiftieth(w), w).withColumn("similarity", F.round("similarity", 7))


@query(f"""WITH w AS (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL}) SELECT run_condition, term, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_condition ORDER BY n DESC, term) AS place FROM (
   SELECT run_condition, term, count(*) AS n FROM (SELECT run_condition, unnest({_NG.format(n=2)}) AS term FROM w) GROUP BY ALL)) WHERE place <= 25""")
def g35_top_ngrams(spark: SparkSession, root: str) -> DataFrame:
    """Commonest bigrams per condition."""
    return P.top_terms(summaries(spark, root), ["run_condition"], W.ngrams(W.word_list(F.col("summary")), 2))


_G36 = f"list_filter(list_distinct({_NG.format(n=3)} || {_NG.format(n=4)} || {_NG.format(n=5)} || {_NG.format(n=6)}), lambda g: len(list_filter(string_split(g, ' '), lambda x: NOT list_contains({_STOP}, x))) > 0)"


@query(f"""WITH w AS (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL}), g AS (SELECT exercise_id, unnest({_G36}) AS term FROM w), c AS (SELECT exercise_id, term, count(*) AS df, any_value(n) AS n_docs FROM g JOIN (SELECT exercise_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3) USING (exercise_id) GROUP BY ALL HAVING count(*) >= 0.5 * any_value(n))
   SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.exercise_id = c.exercise_id AND d.term <> c.term AND contains(' ' || d.term || ' ', ' ' || c.term || ' '))""")
def g40_j62_templates(spark: SparkSession, root: str) -> DataFrame:
    """Phrases in half of an exercise's summaries, without those inside longer ones."""
    d = _docs(spark, root)
    return P.template_phrases(d, ["exercise_id"], "doc", "summary")


_SPOTS = " UNION ALL ".join(f"SELECT doc, exercise_id, {n} AS n, unnest(range(1, len(w) - {n} + 2)) AS i, unnest({_NG.format(n=n)}) AS term FROM w WHERE len(w) >= {n}" for n in (3, 4, 5, 6))


@query(f"""WITH w AS (SELECT *, custom_id || '/' || run_condition AS doc, {_WORDS} AS w FROM {SUMMARIES_SQL}), g AS (SELECT exercise_id, unnest({_G36}) AS term FROM w), c AS (SELECT exercise_id, term FROM g JOIN (SELECT exercise_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3) USING (exercise_id) GROUP BY ALL HAVING count(*) >= 0.5 * any_value(n)),
   t AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.exercise_id = c.exercise_id AND d.term <> c.term AND contains(' ' || d.term || ' ', ' ' || c.term || ' '))),
   p AS (SELECT doc, count(DISTINCT place) AS covered FROM (SELECT doc, unnest(range(i, i + n)) AS place FROM ({_SPOTS}) JOIN t USING (exercise_id, term)) GROUP BY doc)
   SELECT doc, len(w) AS n_words, coalesce(covered, 0) AS covered FROM w LEFT JOIN p USING (doc)""")
def g40_j63_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Words covered by the phrases of the exercise."""
    d = written(_docs(spark, root), "docs")
    return P.template_coverage(d, ["exercise_id"], "doc", "summary", P.template_phrases(d, ["exercise_id"], "doc", "summary"))


_PH = f"list_filter(list_distinct({_NG.format(n=1)} || {_NG.format(n=2)} || {_NG.format(n=3)}), lambda g: NOT list_contains({_STOP}, string_split(g, ' ')[1]) AND NOT list_contains({_STOP}, string_split(g, ' ')[-1]))"


@query(f"""WITH w AS (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL}), p AS (SELECT run_condition, unnest({_PH}) AS term FROM w) SELECT term, count(*) AS df FROM p WHERE run_condition = 'full_trace' AND term NOT IN (SELECT term FROM p WHERE run_condition = 'no_trace') GROUP BY term HAVING count(*) >= 5""")
def g42_only_in_full(spark: SparkSession, root: str) -> DataFrame:
    """Phrases of five full-trace summaries or more and of no other."""
    d = _docs(spark, root)
    return P.only_in(d.where("run_condition = 'full_trace'"), d.where("run_condition = 'no_trace'"), "doc", "summary")


@query(f"""WITH w AS (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL}), g AS (SELECT custom_id, run_condition, unnest({_G36}) AS g FROM w), r AS (SELECT DISTINCT g FROM g WHERE run_condition = 'no_trace')
   SELECT custom_id, count(*) AS n_ngrams, count(r.g) AS n_shared, round(count(r.g) / count(*), 9) AS share FROM g LEFT JOIN r USING (g) WHERE run_condition = 'full_trace' GROUP BY custom_id""")
def g37_ngram_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Share of a text's n-grams that stand in a reference collection."""
    d = summaries(spark, root)
    return P.overlap_with(d.where("run_condition = 'full_trace'"), ["custom_id"], "summary", d.where("run_condition = 'no_trace'"), "summary").withColumn("share", F.round("share", 9))


@query(f"WITH w AS (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL}) SELECT run_condition, round(entropy(w[3]), 9) AS entropy FROM w WHERE w[1] = 'the' AND w[2] = 'student' AND w[3] IS NOT NULL GROUP BY run_condition")
def g41_opening_entropy(spark: SparkSession, root: str) -> DataFrame:
    """Entropy of the word after a fixed opening."""
    n = P.next_word_counts(summaries(spark, root), ["run_condition"], "summary", ["the", "student"])
    return V.entropy(n, ["run_condition"]).select("run_condition", F.round("entropy", 9).alias("entropy"))


@query(f"""SELECT run_condition, f AS family, CAST(sum(h) AS BIGINT) AS hits, count(*) FILTER (h > 0) AS docs_with_any, round(1000.0 * sum(h) / sum(n), 9) AS per_1000 FROM (SELECT run_condition, len({_WORDS}) AS n, unnest(['line', 'run']) AS f,
   unnest([len(regexp_extract_all({ascii_sql('summary')}, '\\bline \\d+')), len(regexp_extract_all({ascii_sql('summary')}, '\\bruns?\\b'))]) AS h FROM {SUMMARIES_SQL}) GROUP BY ALL""")
def g43_g39_term_rates(spark: SparkSession, root: str) -> DataFrame:
    """Terms of families per 1000 words."""
    return P.term_rates(summaries(spark, root), ["run_condition"], "summary", {"line": r"\bline \d+", "run": r"\bruns?\b"}).withColumn("per_1000", F.round("per_1000", 9))


@query(f"""SELECT exercise_id, round(avg(top_1_score) FILTER (run_condition = 'full_trace'), 9) AS full_trace, round(avg(top_1_score) FILTER (run_condition = 'no_trace'), 9) AS no_trace FROM (SELECT *, split_part(scope, ':', 3) AS exercise_id FROM {SCORED_SQL}) GROUP BY exercise_id""")
def g22_b08_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Means per exercise by condition."""
    from tapeloom.sources.documents import metric_pivot

    s = scored(spark, root).withColumn("exercise_id", F.split("scope", ":")[2]).groupBy("exercise_id", "run_condition").agg(F.round(F.avg("top_1_score"), 9).alias("m"))
    return metric_pivot(s, ["exercise_id"], "run_condition", "m", ["full_trace", "no_trace"])
