"""Queries of study tables: summaries of metrics, what summaries say against what was observed, conditions side by side
(survey D20, G38, J69, J71, M49-M65, M75)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import sequences as S
from tapeloom.functions import words as W
from tapeloom.operators import inference as N
from tapeloom.operators import intervals as I
from tapeloom.operators import prose as P
from tapeloom.operators import views as V
from tapeloom.plans import cohorts, studies
from tapeloom.plans.inputs import PROGRAMS_SQL, SCORED_SQL, SUMMARIES_SQL, ascii_sql, events, programs, scored, summaries
from tapeloom.plans.scalars import _ACT, _LINES, _WORDS, _clause_sql
from tapeloom.plans.sequences import _MOTIFS, ORDER, _bucket, tape_pairs
from tapeloom.plans.sqlparts import signed_ranks, student_two_sided
from tapeloom.shared import table, written

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


def _means_sql(rows: str, metric: str, fields: list[str], keys: str = "") -> str:
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(f"SELECT {head}'{metric}' AS metric, '{f}' AS field, round(avg(CAST({f} AS DOUBLE)), 9) AS mean, count({f}) AS n FROM {rows}{group}" for f in fields)


# summaries of metrics
_WITHIN = """(SELECT a = b AS within_0, abs(a - b) <= 1 AS within_1, abs(a - b) <= 2 AS within_2 FROM (SELECT arg_min(from_line_0idx, (ordinal_in_interval_1idx, event_id)) AS a,
   arg_max(from_line_0idx, (ordinal_in_interval_1idx, event_id)) AS b FROM change_micro_event WHERE from_line_0idx IS NOT NULL GROUP BY log_id, submit_index_0idx))"""


@query(_means_sql(_WITHIN, "first_change_line", ["within_0", "within_1", "within_2"]))
def m53_first_line_summary(spark: SparkSession, root: str) -> DataFrame:
    """Rates of the first changed line within tolerances, nulls left out."""
    return V.field_means(studies.l07_j47_tolerance_metric(spark, root), "first_change_line", ["within_0", "within_1", "within_2"]).withColumn("mean", _r("mean"))


_TUPLES = f"(SELECT t = nxt AS same_all, split_part(t, '|', 1) = split_part(nxt, '|', 1) AS same_edit, split_part(t, '|', 2) = split_part(nxt, '|', 2) AS same_run FROM (SELECT t, lead(t) OVER (PARTITION BY log_id ORDER BY interval_idx) AS nxt FROM (SELECT log_id, interval_idx, {_bucket('edit', 'change')} || '|' || {_bucket('run', 'saida_testar')} AS t FROM {_MOTIFS})) WHERE nxt IS NOT NULL)"


@query(_means_sql(_TUPLES, "event_count_buckets", ["same_all", "same_edit", "same_run"]))
def m54_bucket_summary(spark: SparkSession, root: str) -> DataFrame:
    """How often a tape's count buckets are those of the next one."""
    part = lambda c, k: F.get(F.split(c, r"\|"), k)
    p = tape_pairs(spark, root).select(S.count_tuple(F.col("a")).alias("x"), S.count_tuple(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    rows = p.select((x == y).alias("same_all"), (part(x, 0) == part(y, 0)).alias("same_edit"), (part(x, 1) == part(y, 1)).alias("same_run"))
    return V.field_means(rows, "event_count_buckets", ["same_all", "same_edit", "same_run"]).withColumn("mean", _r("mean"))


_NEXT_MOTIF = f"(SELECT motif AS predicted, lead(motif) OVER (PARTITION BY log_id ORDER BY interval_idx) AS observed FROM {_MOTIFS})"


@query(f"""SELECT 'match_rate' AS part, CAST(NULL AS VARCHAR) AS motif, count(*) AS n, round(avg(CASE WHEN predicted = observed THEN 1 ELSE 0 END), 9) AS value FROM {_NEXT_MOTIF} WHERE observed IS NOT NULL
   UNION ALL SELECT 'observed', observed, count(*), NULL FROM {_NEXT_MOTIF} WHERE observed IS NOT NULL GROUP BY observed UNION ALL SELECT 'predicted', predicted, count(*), NULL FROM {_NEXT_MOTIF} WHERE observed IS NOT NULL GROUP BY predicted""")
def m55_motif_summary(spark: SparkSession, root: str) -> DataFrame:
    """Match rate of the motif before as a prediction, with the histograms of both sides."""
    p = tape_pairs(spark, root).select(S.motif(F.col("a")).alias("predicted"), S.motif(F.col("b")).alias("observed"))
    rate = p.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("observed")).cast("double")).alias("value"))
    side = lambda c: p.groupBy(F.col(c).alias("motif")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("part"), "motif", "n", F.lit(None).cast("double").alias("value"))
    head = rate.select(F.lit("match_rate").alias("part"), F.lit(None).cast("string").alias("motif"), "n", _r("value").alias("value"))
    return head.unionByName(side("observed")).unionByName(side("predicted"))


@query(f"SELECT log_id, interval_idx, len(string_split(motif, '->')) AS n_parts FROM {_MOTIFS}")
def m61_motif_lengths(spark: SparkSession, root: str) -> DataFrame:
    """Number of parts of each interval's motif."""
    m = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind")
    return m.select("log_id", "interval_idx", F.size(F.split("motif", "->")).cast("bigint").alias("n_parts"))


# what summaries say
_SAID = f"""(SELECT s.custom_id, s.run_condition, s.summary, {_LINES.replace('summary', 's.summary')} AS lines, CAST(len(string_split(p.code_n, chr(10))) % 12 AS BIGINT) AS observed, CASE WHEN length(s.custom_id) % 2 = 0 THEN ['change', 'submit'] ELSE ['saida_testar'] END AS kinds,
   list_filter([{', '.join(f"CASE WHEN regexp_matches({ascii_sql('s.summary')}, '{p}', 'i') THEN '{k}' END" for k, p in _ACT.items())}], lambda x: x IS NOT NULL) AS actions FROM {SUMMARIES_SQL} s JOIN {PROGRAMS_SQL} p ON p.custom_id = s.custom_id WHERE p.code_n IS NOT NULL)"""
_HIT = f"(SELECT *, CASE WHEN len(lines) > 0 THEN CASE WHEN len(list_filter(lines, lambda l: abs(l - observed) <= 2)) > 0 THEN 1.0 ELSE 0.0 END END AS hit, CASE WHEN len(actions) > 0 THEN len(list_intersect(actions, kinds)) / len(actions) END AS alignment FROM {_SAID})"


def _said(spark: SparkSession, root: str) -> DataFrame:
    """Summaries with what they say, next to an observed line (made from the program) and observed kinds (from the id)."""
    p = programs(spark, root).where("code_n IS NOT NULL").select("custom_id", (F.size(F.split("code_n", "\n", -1)) % 12).alias("observed"))
    s = summaries(spark, root).join(p, "custom_id")
    kinds = F.when(F.length("custom_id") % 2 == 0, F.array(F.lit("change"), F.lit("submit"))).otherwise(F.array(F.lit("saida_testar")))
    s = s.withColumns({"lines": W.line_mentions(F.col("summary")), "actions": W.action_kinds(F.col("summary")), "kinds": kinds})
    return s.withColumns({"hit": W.line_hit(F.col("lines"), F.col("observed")), "alignment": W.action_alignment(F.col("actions"), F.col("kinds"))})


def _paired_sql(value: str) -> str:
    return f"(SELECT 0 AS g, a.{value} - b.{value} AS delta FROM {_HIT} a JOIN {_HIT} b ON a.custom_id = b.custom_id WHERE a.run_condition = 'full_trace' AND b.run_condition = 'no_trace' AND a.{value} - b.{value} IS NOT NULL)"


def _paired_test(rows: DataFrame, value: str) -> DataFrame:
    """Signed-rank test of full against no trace over the ids that have the value in both."""
    from tapeloom.operators.peers import paired

    side = lambda c: rows.where(F.col("run_condition") == c)
    d = paired(side("full_trace"), side("no_trace"), ["custom_id"], value).where("delta IS NOT NULL").withColumn("g", F.lit(0))
    return N.wilcoxon(d, ["g"], "delta").select("n", _r("w_plus", 6).alias("w_plus"), _r("p", 7).alias("p"))


@query(f"SELECT run_condition, count(*) AS n, round(avg(CASE WHEN len(lines) > 0 THEN 1 ELSE 0 END), 9) AS mention_rate, round(avg(hit), 9) AS hit_rate, round(avg(CASE WHEN len(actions) > 0 THEN 1 ELSE 0 END), 9) AS extraction_rate, round(avg(alignment), 9) AS mean_alignment FROM {_HIT} GROUP BY run_condition")
def m56_m58_said_and_done(spark: SparkSession, root: str) -> DataFrame:
    """Rates of lines named and hit, of actions named and observed, per condition."""
    any_ = lambda c: F.avg((F.size(c) > 0).cast("double"))
    return _said(spark, root).groupBy("run_condition").agg(
        F.count(F.lit(1)).alias("n"), _r(any_("lines")).alias("mention_rate"), _r(F.avg("hit")).alias("hit_rate"), _r(any_("actions")).alias("extraction_rate"), _r(F.avg("alignment")).alias("mean_alignment"))


@query(f"SELECT 'hit' AS value, n, w_plus, p FROM {signed_ranks(_paired_sql('hit'), 'g')} UNION ALL SELECT 'alignment', n, w_plus, p FROM {signed_ranks(_paired_sql('alignment'), 'g')}")
def m56_m58_paired_tests(spark: SparkSession, root: str) -> DataFrame:
    """Paired tests of line hits and action alignment between two conditions."""
    s = written(_said(spark, root).select("custom_id", "run_condition", "hit", "alignment"), "said")
    return _paired_test(s, "hit").withColumn("value", F.lit("hit")).unionByName(_paired_test(s, "alignment").withColumn("value", F.lit("alignment")))


_SPEC = f"""(SELECT s.run_condition, unnest(['words', 'lines', 'actions', 'numbers']) AS feature, unnest([len({_WORDS.replace('summary', 's.summary')}), len(lines), len(actions), len(regexp_extract_all({ascii_sql('s.summary')}, '[0-9]+'))]) AS x,
   (c.top_1_score + c.expected_score) / 2 AS y FROM {_HIT} s JOIN {SCORED_SQL} c ON c.custom_id = s.custom_id AND c.run_condition = s.run_condition)"""
_RANKED = f"(SELECT run_condition, feature, rank() OVER (PARTITION BY run_condition, feature ORDER BY x) + (count(*) OVER (PARTITION BY run_condition, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY run_condition, feature ORDER BY y) + (count(*) OVER (PARTITION BY run_condition, feature, y) - 1) / 2 AS ry FROM {_SPEC} WHERE y IS NOT NULL)"
_RHO = f"(SELECT run_condition, feature, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM {_RANKED} GROUP BY ALL)"


@query(f"SELECT run_condition, feature, n, round(rho, 9) AS rho, CASE WHEN rho IS NOT NULL AND n >= 3 THEN round({student_two_sided('t', 'df')}, 7) END AS p FROM (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM {_RHO})")
def m57_m59_length_and_specificity(spark: SparkSession, root: str) -> DataFrame:
    """Rank correlations of a summary's length and of what it names with the mean of two scores."""
    s = _said(spark, root)
    c = scored(spark, root).select("custom_id", "run_condition", ((F.col("top_1_score") + F.col("expected_score")) / 2).alias("y"))
    counts = {"words": F.size(W.word_list(F.col("summary"))), "lines": F.size("lines"), "actions": F.size("actions"), "numbers": F.regexp_count("summary", F.lit(r"\p{Nd}+"))}
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), x.cast("double").alias("x")) for k, x in counts.items()]))
    rows = s.join(c, ["custom_id", "run_condition"]).select("run_condition", "y", long.alias("f")).select("run_condition", "y", "f.*")
    return N.spearman(rows, ["run_condition", "feature"], "x", "y").select("run_condition", "feature", "n", _r("rho").alias("rho"), _r("p", 7).alias("p"))


_ALPHA = f"(SELECT run_condition, CAST(len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\\p{{L}}+$'))) AS DOUBLE) AS n_words FROM {SUMMARIES_SQL})"


@query(f"""WITH l AS (SELECT run_condition, avg(n_words) AS mean, median(n_words) AS median, stddev_pop(n_words) AS sd, min(n_words) AS low, max(n_words) AS high, quantile_cont(n_words, 0.9) AS p90 FROM {_ALPHA} GROUP BY 1)
   SELECT x.stat, round(x.a, 9) AS full_trace, round(x.b, 9) AS no_trace, round(x.a - x.b, 9) + 0.0 AS delta, x.a > x.b AS longer FROM (SELECT unnest(['mean', 'median', 'sd', 'low', 'high', 'p90']) AS stat, unnest([f.mean, f.median, f.sd, f.low, f.high, f.p90]) AS a, unnest([n.mean, n.median, n.sd, n.low, n.high, n.p90]) AS b
   FROM (SELECT * FROM l WHERE run_condition = 'full_trace') f, (SELECT * FROM l WHERE run_condition = 'no_trace') n) x""")
def m63_m64_lengths(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of alphabetic words of two conditions side by side."""
    n = F.size(F.filter(W.word_list(F.col("summary")), lambda w: w.rlike(r"^\p{L}+$"))).cast("double")
    s = summaries(spark, root).select("run_condition", n.alias("n"))
    q = lambda f: F.struct(*[x.alias(k) for k, x in (("stat", F.lit(f[0])), ("v", f[1]))])
    stats = [("mean", F.avg("n")), ("median", F.median("n")), ("sd", F.stddev_pop("n")), ("low", F.min("n")), ("high", F.max("n")), ("p90", F.percentile("n", 0.9))]
    long = s.groupBy("run_condition").agg(F.array(*map(q, stats)).alias("x")).select("run_condition", F.explode("x").alias("x")).select("run_condition", "x.*")
    both = long.groupBy("stat").pivot("run_condition", ["full_trace", "no_trace"]).agg(F.first("v"))
    a, b = F.col("full_trace"), F.col("no_trace")
    return both.select("stat", _r(a).alias("full_trace"), _r(b).alias("no_trace"), (_r(a - b) + F.lit(0.0)).alias("delta"), (a > b).alias("longer"))


@query(f"""WITH {cohorts._TFIDF}, q AS (SELECT split_part(a, '/', 2) AS c, s FROM (SELECT a, b, s FROM pr UNION ALL SELECT b, a, s FROM pr) WHERE CAST('0x' || substr(md5(a), 1, 6) AS BIGINT) % 50 = 0 AND split_part(a, '/', 2) = split_part(b, '/', 2))
   SELECT count(s) FILTER (c = 'full_trace') AS n_full, count(s) FILTER (c = 'no_trace') AS n_none, round(avg(s) FILTER (c = 'full_trace') - avg(s) FILTER (c = 'no_trace'), 7) AS mean_delta, round(median(s) FILTER (c = 'full_trace') - median(s) FILTER (c = 'no_trace'), 7) AS median_delta, round(stddev_pop(s) FILTER (c = 'full_trace') - stddev_pop(s) FILTER (c = 'no_trace'), 7) AS sd_delta FROM q""")
def m62_similarity_deltas(spark: SparkSession, root: str) -> DataFrame:
    """Similarities within each condition of a fiftieth of its texts with all, and how the conditions differ."""
    side = F.get(F.split("doc", "/"), 1)
    w = P.word_lists(cohorts._docs(spark, root).withColumn("c", side), ["c"], "doc", "summary").where("c IN ('full_trace', 'no_trace')")
    s = P.similarity_statistics(cohorts.a_fiftieth(w), w, ["c"])
    pick = lambda c, v: F.max(F.when(F.col("c") == c, F.col(v)))
    delta = lambda v: _r(pick("full_trace", v) - pick("no_trace", v), 7)
    n = lambda c: F.coalesce(pick(c, "n"), F.lit(0)).cast("bigint")
    return s.agg(n("full_trace").alias("n_full"), n("no_trace").alias("n_none"), delta("mean").alias("mean_delta"), delta("median").alias("median_delta"), delta("sd").alias("sd_delta"))


_KINDS = [*W.CLAUSE_WORDS, "other"]
_CLAUSES = f"(SELECT k.custom_id, k.run_condition, unnest({_KINDS}) AS kind, unnest([{', '.join(f'n_{k}' for k in _KINDS)}]) AS n FROM ({_clause_sql()}) k)"
_CPAIRS = f"(SELECT a.kind, a.n AS x, b.n AS y, CAST(a.n - b.n AS DOUBLE) AS delta FROM {_CLAUSES} a JOIN {_CLAUSES} b ON a.custom_id = b.custom_id AND a.kind = b.kind WHERE a.run_condition = 'full_trace' AND b.run_condition = 'no_trace')"


@query(f"""SELECT m.*, coalesce(t.p, 1.0) AS p FROM (SELECT kind, count(*) AS n_pairs, round(avg(x), 9) AS mean_full, round(avg(y), 9) AS mean_none, round(avg(delta), 9) + 0.0 AS mean_delta, round(median(delta), 9) + 0.0 AS median_delta FROM {_CPAIRS} GROUP BY kind) m LEFT JOIN {signed_ranks(_CPAIRS, 'kind')} t USING (kind)""")
def g38_paired_structure(spark: SparkSession, root: str) -> DataFrame:
    """Clauses of each kind in the summaries of two conditions, pair by pair, with a signed-rank test."""
    s = summaries(spark, root).select("custom_id", "run_condition", W.clause_counts(F.col("summary")).alias("c"))
    long = s.select("custom_id", "run_condition", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"c.{k}").alias("n")) for k in _KINDS])).alias("k")).select("custom_id", "run_condition", "k.*")
    side = lambda c, n: long.where(F.col("run_condition") == c).select("custom_id", "kind", F.col("n").alias(n))
    p = written(side("full_trace", "x").join(side("no_trace", "y"), ["custom_id", "kind"]).withColumn("delta", (F.col("x") - F.col("y")).cast("double")), "pairs")
    means = p.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_pairs"), _r(F.avg("x")).alias("mean_full"), _r(F.avg("y")).alias("mean_none"), (_r(F.avg("delta")) + F.lit(0.0)).alias("mean_delta"), (_r(F.median("delta")) + F.lit(0.0)).alias("median_delta"))
    return means.join(N.wilcoxon(p, ["kind"], "delta").select("kind", _r("p", 7).alias("p")), "kind", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))


_TABLES = f"""SELECT 'shared_ngrams' AS analysis, 'mean_share' AS item, round(avg(share), 7) AS value FROM ({cohorts.ORACLE['g37_ngram_overlap']}) UNION ALL SELECT 'templates', exercise_id, count(*) FROM ({cohorts.ORACLE['g40_j62_templates']}) GROUP BY exercise_id
   UNION ALL SELECT 'opening_entropy', run_condition, round(entropy, 7) FROM ({cohorts.ORACLE['g41_opening_entropy']}) UNION ALL SELECT 'only_in_full', 'phrases', count(*) FROM ({cohorts.ORACLE['g42_only_in_full']})
   UNION ALL SELECT 'terms_per_1000', run_condition || '/' || family, round(per_1000, 7) FROM ({cohorts.ORACLE['g43_g39_term_rates']}) UNION ALL SELECT 'clauses', kind, round(mean_delta, 7) + 0.0 FROM ({ORACLE['g38_paired_structure']})"""


@query(_TABLES)
def m75_study_tables(spark: SparkSession, root: str) -> DataFrame:
    """Six analyses of two conditions' summaries as one table."""
    one = lambda rows, name, item, value: rows.select(F.lit(name).alias("analysis"), item.alias("item"), value.cast("double").alias("value"))
    count = F.count(F.lit(1)).alias("n")
    parts = [
        one(cohorts.g37_ngram_overlap(spark, root).agg(F.avg("share").alias("m")), "shared_ngrams", F.lit("mean_share"), _r("m", 7)),
        one(cohorts.g40_j62_templates(spark, root).groupBy("exercise_id").agg(count), "templates", F.col("exercise_id"), F.col("n")),
        one(cohorts.g41_opening_entropy(spark, root), "opening_entropy", F.col("run_condition"), _r("entropy", 7)),
        one(cohorts.g42_only_in_full(spark, root).agg(count), "only_in_full", F.lit("phrases"), F.col("n")),
        one(cohorts.g43_g39_term_rates(spark, root), "terms_per_1000", F.concat_ws("/", "run_condition", "family"), _r("per_1000", 7)),
        one(g38_paired_structure(spark, root), "clauses", F.col("kind"), _r("mean_delta", 7) + F.lit(0.0)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""SELECT s.custom_id, s.run_condition, s.top_1_score, length(m.summary) AS n_chars, v.total_attempt_count, array_to_string(list_transform(v.attempt_n_pass_fail_vector, lambda x: CASE WHEN x THEN 'P' ELSE 'F' END), '') = s.signature AS consistent
   FROM {SCORED_SQL} s JOIN {SUMMARIES_SQL} m ON m.custom_id = s.custom_id AND m.run_condition = s.run_condition JOIN validated_candidate v ON v.custom_id = s.custom_id""")
def d20_condition_records(spark: SparkSession, root: str) -> DataFrame:
    """Predictions, summaries and evaluated candidates in one row each, with the check that they speak of one state."""
    from tapeloom.functions.code import pass_signature

    s = scored(spark, root).select("custom_id", "run_condition", "top_1_score", "signature")
    m = summaries(spark, root).select("custom_id", "run_condition", F.length("summary").alias("n_chars"))
    v = table(spark, root, "validated_candidate").select("custom_id", "total_attempt_count", pass_signature(F.col("attempt_n_pass_fail_vector")).alias("sig"))
    return s.join(m, ["custom_id", "run_condition"]).join(v, "custom_id").select("custom_id", "run_condition", "top_1_score", "n_chars", "total_attempt_count", (F.col("sig") == F.col("signature")).alias("consistent"))


@query(f"WITH {cohorts._TFIDF} SELECT doc, len(list(token)) AS n_tokens, arg_max(token, (round(w, 9), token)) AS top_token, round(max(w), 9) AS top_weight FROM v GROUP BY doc")
def m65_weight_maps(spark: SparkSession, root: str) -> DataFrame:
    """Each text's weights as a map, and its heaviest token."""
    m = P.weight_maps(P.weights(cohorts._docs(spark, root), ["doc"], "summary"), ["doc"])
    entry = F.transform(F.map_entries("weights"), lambda e: F.struct(F.round(e["value"], 9).alias("w"), e["key"].alias("t")))
    top = F.array_max(entry)
    return m.select("doc", F.size("weights").cast("bigint").alias("n_tokens"), top["t"].alias("top_token"), top["w"].alias("top_weight"))


@query(f"""SELECT custom_id, run_condition, k AS metric, round(v, 9) AS value FROM (SELECT custom_id, run_condition, unnest(['scores.top_1', 'scores.expected', 'tests.n', 'tests.passed']) AS k, unnest([top_1_score, expected_score, CAST(len(attempt_n_pass_fail_vector) AS DOUBLE), CAST(len(list_filter(attempt_n_pass_fail_vector, lambda x: x)) AS DOUBLE)]) AS v FROM {SCORED_SQL}) WHERE v IS NOT NULL""")
def m50_flat_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Nested metrics of a row as named numbers, nulls left out."""
    v = F.col("attempt_n_pass_fail_vector")
    s = scored(spark, root).select("custom_id", "run_condition", F.struct(F.col("top_1_score").alias("top_1"), F.col("expected_score").alias("expected")).alias("scores"),
                                   F.when(v.isNotNull(), F.struct(F.size(v).cast("double").alias("n"), F.size(F.filter(v, lambda x: x)).cast("double").alias("passed"))).alias("tests"))
    names = ["scores.top_1", "scores.expected", "tests.n", "tests.passed"]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    return s.select("custom_id", "run_condition", long.alias("x")).select("custom_id", "run_condition", "x.metric", _r("x.value").alias("value")).where("value IS NOT NULL")
