"""Queries on logs and edits made of the table's programs, so that what must come out follows from how they were made:
replay, alignment, transitions, diffs and scores, which SQL has no form of (survey A26, C27, E, F, J10-J38, K, M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import code as C
from tapeloom.functions import diff as D
from tapeloom.operators import intervals as I
from tapeloom.operators import peers as P
from tapeloom.operators import replay as R
from tapeloom.operators import score as S
from tapeloom.operators import transitions as T
from tapeloom.operators.contracts import step_problem
from tapeloom.plans.inputs import PROGRAMS_SQL, programs
from tapeloom.plans.scalars import blank_sql, token_sql
from tapeloom.shared import written

QUERIES = {}
ORACLE = {}
KEYS = ["log_id"]
ORDER = ["ts", "line_number", "event_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _narrow_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), '(?m)[ \\t]+$', '', 'g')"


_BOTH = f"(SELECT *, candidate_id AS id, code_n AS a, code_n1 AS b FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL)"


def _both(spark: SparkSession, root: str) -> DataFrame:
    p = programs(spark, root).where("code_n IS NOT NULL AND code_n1 IS NOT NULL")
    return p.select(F.col("candidate_id").alias("id"), F.col("code_n").alias("a"), F.col("code_n1").alias("b"), "vector", "class_id", "assessment_id", "exercise_id", "student_id")


# logs: a replacement of the whole program, a run for odd ids, and a submit for each snapshot. By id modulo 5 the snapshots are
# A A B (0), A (1), A and a longer A and B (3), else A B; attempts are A and B.
def _snapshots(id_: Column, a: Column, b: Column) -> Column:
    longer = F.concat(a, F.lit("\n#more"))
    return (
        F.when(id_ % 5 == 0, F.array(a, a, b)).when(id_ % 5 == 1, F.array(a)).when(id_ % 5 == 3, F.array(a, longer, b)).otherwise(F.array(a, b))
    )


_SNAPS = "(CASE WHEN id % 5 = 0 THEN [a, a, b] WHEN id % 5 = 1 THEN [a] WHEN id % 5 = 3 THEN [a, a || chr(10) || '#more', b] ELSE [a, b] END)"


def known_events(rows: DataFrame) -> DataFrame:
    """(event_id, log_id, ts, line_number, kind, payload) of the logs; a change that can't be applied comes before the last one of ids divisible by 4."""
    s = rows.select("id", _snapshots(F.col("id"), F.col("a"), F.col("b")).alias("s"))
    s = s.select("id", F.posexplode("s").alias("k", "code"), F.col("s"))
    before = F.when(F.col("k") > 0, F.get("s", F.col("k") - 1)).otherwise("")
    lines, last = F.split("code", "\n", -1), F.split(before, "\n", -1)
    at = lambda line, ch: F.struct(line.alias("line"), ch.alias("ch"))
    end = at(F.size(last) - 1, F.length(F.element_at(last, -1)))
    edit = F.to_json(F.struct(at(F.lit(0), F.lit(0)).alias("from"), end.alias("to"), lines.alias("text")))
    bad = F.lit('{"from":{"line":1000000,"ch":0},"to":{"line":1000000,"ch":0},"text":["x"]}')
    event = lambda kind, payload, when: F.when(when, F.struct(F.lit(kind).alias("kind"), payload.alias("payload")))
    none, yes = F.lit(None).cast("string"), F.lit(True)
    rejected = (F.col("id") % 4 == 0) & (F.col("k") == F.size("s") - 1)
    every = F.array_compact(F.array(event("change", bad, rejected), event("change", edit, yes), event("saida_testar", none, F.col("id") % 2 == 1), event("submit", none, yes)))
    e = s.select("id", "k", F.posexplode(every).alias("j", "e"))
    n = (F.col("k") * 10 + F.col("j")).cast("bigint")
    return e.select(
        (F.col("id") * 1000 + n).alias("event_id"), F.col("id").alias("log_id"), F.timestamp_seconds(1_700_000_000 + n).alias("ts"), n.alias("line_number"), "e.kind", "e.payload"
    )


def known_attempts(rows: DataFrame) -> DataFrame:
    """(log_id, attempt, code, vector): A with its vector, B with it reversed or, for ids divisible by 3, all passed."""
    v = F.when(F.col("id") % 3 == 0, F.transform("vector", lambda x: F.lit(True))).otherwise(F.reverse("vector"))
    both = F.array(F.struct(F.lit(0).alias("attempt"), F.col("a").alias("code"), F.col("vector")), F.struct(F.lit(1).alias("attempt"), F.col("b").alias("code"), v.alias("vector")))
    return rows.select(F.col("id").alias("log_id"), F.explode(both).alias("x")).select("log_id", "x.*")


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return R.replayed_blocks(known_events(_both(spark, root)), ORDER)


# the span of lines that differ: common start and end left out
_HEAD = "len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i]))"
_TAIL = "len(list_filter(range(1, least(len(x), len(y)) - head + 1), lambda i: x[len(x) - i + 1:] = y[len(y) - i + 1:]))"
_KNOWN = f"""(SELECT *, CASE WHEN was = code THEN '[]' ELSE '[{{"action":"edit","start":' || CASE WHEN head <= len(y) - 1 - tail THEN head ELSE least(head, len(y) - 1) END || ',"end":' || CASE WHEN head <= len(y) - 1 - tail THEN len(y) - 1 - tail ELSE least(head, len(y) - 1) END
     || '}},' || CASE WHEN id % 2 = 1 THEN '{{"action":"local_run"}},' ELSE '' END || '{{"action":"submit"}}]' END AS steps FROM (SELECT *, {_TAIL} AS tail FROM (SELECT *, {_HEAD} AS head FROM (
   SELECT id, k, n, code, was, string_split(was, chr(10)) AS x, string_split(code, chr(10)) AS y FROM (SELECT id, k, n, s[k + 1] AS code, CASE WHEN k = 0 THEN '' ELSE s[k] END AS was FROM (SELECT id, {_SNAPS} AS s, len({_SNAPS}) AS n, unnest(range(0, len({_SNAPS}))) AS k FROM {_BOTH}))))))"""


@query(f"""SELECT id AS log_id, CAST(k AS INTEGER) AS submit_index, was AS start_code, code, 1 AS n_changes, CAST(id % 2 AS INTEGER) AS n_runs, CASE WHEN id % 4 = 0 AND k = n - 1 THEN 1 ELSE 0 END AS n_rejected, 0 AS first_line,
   CASE WHEN id % 4 = 0 AND k = n - 1 THEN 'line_out_of_bounds' END AS first_reason, length(code) AS chars_in, length(was) AS chars_out, steps, CASE WHEN was = code THEN 'no_net_change' END AS steps_reason, CASE WHEN was = code THEN 'empty' END AS problem FROM {_KNOWN}""")
def f01_f05_known_replay(spark: SparkSession, root: str) -> DataFrame:
    """Replay of logs whose snapshots are known: programs, counts, rejected changes, coarse steps and their contract
    (F01-F05, J30-J32, K03, K04, K10, M19, M23)."""
    b = _blocks(spark, root).withColumn("problem", step_problem(F.col("steps"), None, None))
    return b.withColumn("steps", F.to_json("steps")).drop("submit_ts")


_STATUS = f"""(SELECT *, CASE WHEN id % 5 = 0 THEN 'ambiguous' WHEN id % 5 = 1 THEN 'no_match' ELSE 'matched' END AS status, {_narrow_sql('a')} = {_narrow_sql('b')} AS same,
   CASE WHEN id % 5 NOT IN (0, 1) THEN CASE WHEN id % 5 = 3 THEN 2 ELSE 1 END END AS n1 FROM {_BOTH})"""
_TABLE = f"""(SELECT *, CASE WHEN id % 5 IN (0, 1) THEN 'not_aligned' WHEN id % 5 = 3 THEN 'not_immediate' WHEN a = b THEN 'not_edited' END AS reason FROM {_STATUS})"""


def _table(spark: SparkSession, root: str, mode: str = "narrow") -> DataFrame:
    rows = _both(spark, root)
    return T.transition_table(known_attempts(rows), written(_blocks(spark, root), "blocks"), KEYS, mode)


_COLUMNS = "id AS log_id, 0 AS attempt, status, CASE WHEN n1 IS NOT NULL THEN 0 END AS snap_n, n1 AS snap_n1, id % 5 NOT IN (0, 1) AS is_aligned, id % 5 IN (2, 4) AS is_immediate, id % 5 NOT IN (0, 1) AND (id % 5 = 3 OR a <> b) AS is_edited, reason"


@query(f"SELECT {_COLUMNS} FROM {_TABLE}")
def m01_m02_transition_table(spark: SparkSession, root: str) -> DataFrame:
    """One row per transition with its alignment and the stage at which it fails."""
    return _table(spark, root).select("log_id", "attempt", "status", "snap_n", "snap_n1", "is_aligned", "is_immediate", "is_edited", "reason")


@query(f"SELECT id AS log_id, n1 AS snap_n1, a AS code_n, b AS code_n1 FROM {_TABLE} WHERE reason IS NULL")
def e11_admissible_rows(spark: SparkSession, root: str) -> DataFrame:
    """Transitions whose next attempt is the immediate, unique next snapshot, reached by a real edit."""
    return T.admissible(_table(spark, root)).select("log_id", "snap_n1", "code_n", "code_n1")


_EXACT = f"(SELECT *, CASE WHEN id % 5 IN (0, 1) THEN 'aligned' WHEN id % 5 = 3 THEN 'immediate' WHEN a = b THEN 'edited' END AS failed FROM {_BOTH})"


@query(f"""WITH s AS (SELECT unnest(['attempts', 'replayed', 'aligned', 'immediate', 'edited', 'path']) AS stage, unnest(range(0, 6)) AS i), r AS (SELECT *, coalesce(CASE failed WHEN 'aligned' THEN 2 WHEN 'immediate' THEN 3 WHEN 'edited' THEN 4 END, 9) AS place FROM {_EXACT})
   SELECT stage, count(*) FILTER (place > i) AS n_passed, round(avg(CASE WHEN place > i THEN 1 ELSE 0 END), 9) AS share, count(*) FILTER (place = i) AS n_failed_here,
     coalesce(list_sort(list(id || ':0') FILTER (place = i))[1:10], []) AS examples FROM s, r GROUP BY stage, i""")
def m36_m37_stage_audit(spark: SparkSession, root: str) -> DataFrame:
    """How many transitions pass each stage, compared letter for letter, with examples of those that fail."""
    return T.stage_report(_table(spark, root, "exact"), KEYS).withColumn("share", F.round("share", 9))


_NEXT = f"(SELECT *, CASE WHEN id % 3 = 0 THEN list_transform(vector, lambda x: true) ELSE list_reverse(vector) END AS w FROM {_TABLE})"
_PASS = "len(list_filter({}, lambda x: x))"
_FAILED = "list_filter(list_transform({}, lambda x, i: CASE WHEN NOT x THEN CAST(i - 1 AS INTEGER) END), lambda y: y IS NOT NULL)"


@query(f"""SELECT id AS log_id, 0 AS attempt, CASE WHEN list_bool_and(w) THEN 'solved' WHEN {_PASS.format('w')} > {_PASS.format('vector')} THEN 'partial_fix' WHEN {_PASS.format('w')} = {_PASS.format('vector')} THEN 'no_improvement' ELSE 'regressed' END AS outcome,
   CASE WHEN NOT list_bool_or(w) THEN 'all_fail' WHEN list_bool_and(w) THEN 'all_pass' ELSE 'mixed' END AS next_outcome, {_PASS.format('vector')} AS n_passed, {_PASS.format('w')} AS n_passed_next, {_FAILED.format('vector')} AS failed, {_FAILED.format('w')} AS failed_next FROM {_NEXT} WHERE vector IS NOT NULL AND len(vector) > 0""")
def m10_observed_labels(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes, passes and failed tests of each transition."""
    done = T.observed_labels(_table(spark, root).where("size(vector_n) > 0"), KEYS)
    return done.select("log_id", "attempt", "outcome", "next_outcome", F.col("n_passed").cast("bigint").alias("n_passed"), F.col("n_passed_next").cast("bigint").alias("n_passed_next"), "failed", "failed_next")


@query(f"""SELECT id AS log_id, n1 AS snap_n1, CASE WHEN n1 IS NULL THEN 'no_block' WHEN was = code THEN 'no_net_change' END AS problem, CASE WHEN n1 IS NOT NULL THEN k.steps END AS steps
   FROM {_TABLE} t LEFT JOIN (SELECT id AS kid, k, was, code, steps FROM {_KNOWN}) k ON k.kid = t.id AND k.k = t.n1""")
def m40_m43_path_audit(spark: SparkSession, root: str) -> DataFrame:
    """The coarse path of each transition's block, or why there is none."""
    p = T.path_artifacts(_table(spark, root), KEYS)
    return p.select("log_id", "snap_n1", "problem", F.to_json("steps").alias("steps"))


@query(f"SELECT id AS log_id, 0 AS attempt, a AS code_n, b AS code_n1, a = b AS unchanged FROM {_TABLE} WHERE vector IS NOT NULL")
def m41_repair_targets(spark: SparkSession, root: str) -> DataFrame:
    """The target of each transition: programs, outcome, changed spans; none where nothing changed."""
    t = T.repair_targets(_table(spark, root).where("vector_n IS NOT NULL"), KEYS)
    return t.select("log_id", "attempt", "target.code_n", "target.code_n1", (F.size("target.spans") == 0).alias("unchanged"))


def _tapes(spark: SparkSession, root: str) -> DataFrame:
    e = I.islands(known_events(_both(spark, root)), KEYS, ORDER, F.col("kind") == "submit")
    return T.semantic_tapes(e, KEYS, "interval_idx", "pos_in_interval", "kind")


_LIST = "CASE WHEN rejected THEN ['change'] ELSE [] END || ['change'] || CASE WHEN id % 2 = 1 THEN ['saida_testar'] ELSE [] END || ['submit']"
_TAPES = f"(SELECT id AS log_id, k AS interval_idx, {_LIST} AS tape FROM (SELECT *, id % 4 = 0 AND k = n - 1 AS rejected FROM {_KNOWN}))"
_KIND = "len(list_filter(tape, lambda x: x = '{}'))"


@query(f"SELECT log_id, interval_idx, tape, len(tape) AS n_events, {_KIND.format('change')} AS n_change, {_KIND.format('saida_testar')} AS n_run, {_KIND.format('submit')} AS n_submit, {_KIND.format('saida_testar')} AS n_tests, CAST(NULL AS VARCHAR) AS problem FROM {_TAPES}")
def m12_m20_tape_payload(spark: SparkSession, root: str) -> DataFrame:
    """The tape of each interval with its counters, validated."""
    return _tapes(spark, root).select("log_id", "interval_idx", "tape", "n_events", "n_change", "n_run", "n_submit", "n_tests", "problem")


@query(f"SELECT id AS log_id, 0 AS attempt, tape, len(tape) AS n_events, {_KIND.format('change')} AS n_change FROM {_TABLE} t LEFT JOIN {_TAPES} p ON p.log_id = t.id AND p.interval_idx = t.n1")
def m11_next_episode(spark: SparkSession, root: str) -> DataFrame:
    """The observed tape of the attempt that follows."""
    t = T.next_episodes(_table(spark, root), _tapes(spark, root), KEYS)
    return t.select("log_id", "attempt", "tape", "n_events", "n_change")


def _payload_sql(condition: str) -> str:
    return f"""SELECT id AS log_id, '{condition}' AS condition, a AS code, CAST({_PASS.format('vector')} AS INTEGER) AS n_passed, {"NULL" if condition == "no_trace" else "CASE WHEN n1 IS NOT NULL THEN array_to_string(p.tape, ' ') END"} AS trace
       FROM {_TABLE} t LEFT JOIN {_TAPES} p ON p.log_id = t.id AND p.interval_idx = 0 WHERE vector IS NOT NULL"""


@query(_payload_sql("full") + " UNION ALL " + _payload_sql("no_trace"))
def m13_m15_payloads(spark: SparkSession, root: str) -> DataFrame:
    """What a reader may see of each transition under two conditions, written as JSON and read again."""
    table, tapes = _table(spark, root).where("vector_n IS NOT NULL"), _tapes(spark, root)
    parts = [T.payloads(table, tapes, KEYS, c).withColumn("condition", F.lit(c)) for c in ("full", "no_trace")]
    read = parts[0].unionByName(parts[1]).withColumn("p", F.from_json("payload", "history array<struct<attempt int, code string, n_passed int, trace string>>, tape string"))
    first = F.get("p.history", 0)
    return read.select("log_id", "condition", first["code"].alias("code"), first["n_passed"].alias("n_passed"), first["trace"].alias("trace"))


_SLICE = "class_id, assessment_id, exercise_id"
_LOGS = f"(SELECT id, {_SLICE}, student_id, len({_SNAPS}) AS n FROM {_BOTH} WHERE student_id IS NOT NULL)"


@query(f"""WITH l AS (SELECT {_SLICE}, id, n FROM {_LOGS} WHERE n >= 2), d AS (SELECT o.id AS target, (SELECT min(l.id) FROM l WHERE l.class_id = o.class_id AND l.assessment_id = o.assessment_id AND l.exercise_id = o.exercise_id AND l.id <> o.id) AS donor FROM {_LOGS} o)
   SELECT d.target, d.donor, t.interval_idx, p.tape FROM d JOIN {_TAPES} t ON t.log_id = d.target LEFT JOIN {_TAPES} p ON p.log_id = d.donor AND p.interval_idx = t.interval_idx WHERE d.donor IS NOT NULL""")
def m16_m18_donor_tapes(spark: SparkSession, root: str) -> DataFrame:
    """The tapes of a valid donor of the same slice, interval by interval."""
    rows = _both(spark, root).where("student_id IS NOT NULL")
    blocks = written(_blocks(spark, root), "blocks")
    good = T.valid_donors(T.contexts(known_attempts(rows), blocks, KEYS), blocks, KEYS, 2)
    slices = ["class_id", "assessment_id", "exercise_id"]
    logs = rows.select(*slices, F.col("id").alias("log_id"), F.lpad(F.col("id").cast("string"), 12, "0").alias("name"))
    chosen = P.donors(logs, logs.join(good, "log_id", "left_semi"), slices, "name", "log_id").where("donor IS NOT NULL")
    targets = chosen.select(F.col("log_id").alias("target"), F.col("donor").cast("bigint").alias("donor"))
    return T.donor_tapes(targets, _tapes(spark, root), "target", "donor")


# edits
_NB = f"(SELECT id, nb, string_split(nb, chr(10)) AS l, len({token_sql('nb')}) AS t, 'zz_changed_' || id AS new FROM (SELECT id, {blank_sql('a')} AS nb FROM {_BOTH}) WHERE nb <> '')"


def _edited(spark: SparkSession, root: str) -> DataFrame:
    """(id, before, new, front, last, end): programs with a new line before the first, for the last, and after the last."""
    p = _both(spark, root).select("id", C.without_blank_end(F.col("a")).alias("before"), F.concat(F.lit("zz_changed_"), F.col("id").cast("string")).alias("new")).where("before <> ''")
    cut = F.regexp_replace("before", r"[^\n]*\z", "")
    return p.select("*", F.concat_ws("\n", "new", "before").alias("front"), F.concat(cut, "new").alias("last"), F.concat_ws("\n", "before", "new").alias("end"))


@query(f"""SELECT id, 'front' AS kind, 0 AS start, 0 AS stop, '' AS removed, new AS added FROM {_NB} UNION ALL SELECT id, 'last', CAST(len(l) - 1 AS INTEGER), CAST(len(l) AS INTEGER), l[-1], new FROM {_NB}
   UNION ALL SELECT id, 'end', CAST(len(l) AS INTEGER), CAST(len(l) AS INTEGER), '', new FROM {_NB}""")
def j10_j12_known_hunks(spark: SparkSession, root: str) -> DataFrame:
    """The changed stretch of programs with one line put in or replaced."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("after")) for k in ("front", "last", "end")]))
    e = _edited(spark, root).select("id", "before", kinds.alias("e")).select("id", "e.kind", F.explode(D.hunks_udf("before", "e.after")).alias("h"))
    return e.select("id", "kind", "h.*")


_IOU = "(CASE len(l) WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 ELSE 0.0 END)"  # of the lines around 0 and around the end, one line to each side
_RATIO = "(2.0 * t / (2 * t + 1))"
_LEFT = "levenshtein(new || chr(10) || nb, nb || chr(10) || new)"
_BASE = "(length(new) + 1)"


def _expected(metrics: dict[str, tuple[str, str, str]]) -> str:
    rows = [f"('{m}', {h}, {v})" for m, vs in metrics.items() for h, v in enumerate(vs)]
    return f"SELECT id, metric, CAST(hyp AS INTEGER) AS hyp, round(CAST(value AS DOUBLE), 9) + 0.0 AS value FROM {_NB}, LATERAL (VALUES {', '.join(rows)}) v(metric, hyp, value)"


_FIT = f"CASE WHEN {_IOU} > 0 THEN 1 ELSE 0 END"
#: What the truth, a copy of the old program, and the right line at the wrong end must score.
_V2 = {
    **{f"strict_footprint_{k}": ("1", "0", "0") for k in ("precision", "recall", "f1")},
    **{f"windowed_footprint_{k}": ("1", "0", _IOU) for k in ("precision", "recall", "f1", "mean_iou")},
    **{f"aligned_content_{k}": ("1", "0", _FIT) for k in ("f1", "structural_f1", "identifier_f1")},
    "code_gain_over_copy_raw": ("1", "0", f"1 - {_LEFT} / {_BASE}"),
    "code_gain_over_copy_bounded": ("1", "0", f"({_BASE} - {_LEFT}) / greatest({_BASE}, {_LEFT})"),
    "trajectory_alignment_score": ("1", "0", _IOU), "edit_span_overlap": ("1", "0", _IOU), "edit_region_overlap_unordered": ("1", "0", _IOU),
    "local_run_presence_match": ("1", "1", "1"), "local_run_count_agreement": ("1", "1", "1"), "exact_next_code_match": ("1", "0", "0"),
    "structural_lift_over_copy": (f"1 - {_RATIO}", "0", f"t / (t + 1) - {_RATIO}"),
    "full_code_structural_similarity_diagnostic": ("1", _RATIO, "t / (t + 1)"), "worse_than_copy_rate": ("0", "0", f"CASE WHEN {_LEFT} > {_BASE} THEN 1 ELSE 0 END"),
}
_V1 = {
    **{f"repair_footprint_{k}": ("1", "0", "0") for k in ("precision", "recall", "f1")}, "repair_content_similarity": ("1", "0", "1"),
    "code_gain_over_copy": _V2["code_gain_over_copy_raw"], "trajectory_alignment_score": ("1", "0", "0"), "edit_span_overlap": ("1", "0", "0"),
    "local_run_presence_match": ("1", "1", "1"), "local_run_count_match": ("1", "1", "1"), "exact_next_code_match": ("1", "0", "0"),
    "full_code_structural_similarity": _V2["full_code_structural_similarity_diagnostic"], "worse_than_copy_rate": _V2["worse_than_copy_rate"],
}


def _known_scores(spark: SparkSession, root: str, version: str) -> DataFrame:
    n = F.size(F.split("before", "\n", -1))
    edit = lambda k: F.struct(F.lit("edit").alias("action"), k.cast("int").alias("start"), k.cast("int").alias("end"))
    submit = F.struct(F.lit("submit").alias("action"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    hyp = lambda p, code, steps: F.struct(F.lit(p).alias("p"), F.col(code).alias("code"), steps.alias("steps"))
    hyps = F.array(hyp(0.5, "end", F.array(edit(n), submit)), hyp(0.3, "before", F.array(submit)), hyp(0.2, "front", F.array(edit(F.lit(0)), submit)))
    rows = _edited(spark, root).select("id", F.col("before").alias("before_code"), F.col("end").alias("observed_code"), F.array(edit(n), submit).alias("observed_steps"), hyps.alias("hyps"))
    return S.scored_hypotheses(rows, ["id"], version).select("id", "metric", "hyp", (F.round("value", 9) + F.lit(0.0)).alias("value"))


@query(_expected(_V2))
def j13_j27_known_scores(spark: SparkSession, root: str) -> DataFrame:
    """All scores of the truth, of a copy and of a line put at the wrong end."""
    return _known_scores(spark, root, "v2")


@query(_expected(_V1))
def j28_known_scores_v1(spark: SparkSession, root: str) -> DataFrame:
    """The same by the first version's scores."""
    return _known_scores(spark, root, "v1")


_LOOPS = "contains(nb, 'while') OR contains(nb, 'for')"


@query(f"""SELECT id, '[{{"start":0,"end":0}}]' AS spans, 'changed_1_lines' || CASE WHEN {_LOOPS} THEN '' ELSE ' introduced_loop' END || CASE WHEN contains(nb, 'print(') THEN '' ELSE ' introduced_print' END AS delta,
   ['output_region', 'conditional_region', 'conditional_region', 'loop_region', 'loop_region', 'line_out_of_bounds'][id % 6 + 1] AS region FROM {_NB}""")
def j33_j38_known_edits(spark: SparkSession, root: str) -> DataFrame:
    """Changed spans and summary of programs with a new first line, and regions of a fixed program."""
    new = F.concat(F.lit("while zz_"), F.col("id").cast("string"), F.lit(": print(zz)"))
    e = _edited(spark, root).select("id", "before", F.concat_ws("\n", new, F.col("before")).alias("after"))
    fixed = F.lit("print(1)\nif a:\n    b = 1\nfor i in x:\n    pass")
    return e.select("id", F.to_json(D.repair_spans_udf("before", "after")).alias("spans"), D.delta_summary_udf("before", "after").alias("delta"), D.focus_region_udf(fixed, (F.col("id") % 6).cast("int")).alias("region"))
