"""Queries on programs and logs: diffs, scores, replay, alignment, parsers (survey A, B, C, E, F, J, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import diff as D
from tapeloom.operators import conditions as O
from tapeloom.operators import intervals as I
from tapeloom.operators import replay as R
from tapeloom.operators import score as S
from tapeloom.operators.contracts import step_problem
from tapeloom.plans.inputs import EVENTS_SQL, PROGRAMS_SQL, events, programs
from tapeloom.plans.scalars import blank_sql
from tapeloom.plans.sequences import _ISL, ORDER
from tapeloom.shared import stripped, table
from tapeloom.sources import documents as DOC
from tapeloom.sources import editor_log, execution_log
from tapeloom.streaming import tapes

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _both(spark: SparkSession, root: str) -> DataFrame:
    return programs(spark, root).where("code_n IS NOT NULL AND code_n1 IS NOT NULL")


@query()
def j10_j16_hunks(spark: SparkSession, root: str) -> DataFrame:
    """Changed stretches of two attempts."""
    return _both(spark, root).select("candidate_id", F.posexplode(D.hunks_udf("code_n", "code_n1")).alias("k", "h")).select("candidate_id", "k", "h.*")


@query()
def j33_j35_delta(spark: SparkSession, root: str) -> DataFrame:
    """Changed spans in the next program, its summary and the region of the first."""
    spans = _both(spark, root).select("candidate_id", "code_n", D.repair_spans_udf("code_n", "code_n1").alias("spans"), D.delta_summary_udf("code_n", "code_n1").alias("delta"))
    return spans.select("candidate_id", F.to_json("spans").alias("spans"), "delta", D.focus_region_udf("code_n", F.get("spans", 0)["start"]).alias("region"))


def _rows_to_score(spark: SparkSession, root: str) -> DataFrame:
    step = lambda n: F.array(
        F.struct(F.lit("edit").alias("action"), n.cast("int").alias("start"), (n + 1).cast("int").alias("end")),
        F.struct(F.lit("submit").alias("action"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")),
    )
    p = _both(spark, root).select("candidate_id", F.col("code_n").alias("before_code"), F.col("code_n1").alias("observed_code"), step(F.col("candidate_id") % 7).alias("observed_steps"))
    hyp = lambda w, code, k: F.struct(F.lit(w).alias("p"), code.alias("code"), step(k).alias("steps"))
    other = F.regexp_replace("before_code", "print", "write")
    return p.withColumn("hyps", F.array(hyp(0.5, F.col("observed_code"), F.col("candidate_id") % 7), hyp(0.3, other, F.col("candidate_id") % 5), hyp(0.2, F.concat("before_code", F.lit("\npass")), F.lit(0))))


@query()
def j27_scores(spark: SparkSession, root: str) -> DataFrame:
    """All scores of three hypotheses in five views."""
    return S.view_scores(S.scored_hypotheses(_rows_to_score(spark, root), ["candidate_id"]), ["candidate_id"])


@query()
def j28_scores_v1(spark: SparkSession, root: str) -> DataFrame:
    """The first version's scores."""
    return S.view_scores(S.scored_hypotheses(_rows_to_score(spark, root), ["candidate_id"], version="v1"), ["candidate_id"])


@query()
def m24_m25_truth_scores(spark: SparkSession, root: str) -> DataFrame:
    """The truth scored as a prediction: every match is 1."""
    rows = _rows_to_score(spark, root).withColumn("hyps", S.truth_hypotheses(F.col("observed_code"), F.col("observed_steps")))
    return S.view_scores(S.scored_hypotheses(rows, ["candidate_id"]), ["candidate_id"]).where("metric = 'exact_next_code_match'")


@query()
def f01_f05_replay(spark: SparkSession, root: str) -> DataFrame:
    """Submit-bounded blocks of replayed logs."""
    return R.replayed_blocks(events(spark, root), ORDER).withColumn("steps", F.to_json("steps"))


@query(f"SELECT log_id, CAST(interval_idx AS INTEGER) AS submit_index, CAST(count(*) FILTER (kind = 'change') AS BIGINT) AS n_seen, CAST(count(*) FILTER (kind = 'saida_testar') AS BIGINT) AS n_runs FROM {_ISL} WHERE closed GROUP BY log_id, interval_idx")
def f02_replay_counts(spark: SparkSession, root: str) -> DataFrame:
    """Changes seen, applied or not, and runs of each replayed block."""
    b = R.replayed_blocks(events(spark, root), ORDER, programs=False, paths=False)
    return b.select("log_id", "submit_index", (F.col("n_changes") + F.col("n_rejected")).cast("bigint").alias("n_seen"), F.col("n_runs").cast("bigint").alias("n_runs"))


@query()
def k03_path_contract(spark: SparkSession, root: str) -> DataFrame:
    """Contract of observed paths."""
    b = R.replayed_blocks(events(spark, root), ORDER, programs=False)
    return b.select("log_id", "submit_index", "steps_reason", step_problem(F.col("steps"), None, None).alias("problem"))


def _attempts_and_snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    scope = ["class_id", "assessment_id"]
    p = _both(spark, root)
    a = p.select(*scope, F.col("candidate_id").alias("attempt"), F.col("code_n").alias("code"))
    s = p.select(*scope, F.col("candidate_id").alias("submit_index"), F.col("code_n1").alias("code")).unionByName(a.withColumnRenamed("attempt", "submit_index"))
    return a, s


_CAND = f"""(SELECT a.class_id, a.assessment_id, a.candidate_id AS attempt, list_sort(list(s.submit_index) FILTER (s.submit_index IS NOT NULL)) AS candidates FROM
   (SELECT *, regexp_replace(regexp_replace(regexp_replace(code_n, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), '(?m)[ \\t]+$', '', 'g') AS x FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL) a
   LEFT JOIN (SELECT class_id, assessment_id, candidate_id AS submit_index, regexp_replace(regexp_replace(regexp_replace(c, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), '(?m)[ \\t]+$', '', 'g') AS x
     FROM (SELECT *, unnest([code_n, code_n1]) AS c FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL)) s ON s.class_id = a.class_id AND s.assessment_id = a.assessment_id AND s.x = a.x GROUP BY ALL)"""


@query(f"SELECT class_id, assessment_id, attempt, candidates FROM {_CAND}")
def e02_e05_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots with an equal program for each attempt."""
    return R.snapshot_candidates(*_attempts_and_snapshots(spark, root), ["class_id", "assessment_id"])


_WAYS = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY class_id, assessment_id ORDER BY attempt) AS k, count(*) OVER (PARTITION BY class_id, assessment_id) AS n FROM {_CAND}),
   o AS (SELECT class_id, assessment_id, k, n, unnest(list_distinct(candidates)) AS s FROM c),
   w AS (SELECT class_id, assessment_id, k, n, s, CAST(1 AS BIGINT) AS ways, [s] AS path FROM o WHERE k = 1 UNION ALL
     SELECT o.class_id, o.assessment_id, o.k, o.n, o.s, least(2, CAST(sum(w.ways) AS BIGINT)), list_append(any_value(w.path), o.s) FROM w JOIN o ON o.class_id = w.class_id AND o.assessment_id = w.assessment_id AND o.k = w.k + 1 AND o.s > w.s GROUP BY o.class_id, o.assessment_id, o.k, o.n, o.s),
   z AS (SELECT c.class_id, c.assessment_id, c.k, c.n, coalesce(least(2, CAST(sum(ways) AS BIGINT)), 0) AS total, any_value(path) AS path FROM c LEFT JOIN w ON c.class_id = w.class_id AND c.assessment_id = w.assessment_id AND c.k = w.k GROUP BY ALL)"""
_STATUS = "CASE total WHEN 1 THEN 'matched' WHEN 0 THEN 'no_match' ELSE 'ambiguous' END AS status"


@query(f"{_WAYS} SELECT class_id, assessment_id, CASE WHEN total = 1 THEN path END AS alignment, {_STATUS} FROM z WHERE k = n")
def e03_e08_alignment(spark: SparkSession, root: str) -> DataFrame:
    """The only increasing alignment of all attempts of a scope."""
    c = R.snapshot_candidates(*_attempts_and_snapshots(spark, root), ["class_id", "assessment_id"])
    return R.aligned(c.withColumn("candidates", F.col("candidates").cast("array<int>")), ["class_id", "assessment_id"])


@query(f"{_WAYS} SELECT class_id, assessment_id, CAST(k AS INTEGER) AS n_attempts, {_STATUS} FROM z")
def e08_e09_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Whether each prefix of the attempts aligns in one way only."""
    c = R.snapshot_candidates(*_attempts_and_snapshots(spark, root), ["class_id", "assessment_id"])
    return R.prefix_alignments(c.withColumn("candidates", F.col("candidates").cast("array<int>")), ["class_id", "assessment_id"])


_SNAPS = f"(SELECT class_id, assessment_id, s.i AS i, {blank_sql('s.c')} AS x FROM (SELECT class_id, assessment_id, unnest([{{'i': 2 * candidate_id, 'c': code_n}}, {{'i': 2 * candidate_id + 1, 'c': code_n1}}]) AS s FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL))"


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY class_id, assessment_id ORDER BY i) AS k FROM {_SNAPS}), l AS (SELECT class_id, assessment_id, list(CAST(i AS VARCHAR) ORDER BY i) AS texts FROM s GROUP BY ALL),
   m AS (SELECT a.class_id, a.assessment_id, a.candidate_id AS attempt, n.i, n1.i AS j, CASE WHEN n1.i > n.i THEN array_to_string(l.texts[n.k + 1:n1.k], '') END AS sig FROM (SELECT *, {blank_sql('code_n')} AS xn, {blank_sql('code_n1')} AS xn1 FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL) a
     LEFT JOIN s n ON n.class_id = a.class_id AND n.assessment_id = a.assessment_id AND n.x = a.xn LEFT JOIN s n1 ON n1.class_id = a.class_id AND n1.assessment_id = a.assessment_id AND n1.x = a.xn1 JOIN l ON l.class_id = a.class_id AND l.assessment_id = a.assessment_id),
   g AS (SELECT class_id, assessment_id, attempt, count(DISTINCT sig) AS n, count(i) AS ni, min({{'i': i, 'j': j}}) FILTER (sig IS NOT NULL) AS f FROM m GROUP BY ALL)
   SELECT class_id, assessment_id, attempt, CASE WHEN ni = 0 THEN 'no_match_n' WHEN n = 0 THEN 'no_match_n1' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN f.i END AS snap_n, CASE WHEN n = 1 THEN f.j END AS snap_n1 FROM g""")
def e01_transition_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of snapshots of each transition."""
    p = _both(spark, root)
    a = p.select("class_id", "assessment_id", F.col("candidate_id").alias("attempt"), "code_n", "code_n1")
    s = p.select("class_id", "assessment_id", F.explode(F.array(F.struct((2 * F.col("candidate_id")).alias("submit_index"), F.col("code_n").alias("code")), F.struct((2 * F.col("candidate_id") + 1).alias("submit_index"), F.col("code_n1").alias("code")))).alias("s"))
    s = s.select("class_id", "assessment_id", "s.*").withColumn("changes", F.col("submit_index").cast("string"))
    return R.transition_alignment(a, s, ["class_id", "assessment_id"])


# parsers
@query(r"""SELECT * FROM (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^-- TEST CASE \d+:[\t\v\f\r ]*$')) AS n_headers FROM documents WHERE doc_kind = 'run_output') WHERE n_headers > 0""")
def a03_test_case_headers(spark: SparkSession, root: str) -> DataFrame:
    """Test-case headers of program outputs, whatever their line ends."""
    head = r"(?md)^-- TEST CASE \d+:[^\S\n]*$"
    lf = F.regexp_replace("text", r"\r\n?", "\n")
    d = table(spark, root, "documents").where("doc_kind = 'run_output'").where(lf.rlike(head))
    return d.select("doc_id", F.regexp_count(lf, F.lit(head)).cast("bigint").alias("n_headers"))


@query("""SELECT CAST(candidate_id AS VARCHAR) AS log, CAST(0 AS INTEGER) AS attempt, TIMESTAMP '2024-03-04 08:00:00' AS ts, len(attempt_n_pass_fail_vector) + 0.5 AS grade, CAST(len(attempt_n_pass_fail_vector) AS INTEGER) AS n_tests,
   CAST(len(list_filter(attempt_n_pass_fail_vector, lambda x: x)) AS INTEGER) AS n_passed, CASE WHEN len(attempt_n_pass_fail_vector) = 0 THEN 'no_tests' END AS reason FROM validated_candidate WHERE attempt_n_code IS NOT NULL AND attempt_n_pass_fail_vector IS NOT NULL""")
def a01_a05_execution_logs(spark: SparkSession, root: str) -> DataFrame:
    """Execution logs made of programs and outputs, parsed back into attempts."""
    p = programs(spark, root).where("code_n IS NOT NULL")
    tests = F.array_join(F.transform("vector", lambda v, i: F.format_string("-- TEST CASE %d:\n---- input:\n1\n---- correct output:\nok\n---- user output:\n%s", i + 1, F.when(v, "ok").otherwise("no"))), "\n")
    body = F.concat(F.lit("== SUBMITION (2024-03-04 08:00:00)\n-- CODE:\n"), "code_n", F.lit("\n-- GRADE:\n"), F.size("vector").cast("string"), F.lit(".5%\n"), tests, F.lit("\n"))
    logs = p.where("vector IS NOT NULL").select(F.col("candidate_id").cast("string").alias("log"), body.alias("value"))
    a = execution_log.attempts(logs)
    return a.select("log", "attempt", "ts", "grade", F.size("tests").alias("n_tests"), F.size(F.filter("tests", lambda t: t["passed"])).alias("n_passed"), "reason")


def _log_lines(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "raw_trace_event").where("event_ts IS NOT NULL AND raw_type IS NOT NULL AND event_id IS NOT NULL").dropDuplicates(["event_id"])
    head = F.concat_ws("#", F.date_format(F.col("event_ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.trim("raw_type"), F.regexp_replace(F.coalesce("payload", F.lit("")), r"[\r\n]+", " "))
    lines = F.concat(F.array(head), F.when(F.trim("raw_type") == "saida_testar", F.coalesce("output_lines", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return raw.select(F.col("log_id").cast("string").alias("log"), "event_id", F.posexplode(lines).alias("k", "value")).select("log", (F.col("event_id") * 1000 + F.col("k")).alias("line_no"), "value")


@query(r"""SELECT CAST(log_id AS VARCHAR) AS log, count(*) AS n_events FROM (SELECT DISTINCT event_id, log_id FROM raw_trace_event WHERE event_ts IS NOT NULL AND raw_type IS NOT NULL AND event_id IS NOT NULL) GROUP BY log_id""")
def a06_a09_editor_logs(spark: SparkSession, root: str) -> DataFrame:
    """Editor-log lines made of trace events, parsed back into events."""
    found, _ = editor_log.events(_log_lines(spark, root))
    return found.groupBy("log").agg(F.count(F.lit(1)).alias("n_events"))


@query(r"""SELECT class_id, student_id, assessment_id, exercise_id, candidate_id % 3 = 0 AS only_execution FROM (SELECT DISTINCT split_part(execution_path, '/', 1) AS class_id, split_part(execution_path, '/', 3) AS student_id, split_part(split_part(execution_path, '/', 5), '_', 1) AS assessment_id,
   replace(split_part(split_part(execution_path, '/', 5), '_', 2), '.log', '') AS exercise_id, min(candidate_id) OVER (PARTITION BY execution_path) AS candidate_id FROM validated_candidate WHERE execution_path IS NOT NULL)""")
def a13_a14_log_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Both logs of each exercise, by their paths; for every third the editor log is taken as missing."""
    c = table(spark, root, "validated_candidate").where("execution_path IS NOT NULL").groupBy(F.col("execution_path").alias("path"), F.col("codemirror_path").alias("other")).agg(F.min("candidate_id").alias("candidate_id"))
    runs, edits = DOC.log_files(c.select("path"), "executions"), DOC.log_files(c.where("candidate_id % 3 <> 0").select(F.col("other").alias("path")), "codemirror")
    return DOC.log_pairs(runs, edits).select("class_id", "student_id", "assessment_id", "exercise_id", (F.coalesce("reason", F.lit("")) == "codemirror_log_missing").alias("only_execution"))


@query("""SELECT delivery_id, CASE WHEN custom_id IS NULL THEN 'batch_output' WHEN delivery_id % 5 = 0 THEN 'http' WHEN summary IS NULL THEN 'empty' END AS stage FROM summary_record""")
def a17_a19_batch_items(spark: SparkSession, root: str) -> DataFrame:
    """Lines of a batch output, made of deliveries, taken apart."""
    r = table(spark, root, "summary_record")
    fence = F.concat(F.lit("```json\n"), F.to_json(F.struct("summary")), F.lit("\n```"))
    body = F.struct(F.lit("completed").alias("status"), F.when(F.col("summary").isNotNull(), fence).alias("output_text"))
    item = F.to_json(F.struct("custom_id", F.struct(F.when(F.col("delivery_id") % 5 == 0, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response")))
    return r.select("delivery_id", DOC.batch_item(item, "summary string").alias("b")).select("delivery_id", "b.stage")


@query("""WITH o AS (SELECT regexp_replace(custom_id, '^\\s+|\\s+$', '', 'g') AS custom_id, count(*) AS n FROM summary_record WHERE custom_id IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT regexp_replace(custom_id, '^\\s+|\\s+$', '', 'g') AS custom_id FROM scored_row WHERE custom_id IS NOT NULL)
   SELECT coalesce(r.custom_id, o.custom_id) AS custom_id, CASE WHEN r.custom_id IS NULL THEN 'unexpected_output' WHEN n > 1 THEN 'duplicate_output' WHEN n IS NULL THEN 'missing_output' END AS stage FROM r FULL JOIN o ON r.custom_id = o.custom_id""")
def m05_m07_hydration(spark: SparkSession, root: str) -> DataFrame:
    """Requests with their outputs, and where they failed."""
    key = stripped(F.col("custom_id"))
    o = table(spark, root, "summary_record").where("custom_id IS NOT NULL").select(key.alias("custom_id"), F.col("summary").alias("response"), F.lit(None).cast("string").alias("stage"))
    r = table(spark, root, "scored_row").where("custom_id IS NOT NULL").select(key.alias("custom_id")).distinct()
    return DOC.hydrated(r, o).select("custom_id", "stage")


# conditions
_HIST = """(SELECT log_id, list({'i': transition_index_0idx, 'trace': visible_change_event_count} ORDER BY transition_index_0idx) AS h FROM (SELECT DISTINCT log_id, transition_index_0idx, visible_change_event_count FROM candidate_transition) GROUP BY log_id)"""


@query(f"""SELECT log_id, len(list_filter(h, lambda x: x.trace IS NOT NULL)) AS n_full, 0 AS n_no_trace, len(list_filter(h[len(h) - greatest(1, CAST(ceil(len(h) * 0.25) AS BIGINT)) + 1:], lambda x: x.trace IS NOT NULL)) AS n_dosage_25,
   len(list_filter(h[len(h) - greatest(1, CAST(ceil(len(h) * 0.75) AS BIGINT)) + 1:], lambda x: x.trace IS NOT NULL)) AS n_dosage_75, len(list_filter(h[1:2], lambda x: x.trace IS NOT NULL)) AS n_window FROM {_HIST}""")
def c01_c07_conditions(spark: SparkSession, root: str) -> DataFrame:
    """Traces left under each condition."""
    t = table(spark, root, "candidate_transition").select("log_id", "transition_index_0idx", "visible_change_event_count").distinct()
    h = t.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(F.col("transition_index_0idx").alias("i"), F.col("visible_change_event_count").alias("trace")))).alias("h"))
    left = lambda a: F.size(F.filter(a, lambda x: x["trace"].isNotNull()))
    kinds = [left(O.visible(F.col("h"), c)).cast("bigint" if c != "no_trace" else "int").alias(f"n_{c}") for c in ("full", "no_trace", "dosage_25", "dosage_75")]
    return h.select("log_id", *kinds, left(O.windowed(F.col("h"), F.array(F.lit(0), F.lit(1)))).cast("bigint").alias("n_window"))


# streaming
@query(f"SELECT log_id, CAST(interval_idx AS INTEGER) AS interval_idx, CAST(count(*) AS INTEGER) AS n_events, CAST(count(*) FILTER (kind = 'change') AS INTEGER) AS n_changes, CAST(count(*) FILTER (kind = 'saida_testar') AS INTEGER) AS n_runs FROM {_ISL} WHERE closed GROUP BY log_id, interval_idx")
def s01_interval_stream(spark: SparkSession, root: str) -> DataFrame:
    """Closed intervals from a stream with state, equal to the batch ones."""
    from tapeloom.shared import shared_path

    path = shared_path(spark, "events")
    events(spark, root).select("log_id", "event_id", "kind", F.col("ts").cast("timestamp").alias("ts"), "line_number").write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(path)
    return tapes.run_available(tapes.interval_stream(stream), "intervals").drop("closed_ts")


def _event_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """`rows` as a stream of files."""
    from tapeloom.shared import shared_path

    path = shared_path(spark, "stream")
    rows.write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(path)


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, kind, count(*) AS n FROM {EVENTS_SQL} GROUP BY ALL")
def s02_windowed_counts(spark: SparkSession, root: str) -> DataFrame:
    """Hourly counts by kind from a stream with a watermark, in complete mode (§2.N)."""
    e = events(spark, root).select(F.col("ts").cast("timestamp").alias("ts"), "kind")
    return tapes.run_available(tapes.windowed_counts(_event_stream(spark, e), "ts", "kind"), "windows", "complete").drop("end")


@query(f"""SELECT log_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM (SELECT *, sum(cut) OVER (PARTITION BY log_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
   SELECT log_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY log_id ORDER BY ts), ts) <= 1800000000 THEN 0 ELSE 1 END AS cut FROM {EVENTS_SQL})) GROUP BY log_id, s""")
def s03_session_stream(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of each log from a stream of session windows (§2.N)."""
    e = events(spark, root).select("log_id", F.col("ts").cast("timestamp").alias("ts"))
    return tapes.run_available(tapes.sessions_stream(_event_stream(spark, e), "log_id", "ts"), "sessions", "complete")
