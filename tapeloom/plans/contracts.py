"""Queries of sources and sinks, by writing the tables' rows out and reading them again, and of contracts, lookups, manifests and
guards (survey A10-A12, A21-A28, B01-B07, C22-C28, D15-D25, G31, K02-K07, M22-M34, M60-M74)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import diff as D
from tapeloom.operators import contracts as K
from tapeloom.operators import intervals as I
from tapeloom.operators import reports as R
from tapeloom.operators import transitions as T
from tapeloom.plans import sequences, studies
from tapeloom.plans.inputs import EVENTS_SQL, PROGRAMS_SQL, SCORED_SQL, events, programs, scored, strip_sql
from tapeloom.plans.known import _BOTH, _SNAPS
from tapeloom.plans.reports import _SEL
from tapeloom.plans.sequences import _O, _SEG, ORDER
from tapeloom.shared import shared_path, stripped, table
from tapeloom.sources import documents as DOC

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# sources and sinks
_LISTED = "(SELECT class_id, assessment_id, list(DISTINCT exercise_id) AS e FROM scope_record GROUP BY ALL)"
_TITLE = "'Lab ' || (CAST(assessment_id AS BIGINT) % 3)"


def _assessment_files(spark: SparkSession, root: str) -> str:
    """Assessment files of the scopes below a folder, one for each class and assessment."""
    s = table(spark, root, "scope_record").groupBy("class_id", "assessment_id").agg(F.array_sort(F.collect_set("exercise_id")).alias("e"))
    title = F.concat(F.lit("Lab "), (F.col("assessment_id").cast("bigint") % 3).cast("string"))
    lines = F.array_join(F.transform("e", lambda x, i: F.format_string("---- exercise %d: %s", i + 1, x)), "\n")
    path = shared_path(spark, "assessments")
    files = s.select(F.concat(F.lit("---- assessment title: "), title, F.lit("\n"), lines).alias("value"), "class_id", "assessment_id")
    files.write.partitionBy("class_id", "assessment_id").text(path)
    return path


@query(f"SELECT class_id, assessment_id, {_TITLE} AS title, list_sort(e) AS exercises, CAST(NULL AS VARCHAR) AS reason FROM {_LISTED}")
def a10_a11_assessments(spark: SparkSession, root: str) -> DataFrame:
    """Assessment files written and read: class, title and exercises in order."""
    found = DOC.read_assessments(spark, f"{_assessment_files(spark, root)}/*/*")
    part = lambda k: F.regexp_extract("path", rf"{k}=([^/]+)/", 1)
    return found.select(part("class_id").alias("class_id"), part("assessment_id").alias("assessment_id"), "title", "exercises", "reason")


@query(f"SELECT {_TITLE} AS title, count(*) AS n FROM {_LISTED} WHERE {_TITLE} IN ('Lab 0', 'Lab 2') GROUP BY 1")
def a12_target_assessments(spark: SparkSession, root: str) -> DataFrame:
    """Assessments of two titles among all files of a folder."""
    return DOC.read_assessments(spark, f"{_assessment_files(spark, root)}/*/*", ["Lab 0", "Lab 2"]).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT custom_id, run_condition, top_1_score FROM {SCORED_SQL}")
def a21_b03_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Rows written as JSON, a folder for each condition, and read by a strict schema."""
    path = shared_path(spark, "bundles")
    DOC.write_bundles(scored(spark, root).select("custom_id", "run_condition", "top_1_score", F.lit("v1").alias("schema_version")), ["run_condition"], path)
    read = DOC.read_contract(spark, f"{path}/*/*.json", "custom_id string, top_1_score double, schema_version string")
    of = F.regexp_extract(F.col("_metadata.file_path"), r"run_condition=([^/]+)/", 1)  # the folder is part of the row
    return read.where("schema_version = 'v1'").select("custom_id", of.alias("run_condition"), "top_1_score")


@query(f"SELECT 'scores' AS name, count(*) AS n, round(avg(top_1_score), 9) AS mean FROM {SCORED_SQL}")
def b01_b02_json_document(spark: SparkSession, root: str) -> DataFrame:
    """One row as a JSON document that replaces the one before, read again."""
    path = shared_path(spark, "document")
    row = scored(spark, root).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top_1_score"), 9).alias("mean")).withColumn("name", F.lit("scores"))
    DOC.write_json_document(row.withColumn("n", F.lit(0).cast("bigint")), path)
    DOC.write_json_document(row, path)
    return DOC.read_contract(spark, path, "name string, n bigint, mean double", lines=False)


@query(f"""SELECT CAST(k - 1 AS INTEGER) AS line_no, line FROM (SELECT 1 AS k, '| run_condition | n |' AS line UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT 2 + row_number() OVER (ORDER BY run_condition NULLS FIRST), '| ' || coalesce(run_condition, '') || ' | ' || n || ' |' FROM (SELECT run_condition, count(*) AS n FROM {SCORED_SQL} GROUP BY 1))""")
def b07_markdown_report(spark: SparkSession, root: str) -> DataFrame:
    """A small table as the lines of a report."""
    rows = scored(spark, root).groupBy("run_condition").agg(F.count(F.lit(1)).alias("n")).orderBy("run_condition")
    lines = DOC.markdown_table(rows).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


@query(f"""SELECT coalesce(p.custom_id, o.custom_id) AS custom_id, CASE WHEN p.custom_id IS NULL THEN 'no_prediction' WHEN o.custom_id IS NULL THEN 'no_observed_events' END AS reason
   FROM (SELECT DISTINCT custom_id FROM {SCORED_SQL}) p FULL JOIN (SELECT DISTINCT custom_id FROM {PROGRAMS_SQL} WHERE custom_id IS NOT NULL AND candidate_id % 4 <> 0) o ON p.custom_id = o.custom_id""")
def a22_examples(spark: SparkSession, root: str) -> DataFrame:
    """Predictions with observed events, and which side is missing."""
    p = scored(spark, root).select("custom_id").distinct().withColumn("hyps", F.array(F.lit("h")))
    o = programs(spark, root).where("custom_id IS NOT NULL AND candidate_id % 4 <> 0").select("custom_id").distinct().withColumn("events", F.array(F.lit("e")))
    return DOC.examples(p, o).select("custom_id", "reason")


@query("""SELECT d AS directory, CASE WHEN g % 3 = 0 THEN d || '/results_v2.json' WHEN g % 3 = 1 THEN d || '/results_b.json' ELSE d || '/raw.json' END AS path FROM (SELECT 'runs/' || class_id AS d, CAST(class_id AS BIGINT) AS g FROM (SELECT DISTINCT class_id FROM scope_record))""")
def a25_result_files(spark: SparkSession, root: str) -> DataFrame:
    """The result file of each folder by an order of names, the last of equals."""
    c = table(spark, root, "scope_record").select("class_id").distinct()
    g = F.col("class_id").cast("bigint") % 3
    names = F.when(g == 0, F.array(F.lit("raw.json"), F.lit("results_a.json"), F.lit("results_v2.json"))).when(g == 1, F.array(F.lit("raw.json"), F.lit("results_b.json"), F.lit("results_a.json"))).otherwise(F.array(F.lit("raw.json"), F.lit("notes.txt")))
    files = c.select("class_id", F.explode(names).alias("name")).select(F.concat_ws("/", F.lit("runs"), "class_id", "name").alias("path"))
    return DOC.by_priority(files, [r"/results_v2\.json$", r"/results_[a-z]\.json$", r"/raw\.json$"])


@query("SELECT class_id, count(*) AS n_files FROM (SELECT DISTINCT class_id, assessment_id FROM scope_record) GROUP BY 1")
def a27_listed_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder by their metadata alone."""
    found = DOC.list_files(spark, _assessment_files(spark, root)).where(F.col("path").contains("part-"))
    return found.select(F.regexp_extract("path", r"class_id=([^/]+)/", 1).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_files"))


@query("SELECT candidate_id, ['first ' || candidate_id, 'in a list', 'last'] AS literals FROM validated_candidate WHERE candidate_id % 3 <> 0 UNION ALL SELECT candidate_id, [] FROM validated_candidate WHERE candidate_id % 3 = 0")
def a28_string_literals(spark: SparkSession, root: str) -> DataFrame:
    """String constants of sources by their syntax, none for one that doesn't parse."""
    k = F.col("candidate_id").cast("string")
    good = F.concat(F.lit("x = 'first "), k, F.lit("'  # 'no'\ny = [\"in a list\", 3]\nprint('last')"))
    source = F.when(F.col("candidate_id") % 3 == 0, F.concat(good, F.lit("\nif 'open"))).otherwise(good)
    return table(spark, root, "validated_candidate").select("candidate_id", D.string_literals_udf(source).alias("literals"))


# contracts
_HSUM = f"(SELECT {strip_sql('custom_id')} AS custom_id, run_condition, count(*) AS n, sum(estimated_probability) AS total, min(estimated_probability) AS lo, max(estimated_probability) AS hi, max(hyp_rank) * 15 AS longest FROM next_move_hypothesis WHERE custom_id IS NOT NULL AND estimated_probability IS NOT NULL GROUP BY 1, 2)"


def _rule_sql(tolerance: str, longest: str) -> str:
    return f"CASE WHEN n < 2 OR n > 5 THEN 'wrong_number' WHEN lo <= 0 OR hi > 1 THEN 'out_of_range' WHEN abs(total - 1) > {tolerance} THEN 'not_one'{longest} END"


@query(f"SELECT custom_id, run_condition, {_rule_sql('1e-6', '')} AS strict, {_rule_sql('1e-3', chr(32) + 'WHEN longest > 40 THEN ' + chr(39) + 'too_long' + chr(39))} AS episode FROM {_HSUM}")
def k05_k06_response_contracts(spark: SparkSession, root: str) -> DataFrame:
    """Responses of two to five hypotheses against both contracts, strict sums and bounded episodes."""
    h = table(spark, root, "next_move_hypothesis").where("custom_id IS NOT NULL AND estimated_probability IS NOT NULL").withColumn("custom_id", stripped(F.col("custom_id")))
    p = F.col("estimated_probability")
    g = h.groupBy("custom_id", "run_condition").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("t"), F.min(p).alias("lo"), F.max(p).alias("hi"), (F.max("hyp_rank") * 15).alias("longest"))
    rule = lambda tol, most: K.response_problem(F.col("n"), F.col("t"), F.col("lo"), F.col("hi"), F.col("longest"), tol, most_events=most)
    return g.select("custom_id", "run_condition", rule(1e-6, None).alias("strict"), rule(1e-3, 40).alias("episode"))


@query("""SELECT hyp_id, CASE WHEN hyp_id % 5 = 0 THEN 'no_submit_at_end' WHEN hyp_id % 5 = 1 THEN 'bad_step' WHEN hyp_id % 5 = 2 THEN 'too_long' WHEN estimated_probability IS NULL THEN 'missing' WHEN estimated_probability <= 0 OR estimated_probability > 1 THEN 'out_of_range' END AS problem FROM next_move_hypothesis""")
def k02_m22_hypothesis_contract(spark: SparkSession, root: str) -> DataFrame:
    """A hypothesis's steps, with -1 for lines that there are none of, and its probability."""
    step = lambda a, s, e: F.struct(F.lit(a).alias("action"), F.coalesce(F.lit(s).cast("int"), F.lit(-1)).alias("start"), F.coalesce(F.lit(e).cast("int"), F.lit(-1)).alias("end"))
    edit, submit, run = step("edit", 2, 4), step("submit", None, None), step("local_run", None, None)
    k = F.col("hyp_id") % 5
    steps = F.when(k == 0, F.array(edit, run)).when(k == 1, F.array(step("edit", 4, 2), submit)).when(k == 2, F.array_append(F.array_repeat(run, 8), submit)).otherwise(F.array(edit, run, submit))
    p = F.col("estimated_probability")
    odd = F.when(p.isNull(), "missing").when((p <= 0) | (p > 1), "out_of_range")
    return table(spark, root, "next_move_hypothesis").select("hyp_id", F.coalesce(K.step_problem(steps, 8, -1), odd).alias("problem"))


_SEVEN = ["change", "saida_testar", "submit", "kill_program", "keyhandled", "tab_click", "idle_gap"]


@query(f"""SELECT event_id, CASE WHEN kind IS NULL OR NOT list_contains({_SEVEN}, kind) THEN 'unknown_kind' WHEN kind = 'change' AND NOT coalesce(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.text') IS NOT NULL AND try_cast(json_extract_string(payload, '$.from.line') AS INTEGER) IS NOT NULL
   AND try_cast(json_extract_string(payload, '$.from.ch') AS INTEGER) IS NOT NULL AND try_cast(json_extract_string(payload, '$.to.line') AS INTEGER) IS NOT NULL AND try_cast(json_extract_string(payload, '$.to.ch') AS INTEGER) IS NOT NULL END, false) THEN 'bad_change'
   WHEN kind = 'keyhandled' AND coalesce(trim(payload), '') = '' THEN 'no_key' END AS problem FROM (SELECT event_id, kind, CASE WHEN event_id % 7 = 0 THEN '{{"from":{{"line":1}}}}' WHEN event_id % 11 = 0 THEN ' ' ELSE payload END AS payload FROM {EVENTS_SQL})""")
def k07_event_contract(spark: SparkSession, root: str) -> DataFrame:
    """Events against the contract of their kind, some with their payloads spoilt."""
    k = F.col("event_id")
    e = events(spark, root).withColumn("payload", F.when(k % 7 == 0, F.lit('{"from":{"line":1}}')).when(k % 11 == 0, F.lit(" ")).otherwise(F.col("payload")))
    return e.select("event_id", K.event_problem(F.col("kind"), F.col("payload"), _SEVEN).alias("problem"))


# lookups, specs, manifests
@query(f"""SELECT s.custom_id, count(c.custom_id) AS n_matches, CASE count(c.custom_id) WHEN 0 THEN 'no_match' WHEN 1 THEN NULL ELSE 'several_matches' END AS reason FROM (SELECT DISTINCT {strip_sql('custom_id')} AS custom_id FROM summary_record WHERE custom_id IS NOT NULL) s
   LEFT JOIN (SELECT {strip_sql('custom_id')} AS custom_id FROM scored_row WHERE custom_id IS NOT NULL) c ON c.custom_id = s.custom_id GROUP BY s.custom_id""")
def c28_exact_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Fixed slots that must each match one row."""
    ids = lambda t: table(spark, root, t).where("custom_id IS NOT NULL").select(stripped(F.col("custom_id")).alias("custom_id"))
    return K.exact_lookup(ids("summary_record").distinct(), ids("scored_row"), ["custom_id"])


_SPECS = "(SELECT candidate_id AS position, CASE WHEN candidate_id % 6 = 0 THEN class_id || ':' || exercise_id WHEN candidate_id % 6 = 1 THEN class_id || ':' || assessment_id || ':x' WHEN candidate_id % 6 = 2 THEN class_id || ':' || assessment_id || ':1' ELSE class_id || ':' || assessment_id || ':' || candidate_id END AS spec FROM validated_candidate)"
_CHECKED = f"""(SELECT *, CASE WHEN len(p) <> 3 THEN 'wrong_parts' WHEN try_cast(p[-1] AS INTEGER) IS NULL OR try_cast(p[-1] AS INTEGER) < 0 THEN 'bad_index' WHEN row_number() OVER (PARTITION BY spec ORDER BY position) > 1 THEN 'duplicate' END AS reason FROM (SELECT *, string_split(spec, ':') AS p FROM {_SPECS}))"""


@query(f"SELECT position, spec, p[1] AS class_id, p[2] AS assessment_id, try_cast(p[-1] AS INTEGER) AS \"index\", reason FROM {_CHECKED}")
def m68_transition_specs(spark: SparkSession, root: str) -> DataFrame:
    """Transition specs taken apart, with what is wrong with each."""
    k = F.col("candidate_id")
    last = F.when(k % 6 == 1, "x").when(k % 6 == 2, "1").otherwise(k.cast("string"))
    spec = F.when(k % 6 == 0, F.concat_ws(":", "class_id", "exercise_id")).otherwise(F.concat_ws(":", "class_id", "assessment_id", last))
    rows = table(spark, root, "validated_candidate").select(k.alias("position"), spec.alias("spec"))
    return T.transition_specs(rows, "spec", ["class_id", "assessment_id"])


@query(f"SELECT custom_id, string_split(custom_id, ':')[1] AS class_id, string_split(custom_id, ':')[2] AS student_id, CAST(string_split(custom_id, ':')[5] AS INTEGER) AS n FROM (SELECT {strip_sql('custom_id')} AS custom_id FROM validated_candidate WHERE total_attempt_count >= 4) WHERE len(string_split(custom_id, ':')) = 5")
def c27_probe(spark: SparkSession, root: str) -> DataFrame:
    """Candidates with attempts enough, their id as columns."""
    c = table(spark, root, "validated_candidate").where("total_attempt_count >= 4").select(stripped(F.col("custom_id")).alias("custom_id"))
    return c.select("custom_id", K.row_key(F.col("custom_id")).alias("k")).where(F.size(F.split("custom_id", ":")) == 5).select("custom_id", "k.class_id", "k.student_id", "k.n")


@query(f"SELECT custom_id, run_condition, v AS view, round(x, 9) AS value, tau, x <= tau AS within FROM (SELECT custom_id, run_condition, unnest(['top_1', 'expected']) AS v, unnest([top_1_score, expected_score]) AS x FROM {SCORED_SQL}), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE]) AS tau) WHERE x IS NOT NULL")
def c22_c26_m29_selected_views(spark: SparkSession, root: str) -> DataFrame:
    """An index of views filtered by a list of names, against thresholds given as text."""
    views, taus = K.ordered_distinct("top_1, expected,top_1"), K.thresholds("0.5,0.25, 0.5")
    s = scored(spark, root)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.col(c).alias("x")) for n, c in (("top_1", "top_1_score"), ("expected", "expected_score"), ("oracle", "top_1_score"))]))
    rows = s.select("custom_id", "run_condition", long.alias("v")).select("custom_id", "run_condition", "v.*").where(F.col("view").isin(*views) & F.col("x").isNotNull())
    each = rows.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    return each.select("custom_id", "run_condition", "view", F.round("x", 9).alias("value"), "tau", (F.col("x") <= F.col("tau")).alias("within"))


@query(f"SELECT a.custom_id, a.scope, a.signature, a.top_1_score, b.top_1_score AS top_1_score_right FROM {SCORED_SQL} a JOIN {SCORED_SQL} b ON a.custom_id = b.custom_id WHERE a.run_condition = 'full_trace' AND b.run_condition = 'no_trace' AND a.signature = b.signature AND a.scope = b.scope")
def d15_d16_strict_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Two conditions joined one to one; other ids or other observed labels would be an error."""
    s = scored(spark, root).select("custom_id", "run_condition", "scope", "signature", "top_1_score")
    side = lambda c: s.where(F.col("run_condition") == c).drop("run_condition")
    a, b = side("full_trace"), side("no_trace")
    good = a.join(b.select("custom_id", "signature", "scope"), ["custom_id", "signature", "scope"]).select("custom_id")
    keep = lambda x: x.join(good, "custom_id", "left_semi")
    return K.strict_pairs(keep(a), keep(b), ["custom_id"], ["scope", "signature"])


@query("SELECT class_id, count(*) AS n FROM validated_candidate WHERE class_id IS NOT NULL GROUP BY class_id")
def d25_merged_roots(spark: SparkSession, root: str) -> DataFrame:
    """Datasets put together; a class that stands in two of them would be an error."""
    c = table(spark, root, "validated_candidate").where("class_id IS NOT NULL")
    odd = F.col("class_id").cast("bigint") % 2
    return R.union_disjoint([c.where(odd == 0), c.where(odd == 1)], "class_id").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT scope, CASE WHEN f AND NOT n THEN 'left' WHEN n AND NOT f THEN 'right' END AS side FROM (SELECT scope, bool_or(run_condition = 'full_trace') AS f, bool_or(run_condition = 'no_trace') AS n FROM {SCORED_SQL} WHERE run_condition IN ('full_trace', 'no_trace') AND top_1_score >= 0.7 GROUP BY 1) WHERE f <> n""")
def m26_scope_sets(spark: SparkSession, root: str) -> DataFrame:
    """Scopes with a good score that only one of two runs has."""
    return K.key_differences(*[c.where("top_1_score >= 0.7") for c in studies._conditions(spark, root)], ["scope"])


@query("""SELECT class_id, CASE WHEN class_id LIKE '%1' THEN 'missing_key' WHEN class_id LIKE '%2' THEN 'unexpected_key' END AS problem, class_id LIKE '%3' AS differs FROM (SELECT DISTINCT class_id FROM scope_record)""")
def m27_m30_metadata_guards(spark: SparkSession, root: str) -> DataFrame:
    """Reports whose keys must be the expected ones and whose metadata must agree."""
    c = table(spark, root, "scope_record").select("class_id").distinct()
    ends = lambda x: F.col("class_id").endswith(x)
    taus = F.when(ends("1"), F.array(F.lit("0.3"))).when(ends("2"), F.array(F.lit("0.3"), F.lit("0.45"), F.lit("0.9"))).otherwise(F.array(F.lit("0.45"), F.lit("0.3")))
    left = c.withColumn("meta", F.lit("a"))
    right = c.withColumn("meta", F.when(ends("3"), "b").otherwise("a"))
    bad = K.column_differences(left, right, ["class_id"], ["meta"]).select("class_id", F.lit(True).alias("differs"))
    named = c.select("class_id", K.key_set_problem(F.map_keys(F.map_from_arrays(taus, F.transform(taus, lambda x: F.lit(1)))), ["0.3", "0.45"]).alias("problem"))
    return named.join(bad, "class_id", "left").withColumn("differs", F.coalesce("differs", F.lit(False)))


@query(f"""SELECT to_json({{'tertile': tertile, 'n': count(*), 'ids': list(candidate_id ORDER BY candidate_id)}})::VARCHAR AS manifest FROM (SELECT candidate_id, tertile FROM {_SEL} JOIN (SELECT class_id, assessment_id, exercise_id, sig, count(DISTINCT student_id) AS n FROM {_SEL} GROUP BY ALL HAVING count(DISTINCT student_id) >= 2) USING (class_id, assessment_id, exercise_id, sig)) GROUP BY tertile""")
def g31_m34_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a staged selection: ordered ids for each stratum, as JSON."""
    from tapeloom.plans.reports import select_cohort

    m = select_cohort(spark, root).groupBy("tertile").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("candidate_id")).alias("ids"))
    return m.select(F.to_json(F.struct("tertile", "n", "ids"), {"ignoreNullFields": "false"}).alias("manifest"))


@query("SELECT name, kind, CAST(seed AS INTEGER) AS seed FROM (VALUES ('full', 'full', NULL), ('fixed', 'deterministic', NULL)) v(name, kind, seed) UNION ALL SELECT k || '_' || s, k, s FROM (SELECT unnest(['within', 'across']) AS k), (SELECT unnest(range(1, 6)) AS s)")
def m60_run_grid(spark: SparkSession, root: str) -> DataFrame:
    """The runs of a sensitivity study: one full, one deterministic, five seeds of two kinds."""
    return R.run_grid(spark, ["within", "across"], 5)


@query(f"""SELECT s.log_id, e.event_id, e.kind FROM (SELECT log_id, arg_min(attempt, (abs(n_changes - 10), attempt, segment)) AS attempt, arg_min(segment, (abs(n_changes - 10), attempt, segment)) AS segment FROM {_SEG} GROUP BY log_id) s
   JOIN (SELECT *, anchor - min(anchor) OVER (PARTITION BY log_id, attempt) AS segment FROM (SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'submit' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS attempt, CAST(coalesce(sum(CASE WHEN kind IN ('submit', 'saida_testar') THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS anchor
   FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY log_id ORDER BY {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) e ON e.log_id = s.log_id AND e.attempt = s.attempt AND e.segment = s.segment""")
def m66_realised_segments(spark: SparkSession, root: str) -> DataFrame:
    """The events of each log's chosen segment."""
    chosen = sequences.f17_representative_segment(spark, root)
    return I.segment_events(events(spark, root), ["log_id"], ORDER, "kind").join(chosen, ["log_id", "attempt", "segment"], "left_semi").select("log_id", "event_id", "kind")


@query(f"""SELECT reason, class AS error_class, count(*) AS n FROM (SELECT CASE WHEN id % 5 = 0 THEN 'several alignments fit' WHEN id % 5 = 1 THEN 'no snapshot fits' WHEN id % 5 = 3 THEN 'line 12: unexpected token' WHEN id % 7 = 0 THEN NULL ELSE 'disk full' END AS reason, CASE WHEN id % 5 = 0 THEN 'alignment' WHEN id % 5 = 1 THEN 'alignment' WHEN id % 5 = 3 THEN 'syntax' WHEN id % 7 = 0 THEN NULL ELSE 'other' END AS class FROM {_BOTH}) GROUP BY ALL""")
def m67_error_classes(spark: SparkSession, root: str) -> DataFrame:
    """Error messages by class."""
    k = F.col("candidate_id")
    reason = F.when(k % 5 == 0, "several alignments fit").when(k % 5 == 1, "no snapshot fits").when(k % 5 == 3, "line 12: unexpected token").when(k % 7 == 0, None).otherwise("disk full")
    rows = programs(spark, root).where("code_n IS NOT NULL AND code_n1 IS NOT NULL").select(reason.alias("reason"))
    found = rows.withColumn("error_class", K.error_class(F.col("reason"), {"alignment": "alignment|snapshot", "syntax": r"line \d+"}))
    return found.groupBy("reason", "error_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id AS log_id, 2 AS n_attempts, len({_SNAPS}) AS n_blocks, CAST(NULL AS VARCHAR) AS reason FROM {_BOTH}")
def m01_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Whether a log's transitions can be built."""
    from tapeloom.plans import known

    rows = known._both(spark, root)
    return T.contexts(known.known_attempts(rows), known._blocks(spark, root), ["log_id"])
