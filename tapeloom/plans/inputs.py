"""The tables as the operators want them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.sequences import event_kind
from tapeloom.shared import UNI_SPACE, WORD_CHARS, stripped, table



def strip_sql(c: str) -> str:
    """SQL of `shared.stripped`."""
    return f"regexp_replace({c}, '^{UNI_SPACE}+|{UNI_SPACE}+$', '', 'g')"


def ascii_sql(c: str) -> str:
    """SQL of a text for patterns with `\\b` and `\\d`, which RE2 has for ASCII only: digits of other scripts as 0, other
    letters as z, other characters as ~. Word edges and counts of ASCII words are those of the text as stored."""
    zero = f"regexp_replace({c}, '\\p{{Nd}}', '0', 'g')"
    return f"regexp_replace(regexp_replace({zero}, '[^\\x00-\\x7f{WORD_CHARS}]', '~', 'g'), '[^\\x00-\\x7f]', 'z', 'g')"


SEMANTIC = ("change", "saida_testar", "submit", "kill_program", "keyhandled", "tab_click")


def events(spark: SparkSession, root: str) -> DataFrame:
    """(event_id, log_id, ts, line_number, kind, payload): one row per event with a time and a known kind."""
    raw = table(spark, root, "raw_trace_event").where(F.col("event_id").isNotNull())
    once = raw.groupBy("event_id").agg(
        F.min("log_id").alias("log_id"), F.min("event_ts").alias("ts"), F.min("line_number").alias("line_number"),
        F.min(event_kind(stripped(F.col("raw_type")))).alias("kind"), F.min("payload").alias("payload"),
    )
    return once.where(F.col("ts").isNotNull() & F.col("kind").isin(*SEMANTIC))


EVENTS_SQL = f"""(SELECT * FROM (SELECT event_id, min(log_id) AS log_id, min(event_ts) AS ts, min(line_number) AS line_number,
   min(CASE WHEN k = 'kill' THEN 'kill_program' ELSE k END) AS kind, min(payload) AS payload
   FROM (SELECT *, replace(lower({strip_sql('raw_type')}), '-', '_') AS k FROM raw_trace_event
         WHERE event_id IS NOT NULL) GROUP BY event_id)
   WHERE ts IS NOT NULL AND kind IN ('change', 'saida_testar', 'submit', 'kill_program', 'keyhandled', 'tab_click'))"""


def programs(spark: SparkSession, root: str) -> DataFrame:
    """validated_candidate with both programs as they are stored, and its keys."""
    return table(spark, root, "validated_candidate").select(
        "candidate_id", stripped(F.col("custom_id")).alias("custom_id"), "class_id", "assessment_id", "exercise_id",
        stripped(F.col("student_id")).alias("student_id"), F.col("attempt_n_code").alias("code_n"),
        F.col("attempt_n1_code").alias("code_n1"), F.col("attempt_n_pass_fail_vector").alias("vector"),
    )


PROGRAMS_SQL = f"""(SELECT candidate_id, {strip_sql('custom_id')} AS custom_id, class_id, assessment_id,
   exercise_id, {strip_sql('student_id')} AS student_id, attempt_n_code AS code_n, attempt_n1_code AS code_n1,
   attempt_n_pass_fail_vector AS vector FROM validated_candidate)"""


def scored(spark: SparkSession, root: str) -> DataFrame:
    """scored_row, the kept copy of each message: keys, scope, student, condition, vector, signature and scores.

    The scope is (class_id, exercise_id, task_id); NaN scores count as null.
    """
    from tapeloom.operators.quotient import delivered_once

    rows = delivered_once(table(spark, root, "scored_row")).where(F.col("custom_id").isNotNull())
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    return rows.select(
        stripped(F.col("custom_id")).alias("custom_id"), "run_condition", "delivery_id",
        F.concat_ws(":", "class_id", "exercise_id", "task_id").alias("scope"), "student_id",
        F.col("attempt_n_pass_vector_signature").alias("signature"), "attempt_n_pass_fail_vector", "hyp_probabilities",
        number("top_1_score").alias("top_1_score"), number("expected_score").alias("expected_score"),
    )


SCORED_SQL = f"""(SELECT custom_id, run_condition, delivery_id, concat_ws(':', class_id, exercise_id, task_id) AS scope, student_id,
   attempt_n_pass_vector_signature AS signature, attempt_n_pass_fail_vector, hyp_probabilities,
   CASE WHEN isnan(top_1_score) THEN NULL ELSE top_1_score END AS top_1_score,
   CASE WHEN isnan(expected_score) THEN NULL ELSE expected_score END AS expected_score
   FROM (SELECT * REPLACE ({strip_sql('custom_id')} AS custom_id), row_number() OVER (
            PARTITION BY {strip_sql('custom_id')}, run_condition
            ORDER BY received_ts NULLS LAST, delivery_id) AS copy_no FROM scored_row WHERE custom_id IS NOT NULL)
   WHERE copy_no = 1)"""


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """summary_record, the kept copy of each message with a text: white space of any kind as one blank, all else as stored."""
    from tapeloom.operators.quotient import delivered_once

    rows = delivered_once(table(spark, root, "summary_record")).where("custom_id IS NOT NULL AND summary IS NOT NULL")
    return rows.select(
        stripped(F.col("custom_id")).alias("custom_id"), "run_condition", "exercise_id", "student_id",
        F.trim(F.regexp_replace("summary", f"{UNI_SPACE}+", " ")).alias("summary"),
    )


SUMMARIES_SQL = f"""(SELECT custom_id, run_condition, exercise_id, student_id,
   trim(regexp_replace(summary, '{UNI_SPACE}+', ' ', 'g')) AS summary
   FROM (SELECT * REPLACE ({strip_sql('custom_id')} AS custom_id), row_number() OVER (
            PARTITION BY {strip_sql('custom_id')}, run_condition
            ORDER BY received_ts NULLS LAST, delivery_id) AS copy_no FROM summary_record WHERE custom_id IS NOT NULL)
   WHERE copy_no = 1 AND summary IS NOT NULL)"""
