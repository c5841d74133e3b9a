"""Queries p5_ and p6_: messages delivered more than once, and sessions of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.quotient import delivered_once, delivery_copies
from tapeloom.operators.sessions import student_sessions
from tapeloom.shared import table

DELIVERED = ("scored_row", "summary_record")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every copy of a message but the one that is kept."""
    parts = [
        delivery_copies(table(spark, root, t))
        .where(~F.col("is_kept"))
        .select(F.lit(t).alias("table_name"), "delivery_id")
        for t in DELIVERED
    ]
    return reduce(DataFrame.unionByName, parts)


def p5_scored_once(spark: SparkSession, root: str) -> DataFrame:
    """scored_row with one copy of each message."""
    return delivered_once(table(spark, root, "scored_row")).select(
        "delivery_id", "custom_id", "run_condition", "top_1_score"
    )


def p5_summaries_once(spark: SparkSession, root: str) -> DataFrame:
    """summary_record with one copy of each message."""
    return delivered_once(table(spark, root, "summary_record")).select(
        "delivery_id", "custom_id", "run_condition", "summary"
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """First and last event of every session."""
    done = student_sessions(table(spark, root, "raw_trace_event"), table(spark, root, "candidate_transition"))
    return done.select("student_id", "first_event_id", "last_event_id")


def p6_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Every session with its start, end, duration and number of events."""
    done = student_sessions(table(spark, root, "raw_trace_event"), table(spark, root, "candidate_transition"))
    return done.withColumn("duration_seconds", F.round("duration_seconds", 6))


def p6_session_types(spark: SparkSession, root: str) -> DataFrame:
    """Every session's number of events by raw_type, ignoring case and surrounding white space."""
    done = student_sessions(
        table(spark, root, "raw_trace_event"), table(spark, root, "candidate_transition"), by_kind=True
    )
    return done.select(
        "student_id", "session_index_0idx", F.explode("events_by_kind").alias("raw_type", "n_events")
    )


QUERIES = {
    f.__name__: f for f in (p5_found, p5_scored_once, p5_summaries_once, p6_found, p6_sessions, p6_session_types)
}

_STRIP = r"regexp_replace({}, '^[\s\x{{A0}}\x{{85}}]+|[\s\x{{A0}}\x{{85}}]+$', '', 'g')"


def _copies(t: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {_STRIP.format('custom_id')}, run_condition
        ORDER BY received_ts NULLS LAST, delivery_id) AS copy_no FROM {t} WHERE custom_id IS NOT NULL"""


def _once(t: str, value: str) -> str:
    return f"""SELECT delivery_id, custom_id, run_condition, {value} FROM ({_copies(t)}) WHERE copy_no = 1
        UNION ALL SELECT delivery_id, custom_id, run_condition, {value} FROM {t} WHERE custom_id IS NULL"""


_SESSIONS = f"""WITH ev AS (
      SELECT event_id, min(log_id) AS log_id, min(event_ts) AS ts, min(raw_type) AS raw_type
      FROM raw_trace_event WHERE event_id IS NOT NULL GROUP BY event_id),
    st AS (
      SELECT log_id, min(s) AS student_id FROM (
        SELECT log_id, {_STRIP.format('student_id')} AS s FROM candidate_transition WHERE student_id IS NOT NULL)
      WHERE s <> '' GROUP BY log_id),
    x AS (
      SELECT student_id, event_id, ts, raw_type,
        lag(ts) OVER (PARTITION BY student_id ORDER BY ts, event_id) AS before
      FROM ev JOIN st USING (log_id) WHERE ts IS NOT NULL),
    y AS (
      SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
        OVER (PARTITION BY student_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS session_no
      FROM x)"""

ORACLE = {
    "p5_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, delivery_id FROM ({_copies(t)}) WHERE copy_no > 1" for t in DELIVERED
    ),
    "p5_scored_once": _once("scored_row", "top_1_score"),
    "p5_summaries_once": _once("summary_record", "summary"),
    "p6_found": f"""{_SESSIONS} SELECT student_id, arg_min(event_id, (ts, event_id)) AS first_event_id,
      arg_max(event_id, (ts, event_id)) AS last_event_id FROM y GROUP BY student_id, session_no""",
    "p6_sessions": f"""{_SESSIONS} SELECT student_id, CAST(session_no AS BIGINT) AS session_index_0idx,
      arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id,
      min(ts) AS session_start, max(ts) AS session_end,
      round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS duration_seconds, count(*) AS n_events
      FROM y GROUP BY student_id, session_no""",
    "p6_session_types": f"""{_SESSIONS} SELECT student_id, CAST(session_no AS BIGINT) AS session_index_0idx,
      coalesce(lower({_STRIP.format('raw_type')}), 'unknown') AS raw_type, count(*) AS n_events
      FROM y GROUP BY ALL""",
}
