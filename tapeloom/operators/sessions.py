"""Sessions of activity separated by gaps.

Window lag per entity flags gaps, a running sum of the flags numbers the sessions, and an
aggregate closes them. An entity may hold a third of all rows, so the lag runs inside
(entity, time bucket) and only the partial sessions, one row per stretch and bucket, are
windowed per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.shared import stripped

BUCKET_SECONDS = 3600


def one_row_per_event(events: DataFrame, event_id: str, columns: list[str]) -> DataFrame:
    """One row for each non-null `event_id`, with the least non-null value of each of `columns`.

    Copies of an event are equal but for their delivery; where they are not, the least value
    of every column makes the result the same in any order of rows.
    """
    return (
        events.where(F.col(event_id).isNotNull())
        .groupBy(event_id)
        .agg(*[F.min(c).alias(c) for c in columns])
    )


def student_of_log(transitions: DataFrame) -> DataFrame:
    """(log_id, student_id): the least non-blank student of each log, without surrounding white space."""
    student = stripped(F.col("student_id"))
    return (
        transitions.select("log_id", student.alias("student_id"))
        .where((F.col("student_id") != "") & F.col("log_id").isNotNull())
        .groupBy("log_id")
        .agg(F.min("student_id").alias("student_id"))
    )


def sessions(
    events: DataFrame,
    entity: str = "student_id",
    ts: str = "event_ts",
    event_id: str = "event_id",
    gap_seconds: float = 1800.0,
    kind: Column | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """One row per session: entity, session_index_0idx, first_event_id, last_event_id,
    session_start, session_end, duration_seconds, n_events and, if `kind` is given,
    `events_by_kind` (map of kind to count).

    A session starts at an entity's first event and wherever at least `gap_seconds` have
    passed since the event before, in the order (ts, event_id). Rows with a null entity or
    ts are left out; ties of ts stay in one session; an empty table gives no rows; a null
    kind counts as "unknown". Other columns are ignored, whatever their names.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(
        F.col(entity).alias("e"),
        us.alias("t"),
        F.col(event_id).alias("i"),
        *([F.coalesce(kind, F.lit("unknown")).alias("k")] if kind is not None else []),
    ).where(F.col("e").isNotNull() & F.col("t").isNotNull())
    gap = int(gap_seconds * 1_000_000)
    rows = rows.withColumn("b", F.floor(F.col("t") / F.lit(bucket_seconds * 1_000_000)))
    local = Window.partitionBy("e", "b").orderBy("t", "i")
    opens = F.when(F.col("t") - F.lag("t").over(local) >= gap, 1).otherwise(0)
    rows = rows.withColumn("o", opens).withColumn(
        "s", F.sum("o").over(local.rowsBetween(Window.unboundedPreceding, 0))
    )
    # (e, b) already clusters these aggregates: no exchange
    ends = [
        F.min(F.struct("t", "i")).alias("lo"),
        F.max(F.struct("t", "i")).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    ]
    if kind is None:
        parts = rows.groupBy("e", "b", "s").agg(*ends)
    else:
        parts = (
            rows.groupBy("e", "b", "s", "k")
            .agg(*ends)
            .groupBy("e", "b", "s")
            .agg(
                F.min("lo").alias("lo"),
                F.max("hi").alias("hi"),
                F.sum("n").alias("n"),
                F.collect_list(F.struct("k", "n")).alias("kinds"),
            )
        )
    whole = Window.partitionBy("e").orderBy("b", "s")
    before = F.lag(F.col("hi.t")).over(whole)
    starts = F.when(before.isNull() | (F.col("lo.t") - before >= gap), 1).otherwise(0)
    parts = parts.withColumn("o", starts).withColumn(
        "session", F.sum("o").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - 1
    )
    total = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")]
    if kind is None:
        done = parts.groupBy("e", "session").agg(*total)
    else:
        done = (
            parts.select("e", "session", "lo", "hi", F.explode("kinds").alias("kn"))
            .groupBy("e", "session", F.col("kn.k").alias("k"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("kn.n").alias("n"))
            .groupBy("e", "session")
            .agg(*total, F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("kinds"))
        )
    return done.select(
        F.col("e").alias(entity),
        F.col("session").cast("bigint").alias("session_index_0idx"),
        F.col("lo.i").alias("first_event_id"),
        F.col("hi.i").alias("last_event_id"),
        F.timestamp_micros(F.col("lo.t")).alias("session_start"),
        F.timestamp_micros(F.col("hi.t")).alias("session_end"),
        ((F.col("hi.t") - F.col("lo.t")) / 1e6).alias("duration_seconds"),
        F.col("n").alias("n_events"),
        *([F.col("kinds").alias("events_by_kind")] if kind is not None else []),
    )


def student_sessions(
    trace: DataFrame, transitions: DataFrame, gap_seconds: float = 1800.0, by_kind: bool = False
) -> DataFrame:
    """Sessions of each student over all logs of `trace`; logs without a student are left out."""
    columns = ["log_id", "event_ts"] + (["raw_type"] if by_kind else [])
    events = one_row_per_event(trace, "event_id", columns).where(F.col("event_ts").isNotNull())
    events = events.join(student_of_log(transitions), "log_id")
    kind = F.lower(stripped(F.col("raw_type"))) if by_kind else None
    return sessions(events, gap_seconds=gap_seconds, kind=kind)
