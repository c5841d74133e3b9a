"""Repeated consecutive events in sequences.

Canonical events become Unicode code points, a stretch of a sequence becomes a string, and a
backreference finds the runs, whose spans lead back to events and times. Sequences may hold a
third of all rows, so that they aren't gathered per entity: events are range partitioned and
sorted on (entity, time, order, id), every partition is scanned in order, and the runs that
touch the edge of a partition, two per partition at most, are joined up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.shared import stripped, tasks, written

#: Separates stretches: no run crosses it. No event is mapped to it.
_BREAK = "\x00"
_FIRST_SYMBOL = 0x100
_REPEAT = re.compile("([^\x00])\\1*", re.DOTALL)
_CHUNK = 200_000  # symbols in one string; a run goes on over its end

_SCHEMA = (
    "part int, edge int, ent string, sym string, first_id bigint, last_id bigint, "
    "first_t bigint, last_t bigint, n bigint"
)


@dataclass
class _Run:
    ent: str
    sym: str | None
    first_id: int
    last_id: int
    first_t: int
    last_t: int
    n: int

    def row(self, part: int, edge: int) -> tuple:
        return (part, edge, self.ent, self.sym, self.first_id, self.last_id, self.first_t, self.last_t, self.n)


def symbol_runs(
    ent: np.ndarray, sym: np.ndarray, t: np.ndarray, max_gap: int
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of a chunk in order. A null symbol is a run of its own."""
    n = len(t)
    null = pd.isna(sym)
    codes, distinct = pd.factorize(sym)  # null is -1
    if len(distinct) > 0x10FFFF - 0xE000 - _FIRST_SYMBOL:
        raise ValueError("more distinct events in a chunk than code points")
    points = codes + _FIRST_SYMBOL + 1
    points = np.where(points >= 0xD800, points + 0x800, points)  # no surrogates
    apart = np.zeros(n, dtype=bool)
    apart[1:] = (ent[1:] != ent[:-1]) | (t[1:] - t[:-1] > max_gap) | null[1:] | null[:-1]
    # a break before each event that can't continue the one before
    at = np.arange(n) + np.cumsum(apart)
    laid = np.zeros(n + int(apart.sum()), dtype="<u4")
    laid[at] = points
    string = laid.tobytes().decode("utf-32-le")
    spans = np.array([m.span() for m in _REPEAT.finditer(string)], dtype=np.int64).reshape(-1, 2)
    return np.searchsorted(at, spans[:, 0]), np.searchsorted(at, spans[:, 1] - 1) + 1


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= _CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _scan(max_gap: int, min_run: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        first = True
        open_run: _Run | None = None
        for chunk in _chunks(batches):
            ent, sym = chunk["ent"].to_numpy(), chunk["sym"].to_numpy(dtype=object)
            t, ids = chunk["t"].to_numpy(dtype=np.int64), chunk["id"].to_numpy(dtype=np.int64)
            lo, hi = symbol_runs(ent, sym, t, max_gap)
            out: list[tuple] = []
            big = np.flatnonzero(hi - lo >= min_run)
            inner = set(big.tolist()) | {0, len(lo) - 1}
            for k in sorted(inner):
                a, b = int(lo[k]), int(hi[k])
                name = sym[a] if isinstance(sym[a], str) else None
                this = _Run(str(ent[a]), name, int(ids[a]), int(ids[b - 1]), int(t[a]), int(t[b - 1]), b - a)
                if k == 0 and open_run is not None:
                    joined = _join(open_run, this, max_gap)
                    if joined is not None:
                        this = joined
                    else:
                        if first:
                            out.append(open_run.row(part, 0))
                            first = False
                        elif open_run.n >= min_run:
                            out.append(open_run.row(part, -1))
                if k == len(lo) - 1:
                    open_run = this
                elif first:
                    out.append(this.row(part, 0))
                    first = False
                elif this.n >= min_run:
                    out.append(this.row(part, -1))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
        if open_run is not None:
            yield pd.DataFrame([open_run.row(part, 2 if first else 1)], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def _join(a: _Run, b: _Run, max_gap: int) -> _Run | None:
    if a.sym is None or a.sym != b.sym or a.ent != b.ent or b.first_t - a.last_t > max_gap:
        return None
    return _Run(a.ent, a.sym, a.first_id, b.last_id, a.first_t, b.last_t, a.n + b.n)


def _stitch(max_gap: int):
    """Joins the runs at the edges of neighbouring partitions: edge 0 is a first run, 1 a last one, 2 a whole partition."""

    def run(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["part", "edge"], kind="stable")
        out: list[_Run] = []
        for row in edges.itertuples(index=False):
            sym = row.sym if isinstance(row.sym, str) else None
            this = _Run(row.ent, sym, row.first_id, row.last_id, row.first_t, row.last_t, row.n)
            # a last run doesn't touch the first one of its own partition
            joined = _join(out[-1], this, max_gap) if out and row.edge != 1 else None
            if joined is not None:
                out[-1] = joined
            else:
                out.append(this)
        return pd.DataFrame([r.row(0, -1) for r in out], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def collapsed_runs(
    events: DataFrame,
    entity: Column,
    symbol: Column,
    time_us: Column,
    order: Column,
    event_id: str,
    max_gap_seconds: float = 2.0,
    min_run: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Each run of at least `min_run` equal consecutive events as one row: entity, symbol,
    first_event_id, last_event_id, start_us, end_us, duration_seconds, n_events.

    Events of an entity are ordered by (time_us, order, event_id); an event continues a run
    if its symbol is equal and it comes at most `max_gap_seconds` after the one before. A
    null symbol equals nothing and is a run of one event. Rows with a null entity, time or
    id are left out; a null order comes first; several rows with one event_id must have been
    reduced before. An empty table gives no rows.
    """
    spark = events.sparkSession
    keys = ["ent", "t", "o", "id"]
    laid = events.select(
        entity.cast("string").alias("ent"),
        time_us.alias("t"),
        order.cast("bigint").alias("o"),
        F.col(event_id).cast("bigint").alias("id"),
        symbol.alias("sym"),
    ).where(F.col("ent").isNotNull() & F.col("t").isNotNull() & F.col("id").isNotNull())
    ordered = laid.repartitionByRange(partitions or tasks(spark), *keys).sortWithinPartitions(*keys)
    gap = round(max_gap_seconds * 1e6)
    found = written(ordered.mapInPandas(_scan(gap, min_run), _SCHEMA), "runs")
    edges = found.where("edge >= 0").groupBy(F.lit(0).alias("all")).applyInPandas(_stitch(gap), _SCHEMA)
    return (
        found.where("edge < 0")
        .unionByName(edges)
        .where(F.col("n") >= min_run)
        .select(
            F.col("ent").alias("entity"),
            F.col("sym").alias("symbol"),
            F.col("first_id").alias("first_event_id"),
            F.col("last_id").alias("last_event_id"),
            F.col("first_t").alias("start_us"),
            F.col("last_t").alias("end_us"),
            ((F.col("last_t") - F.col("first_t")) / 1e6).alias("duration_seconds"),
            F.col("n").alias("n_events"),
        )
    )


def raw_type_runs(trace: DataFrame, min_run: int = 1, max_gap_seconds: float = 2.0) -> DataFrame:
    """Runs of raw_type per log_id; spelling is compared without case and surrounding blanks."""
    events = (
        trace.where(F.col("event_id").isNotNull())
        .withColumn("sym", F.lower(stripped(F.col("raw_type"))))
        .groupBy("event_id")
        .agg(*[F.min(c).alias(c) for c in ("log_id", "event_ts", "line_number", "sym")])
    )
    return collapsed_runs(
        events,
        F.col("log_id"),
        F.col("sym"),
        F.unix_micros(F.col("event_ts").cast("timestamp")),
        F.col("line_number"),
        "event_id",
        max_gap_seconds,
        min_run,
    )


def event_time_us(text: Column) -> Column:
    """Microseconds since 1970 of a time string: ISO date and time apart by T or a blank, with or without a
    fraction or zone, or a number of seconds (up to 11 digits) or milliseconds. Other strings give null."""
    clean = stripped(text)
    whole = F.length(F.regexp_extract(clean, r"^\d+", 0))
    scale = F.when(whole > 11, 1_000).otherwise(1_000_000)
    number = (clean.try_cast("decimal(20,6)") * scale).try_cast("bigint")
    return F.when(clean.rlike(r"^\d{9,14}(\.\d+)?$"), number).otherwise(F.unix_micros(clean.try_cast("timestamp")))


def inserted_text_runs(changes: DataFrame, min_run: int = 1, max_gap_seconds: float = 2.0) -> DataFrame:
    """Runs of inserted_text per (log_id, submit_index_0idx), compared without case and any white space."""
    events = (
        changes.where(F.col("event_id").isNotNull())
        .withColumn("sym", F.lower(F.regexp_replace(F.col("inserted_text"), r"[\h\v\x1C-\x1F]+", "")))
        .withColumn("t", event_time_us(F.col("event_timestamp")))
        .groupBy("event_id")
        .agg(
            *[F.min(c).alias(c) for c in ("log_id", "submit_index_0idx", "t", "ordinal_in_interval_1idx", "sym")]
        )
    )
    entity = F.concat_ws(":", F.col("log_id"), F.coalesce(F.col("submit_index_0idx").cast("string"), F.lit("-")))
    return collapsed_runs(
        events.where(F.col("log_id").isNotNull()),
        entity,
        F.col("sym"),
        F.col("t"),
        F.col("ordinal_in_interval_1idx"),
        "event_id",
        max_gap_seconds,
        min_run,
    )
