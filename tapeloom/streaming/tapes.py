"""Structured Streaming variants: windowed counts, sessions, and submit-bounded intervals with state.

Fed with the same events in order of time, the streams give what the batch operators give; events later than
the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.shared import shared_path


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, end, kind, n) of tumbling windows, or of sliding ones, with a watermark."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(span.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions_stream(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, n_events); events exactly a gap apart are joined here, as the engine has it."""
    s = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s"))
    return s.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n_events")).drop("s")


_OUT = "log_id bigint, interval_idx int, n_events int, n_changes int, n_runs int, closed_ts timestamp"
_STATE = "idx int, n int, changes int, runs int"


def _close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    idx, n, changes, runs = state.get if state.exists else (0, 0, 0, 0)
    out = []
    # a log's rows come in chunks of maxRecordsPerBatch in no order: they are sorted as a whole
    every = pd.concat([b[["ts", "line_number", "event_id", "kind"]] for b in batches], ignore_index=True)
    # a missing line number goes first, as in the batch operators
    for kind, ts in every.sort_values(["ts", "line_number", "event_id"], na_position="first")[["kind", "ts"]].itertuples(index=False):
        n += 1
        changes += kind == "change"
        runs += kind == "saida_testar"
        if kind == "submit":
            out.append((key[0], idx, n, changes, runs, ts))
            idx, n, changes, runs = idx + 1, 0, 0, 0
    state.update((int(idx), int(n), int(changes), int(runs)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def interval_stream(events: DataFrame) -> DataFrame:
    """One row per closed interval of a log, from a stream of (log_id, event_id, kind, ts, line_number).

    The state of a log is four numbers. Events of a log must come in order of time from one micro-batch to the next;
    those of one micro-batch may come in any order and are held together, log by log, to be sorted.
    """
    return events.groupBy("log_id").applyInPandasWithState(_close, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into the shared folder and read the result."""
    spark: SparkSession = stream.sparkSession
    out, mark = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)
