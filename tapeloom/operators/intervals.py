"""Intervals of event sequences: islands, idle gaps, markers, trace statistics, segments, transitions.

A log may hold a third of all rows. Running sums and lags over whole logs are therefore taken inside
(log, time bucket), and what a bucket needs from those before it, a few numbers, comes from a window
over one row per bucket. Only windows inside an interval or a bucket see events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.sequences import motif


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two times, rounded half-even to milliseconds; null if one is null."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.bround((us(later) - us(earlier)) / 1e6, 3)


BUCKET_SECONDS = 3600


def carried(
    events: DataFrame, keys: list[str], ts: str, order: list[str], sums: dict[str, Column], bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """`events` with, over all rows of the keys before a row in `order`, each of `sums`, the number `n_before` and the
    time `ts_before` of the last one. `order` begins with `ts`. Rows with a null key or ts are left out."""
    ok = F.col(ts).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.where(ok).withColumn("_b", F.floor(us / F.lit(bucket_seconds * 1_000_000)))
    inside = _before([*keys, "_b"], order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_in_{k}": F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(earlier), F.lit(0)) for k, c in sums.items()}
    laid = rows.withColumns(local | {"_in_n": F.row_number().over(inside) - 1, "_in_ts": F.lag(ts).over(inside)})
    per = rows.groupBy(*keys, "_b").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(f"_s_{k}") for k, c in sums.items()], F.count(F.lit(1)).alias("_s_n"), F.max(ts).alias("_s_ts")
    )
    whole = _before(keys, ["_b"])
    past = whole.rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_s_{k}").over(past), F.lit(0)).alias(f"_off_{k}") for k in [*sums, "n"]], F.lag("_s_ts").over(whole).alias("_off_ts")
    )
    met = laid.join(offset, [*keys, "_b"])
    done = {k: F.col(f"_in_{k}") + F.col(f"_off_{k}") for k in sums}
    done |= {"n_before": F.col("_in_n") + F.col("_off_n"), "ts_before": F.coalesce("_in_ts", "_off_ts")}
    return met.select(*events.columns, *[c.alias(k) for k, c in done.items()])


def islands(events: DataFrame, keys: list[str], order: list[str], closes: Column, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """`events` with interval_idx, pos_in_interval and closed: a row where `closes` holds ends its interval.

    `order` begins with the time. Rows after the last closing one form an interval that isn't closed. A null
    `closes` closes nothing. Rows with a null key or time are left out.
    """
    marked = events.withColumn("_shut", F.coalesce(closes, F.lit(False)).cast("int"))
    numbered = carried(marked, keys, order[0], order, {"interval_idx": F.col("_shut")}, bucket_seconds).drop("n_before", "ts_before")
    inside = Window.partitionBy(*keys, "interval_idx")
    return (
        numbered.withColumn("pos_in_interval", F.row_number().over(inside.orderBy(*order)) - 1)
        .withColumn("closed", F.max("_shut").over(inside) == 1)
        .drop("_shut")
    )


def idle_gap_tape(
    events: DataFrame, keys: list[str], ts: str, order: list[str], kind: str, gap_seconds: float = 30.0, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """(keys, position, kind, ts, gap_seconds): the events with an `idle_gap` row before each one that comes at
    least `gap_seconds` after the one before; positions are counted anew from 0. `order` begins with `ts`."""
    taken = events.select(*dict.fromkeys([*keys, *order, ts, kind]))
    timed = carried(taken, keys, ts, order, {}, bucket_seconds).drop("n_before")
    timed = timed.withColumn("gap_seconds", seconds_between(F.col(ts), F.col("ts_before"))).drop("ts_before")
    idle = F.coalesce(F.col("gap_seconds") >= gap_seconds, F.lit(False)).cast("int")
    counted = carried(timed.withColumn("_idle", idle), keys, ts, order, {"_gaps": F.col("_idle")}, bucket_seconds)
    place = F.col("n_before") + F.col("_gaps") + F.col("_idle")
    own = F.struct(place.alias("position"), F.col(kind).alias("kind"))
    rows = F.when(F.col("_idle") == 1, F.array(F.struct((place - 1).alias("position"), F.lit("idle_gap").alias("kind")), own)).otherwise(F.array(own))
    return counted.select(*keys, F.explode(rows).alias("_r"), F.col(ts).alias("ts"), "gap_seconds").select(*keys, "_r.position", "_r.kind", "ts", "gap_seconds")


def interval_markers(events: DataFrame, keys: list[str], ts: str, order: list[str], kind: str, payload: str, kinds: list[str]) -> DataFrame:
    """The events of `kinds` with the seconds since the event before, of whatever kind, and the first 160 characters of the payload."""
    timed = carried(events, keys, ts, order, {}).drop("n_before")
    return (
        timed.withColumn("seconds_since_previous", seconds_between(F.col(ts), F.col("ts_before")))
        .drop("ts_before")
        .where(F.col(kind).isin(*kinds))
        .withColumn("payload_preview", F.left(F.col(payload), F.lit(160)))
    )


def last_changes(events: DataFrame, keys: list[str], ts: str, order: list[str], limit: int = 20) -> DataFrame:
    """The last `limit` events of each interval with their ordinal (from 1) and the gap to the one before."""
    w = _before(keys, order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        events.withColumn("ordinal", F.row_number().over(w))
        .withColumn("seconds_since_previous", seconds_between(F.col(ts), F.lag(ts).over(w)))
        .withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= limit)
        .drop("_back")
    )


def interval_counts(events: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Number of events of each of `kinds` and of all, per interval."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    )


def change_stats(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Statistics of the edits of an interval: kinds by map, lines touched, sizes.

    `changes` has from_line, to_line (0-based), inserted, removed and origin; null texts count as empty,
    a null origin as "none". A change is an insertion, a deletion or a replacement by its two texts.
    """
    put, cut = F.coalesce("inserted", F.lit("")), F.coalesce("removed", F.lit(""))
    lines = F.sequence(F.col("from_line"), F.greatest("from_line", "to_line"))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = changes.withColumn("_origin", F.coalesce("origin", F.lit("none"))).withColumn("_first", F.first("from_line").over(w)).withColumn(
        "_again", (F.col("from_line") != F.lag("from_line").over(w)).cast("int")
    )
    counts = rows.groupBy(*keys, "_origin").agg(F.count(F.lit(1)).alias("_n"))
    origins = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_origin", "_n")))).alias("origins"))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.count_if((put != "") & (cut == "")).alias("n_insert"),
        F.count_if((put == "") & (cut != "")).alias("n_delete"),
        F.count_if((put != "") & (cut != "")).alias("n_replace"),
        F.count_if(put.contains("\n") | cut.contains("\n")).alias("n_multiline"),
        F.sum(F.length(put)).alias("chars_in"),
        F.sum(F.length(cut)).alias("chars_out"),
        F.sum(F.length(put) - F.length(cut)).alias("chars_net"),
        F.first("_first").alias("first_line"),
        F.coalesce(F.sum("_again"), F.lit(0)).alias("line_moves"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(lines)))).alias("lines_touched"),
    )
    return stats.join(origins, keys)


def segment_events(events: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """`events` with attempt and segment: segments are closed by a run or a submit and numbered within attempts closed by a
    submit. `order` begins with the time."""
    is_kind = lambda *ks: F.col(kind).isin(*ks).cast("int")
    rows = carried(events, keys, order[0], order, {"attempt": is_kind("submit"), "_anchor": is_kind("submit", "saida_testar")})
    per = Window.partitionBy(*keys, "attempt")
    return rows.withColumn("segment", F.col("_anchor") - F.min("_anchor").over(per)).drop("n_before", "ts_before", "_anchor")


def segments(events: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """The segments of `segment_events`: keys, attempt, segment, n_events, n_changes, closed_by (null for the open end)."""
    rows = segment_events(events, keys, order, kind)
    last = F.max(F.when(F.col(kind).isin("submit", "saida_testar"), F.col(kind)))
    return rows.groupBy(*keys, "attempt", "segment").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(kind) == "change").alias("n_changes"), last.alias("closed_by")
    )


def interval_motifs(events: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """(keys, interval_idx, kinds, motif) of each closed submit-bounded interval."""
    rows = islands(events, keys, order, F.col(kind) == "submit").where("closed")
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("pos_in_interval", kind))), lambda x: x[kind])
    return rows.groupBy(*keys, "interval_idx").agg(kinds.alias("kinds")).withColumn("motif", motif(F.col("kinds")))


def transitions(attempts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Pairs of consecutive attempts: `value` as of n, of n + 1, and the number of attempts before n."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        attempts.withColumn("value_n", F.col(value))
        .withColumn("value_n1", F.lead(value).over(w))
        .withColumn("has_next", F.lead(F.lit(1)).over(w).isNotNull())
        .withColumn("n_before", F.row_number().over(w) - 1)
        .where("has_next")
        .select(*keys, order, "value_n", "value_n1", "n_before")
    )


def truncated(lines: Column, limit: int) -> Column:
    """An array of at most `limit` lines: head, a marker with the number of lines left out, and tail; without a
    marker where there is room for two lines at most."""
    n = F.size(lines)
    if limit <= 2:
        return F.slice(lines, 1, limit)
    head = max(1, (limit - 1) // 2)
    tail = limit - head - 1
    mark = F.concat(F.lit("... truncated "), (n - head - tail).cast("string"), F.lit(" stdout lines ..."))
    return F.when(n > limit, F.concat(F.slice(lines, 1, head), F.array(mark), F.slice(lines, n - tail + 1, F.lit(tail)))).otherwise(lines)


def closest_segment(rows: DataFrame, keys: list[str], n: str, target: int, tie: list[str]) -> DataFrame:
    """Of each group the row whose `n` is closest to `target`, ties by the columns `tie`."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = F.min_by(whole, F.struct(F.abs(F.col(n) - target), *[F.col(c) for c in tie]))
    return rows.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def contiguous(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, start, end) of the spans of consecutive integers among the distinct values of `n`."""
    w = Window.partitionBy(*keys).orderBy(n)
    spans = rows.select(*keys, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(w))
    return spans.groupBy(*keys, "_g").agg(F.min(n).alias("start"), F.max(n).alias("end")).drop("_g")
