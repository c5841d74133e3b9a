"""Queries on event sequences (survey F, J39-J48, and the tapes that L uses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import sequences as S
from tapeloom.operators import intervals as I
from tapeloom.plans.inputs import EVENTS_SQL, events
from tapeloom.plans.sqlparts import sequence_tables
from tapeloom.shared import table, written

QUERIES = {}
ORACLE = {}
ORDER = ["ts", "line_number", "event_id"]
_O = "ts, line_number NULLS FIRST, event_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_ISL = f"""(SELECT *, row_number() OVER (PARTITION BY log_id, interval_idx ORDER BY {_O}) - 1 AS pos, max(shut) OVER (PARTITION BY log_id, interval_idx) = 1 AS closed
  FROM (SELECT *, CAST(coalesce(sum(shut) OVER (PARTITION BY log_id ORDER BY {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS interval_idx
    FROM (SELECT *, CASE WHEN kind = 'submit' THEN 1 ELSE 0 END AS shut FROM {EVENTS_SQL})))"""


@query(f"SELECT log_id, event_id, interval_idx, CAST(pos AS BIGINT) AS pos_in_interval, closed FROM {_ISL}")
def f06_f07_submit_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Submit-bounded intervals of each log."""
    r = I.islands(events(spark, root), ["log_id"], ORDER, F.col("kind") == "submit")
    return r.select("log_id", "event_id", F.col("interval_idx").cast("bigint").alias("interval_idx"), F.col("pos_in_interval").cast("bigint").alias("pos_in_interval"), "closed")


_GAPPED = f"(SELECT *, round(date_diff('microsecond', lag(ts) OVER (PARTITION BY log_id ORDER BY {_O}), ts) / 1e6, 3) AS gap, row_number() OVER (PARTITION BY log_id ORDER BY {_O}) AS n FROM {EVENTS_SQL} WHERE kind <> 'keyhandled' OR trim(payload, chr(34)) IN ('Enter', 'Backspace', 'Tab', 'Delete', 'Insert'))"


@query(f"""SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY n, first) - 1 AS BIGINT) AS position, kind, ts FROM (
   SELECT log_id, n, 1 AS first, kind, ts FROM {_GAPPED} UNION ALL SELECT log_id, n, 0, 'idle_gap', ts FROM {_GAPPED} WHERE gap >= 30)""")
def f08_idle_gap_tape(spark: SparkSession, root: str) -> DataFrame:
    """Tapes of the semantic events with idle gaps of 30 seconds or more."""
    e = events(spark, root).where(S.is_semantic(F.col("kind"), F.col("payload"), keys=True))
    r = I.idle_gap_tape(e, ["log_id"], "ts", ORDER, "kind", 30.0)
    return r.select("log_id", F.col("position").cast("bigint").alias("position"), "kind", "ts")


@query(f"""SELECT log_id, event_id, kind, payload[1:160] AS payload_preview, seconds_since_previous FROM (
   SELECT *, round_even(date_diff('microsecond', lag(ts) OVER (PARTITION BY log_id ORDER BY {_O}), ts) / 1e6, 3) AS seconds_since_previous FROM {EVENTS_SQL})
   WHERE kind IN ('saida_testar', 'submit', 'tab_click')""")
def f11_interval_markers(spark: SparkSession, root: str) -> DataFrame:
    """Runs, submits and tab clicks with the time since the event before."""
    r = I.interval_markers(events(spark, root), ["log_id"], "ts", ORDER, "kind", "payload", ["saida_testar", "submit", "tab_click"])
    return r.select("log_id", "event_id", "kind", "payload_preview", "seconds_since_previous")


@query(f"""SELECT log_id, event_id, CAST(ordinal AS BIGINT) AS ordinal, seconds_since_previous FROM (SELECT *, row_number() OVER (PARTITION BY log_id, interval_idx ORDER BY {_O}) AS ordinal,
   round_even(date_diff('microsecond', lag(ts) OVER (PARTITION BY log_id, interval_idx ORDER BY {_O}), ts) / 1e6, 3) AS seconds_since_previous,
   row_number() OVER (PARTITION BY log_id, interval_idx ORDER BY ts DESC, line_number DESC, event_id DESC) AS back FROM {_ISL} WHERE kind = 'change') WHERE back <= 20""")
def f10_last_changes(spark: SparkSession, root: str) -> DataFrame:
    """The last 20 changes of each interval."""
    r = I.islands(events(spark, root), ["log_id"], ORDER, F.col("kind") == "submit").where("kind = 'change'")
    r = I.last_changes(r, ["log_id", "interval_idx"], "ts", ORDER, 20)
    return r.select("log_id", "event_id", F.col("ordinal").cast("bigint").alias("ordinal"), "seconds_since_previous")


@query("""WITH c AS (SELECT event_id, any_value(log_id) AS log_id, any_value(submit_index_0idx) AS s, any_value(ordinal_in_interval_1idx) AS o, min(from_line_0idx) AS f, min(to_line_0idx) AS t,
     coalesce(min(inserted_text), '') AS p, coalesce(min(removed_text), '') AS x, coalesce(min(origin), 'none') AS g FROM change_micro_event WHERE event_id IS NOT NULL GROUP BY event_id)
   SELECT log_id, s AS submit_index, count(*) AS n_changes, count(*) FILTER (p <> '' AND x = '') AS n_insert, count(*) FILTER (p = '' AND x <> '') AS n_delete, count(*) FILTER (p <> '' AND x <> '') AS n_replace,
     count(*) FILTER (contains(p, chr(10)) OR contains(x, chr(10))) AS n_multiline, CAST(sum(length(p)) AS BIGINT) AS chars_in, CAST(sum(length(x)) AS BIGINT) AS chars_out,
     arg_min(f, (o, event_id)) AS first_line, list_sort(list_distinct(flatten(list(range(f, greatest(f, t) + 1))))) AS lines_touched, count(DISTINCT g) AS n_origins
   FROM c WHERE f IS NOT NULL AND t IS NOT NULL GROUP BY log_id, s""")
def f13_f14_change_stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of the changes of each interval."""
    raw = table(spark, root, "change_micro_event").where("event_id IS NOT NULL")
    c = raw.groupBy("event_id").agg(*[F.min(a).alias(b) for a, b in (
        ("log_id", "log_id"), ("submit_index_0idx", "submit_index"), ("ordinal_in_interval_1idx", "o"), ("from_line_0idx", "from_line"), ("to_line_0idx", "to_line"),
        ("inserted_text", "inserted"), ("removed_text", "removed"), ("origin", "origin"))]).where("from_line IS NOT NULL AND to_line IS NOT NULL")
    r = I.change_stats(c, ["log_id", "submit_index"], ["o", "event_id"])
    return r.select("log_id", "submit_index", "n_changes", "n_insert", "n_delete", "n_replace", "n_multiline", "chars_in", "chars_out", "first_line",
                    F.col("lines_touched").cast("array<bigint>").alias("lines_touched"), F.size("origins").cast("bigint").alias("n_origins"))


@query(f"""SELECT log_id, interval_idx, count(*) AS n_events, count(*) FILTER (kind = 'change') AS n_change, count(*) FILTER (kind = 'saida_testar') AS n_saida_testar,
   count(*) FILTER (kind = 'submit') AS n_submit FROM {_ISL} WHERE closed GROUP BY log_id, interval_idx""")
def f15_block_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Changes, runs and anchors of each closed interval."""
    r = I.islands(events(spark, root), ["log_id"], ORDER, F.col("kind") == "submit").where("closed")
    return I.interval_counts(r, ["log_id", "interval_idx"], "kind", ["change", "saida_testar", "submit"])


_SEG = f"""(SELECT log_id, attempt, segment, count(*) AS n_events, count(*) FILTER (kind = 'change') AS n_changes, max(CASE WHEN kind IN ('submit', 'saida_testar') THEN kind END) AS closed_by FROM (
   SELECT *, anchor - min(anchor) OVER (PARTITION BY log_id, attempt) AS segment FROM (
   SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'submit' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS attempt, CAST(coalesce(sum(CASE WHEN kind IN ('submit', 'saida_testar') THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS anchor
   FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY log_id ORDER BY {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY ALL)"""


@query(f"SELECT * FROM {_SEG}")
def f16_anchor_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments between anchors, numbered within attempts (F16)."""
    return I.segments(events(spark, root), ["log_id"], ORDER, "kind")


@query(f"SELECT log_id, arg_min(attempt, (abs(n_changes - 10), attempt, segment)) AS attempt, arg_min(segment, (abs(n_changes - 10), attempt, segment)) AS segment FROM {_SEG} GROUP BY log_id")
def f17_representative_segment(spark: SparkSession, root: str) -> DataFrame:
    """The segment of each log closest to 10 changes."""
    s = I.segments(events(spark, root), ["log_id"], ORDER, "kind")
    return I.closest_segment(s, ["log_id"], "n_changes", 10, ["attempt", "segment"]).select("log_id", "attempt", "segment")


@query("""SELECT log_id, transition_index_0idx, visible_attempt_count AS value_n, nxt AS value_n1, CAST(rn - 1 AS BIGINT) AS n_before FROM (
   SELECT *, lead(visible_attempt_count) OVER w AS nxt, row_number() OVER w AS rn, count(*) OVER (PARTITION BY log_id) AS n
   FROM (SELECT DISTINCT log_id, transition_index_0idx, visible_attempt_count FROM candidate_transition) WINDOW w AS (PARTITION BY log_id ORDER BY transition_index_0idx)) WHERE rn < n""")
def f18_transitions(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of consecutive attempts."""
    a = table(spark, root, "candidate_transition").select("log_id", "transition_index_0idx", "visible_attempt_count").distinct()
    r = I.transitions(a, ["log_id"], "transition_index_0idx", "visible_attempt_count")
    return r.withColumn("n_before", F.col("n_before").cast("bigint"))


_FAM = "CASE kind WHEN 'change' THEN 'edit' WHEN 'saida_testar' THEN 'run' WHEN 'submit' THEN 'submit' WHEN 'kill_program' THEN 'runtime' ELSE 'navigate' END"
_MOTIFS = f"""(SELECT log_id, interval_idx, list(kind ORDER BY pos) AS kinds, string_agg(fam, '->' ORDER BY pos) FILTER (prev IS NULL OR prev <> fam) AS motif FROM (
   SELECT *, lag(fam) OVER (PARTITION BY log_id, interval_idx ORDER BY pos) AS prev FROM (SELECT *, {_FAM} AS fam FROM {_ISL} WHERE closed)) GROUP BY log_id, interval_idx)"""


@query(f"SELECT log_id, interval_idx, motif, len(kinds) AS n_events FROM {_MOTIFS}")
def f21_f22_motifs(spark: SparkSession, root: str) -> DataFrame:
    """Compressed motif of each closed interval."""
    r = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind")
    return r.select("log_id", "interval_idx", "motif", F.size("kinds").cast("bigint").alias("n_events"))


def _step_array() -> "F.Column":
    kind = lambda x: F.when(x == "change", "edit").when(x == "submit", "submit").otherwise("local_run")
    return F.transform(F.filter("kinds", lambda x: x.isin("change", "saida_testar", "submit")), lambda x, i: F.struct(
        kind(x).alias("action"), F.when(x == "change", i).alias("start"), F.when(x == "change", i + 1).alias("end")))


# steps of the interval, neighbours of one action merged; then 7 bins of the steps before the submit where they are more, merged again
_STEP = "CASE kind WHEN 'change' THEN 'edit' WHEN 'submit' THEN 'submit' ELSE 'local_run' END"
_MERGED = f"""(SELECT log_id, interval_idx, g, any_value(action) AS action, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN action = prev THEN 0 ELSE 1 END) OVER (PARTITION BY log_id, interval_idx ORDER BY i) AS g FROM (
   SELECT *, lag(action) OVER (PARTITION BY log_id, interval_idx ORDER BY i) AS prev FROM (SELECT log_id, interval_idx, {_STEP} AS action, i, CASE WHEN kind = 'change' THEN i END AS s, CASE WHEN kind = 'change' THEN i + 1 END AS e FROM (
   SELECT *, row_number() OVER (PARTITION BY log_id, interval_idx ORDER BY pos) - 1 AS i FROM {_ISL} WHERE closed AND kind IN ('change', 'saida_testar', 'submit'))))) GROUP BY ALL)"""
_BINNED = f"""(SELECT log_id, interval_idx, bin, CASE WHEN count(*) FILTER (action = 'edit') > 0 THEN 'edit' ELSE 'local_run' END AS action, min(s) AS s, max(e) AS e FROM (SELECT *, CASE WHEN n + 1 > 8 THEN len(list_filter(range(1, 7), lambda b: floor(b * n / 7) <= k)) ELSE k END AS bin
   FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY log_id, interval_idx ORDER BY g) - 1 AS k FROM {_MERGED} WHERE action <> 'submit' WINDOW w AS (PARTITION BY log_id, interval_idx))) GROUP BY ALL)"""
_JSON = """CASE WHEN action = 'edit' THEN '{"action":"edit","start":' || s || ',"end":' || e || '}' ELSE '{"action":"local_run"}' END"""
_PATH = f"""SELECT m.log_id, m.interval_idx, '[' || coalesce(p || ',', '') || '{{"action":"submit"}}]' AS path FROM (SELECT DISTINCT log_id, interval_idx FROM {_MERGED}) m LEFT JOIN (
   SELECT log_id, interval_idx, string_agg({_JSON}, ',' ORDER BY g) AS p FROM (SELECT log_id, interval_idx, g, any_value(action) AS action, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN action = prev THEN 0 ELSE 1 END) OVER (PARTITION BY log_id, interval_idx ORDER BY bin) AS g
   FROM (SELECT *, lag(action) OVER (PARTITION BY log_id, interval_idx ORDER BY bin) AS prev FROM {_BINNED})) GROUP BY ALL) GROUP BY log_id, interval_idx) p USING (log_id, interval_idx)"""


@query(_PATH)
def f23_f24_binned_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of at most 8 merged steps."""
    r = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind").withColumn("steps", _step_array())
    return r.select("log_id", "interval_idx", F.to_json(S.binned_steps(F.col("steps"), 8)).alias("path"))


@query(f"""SELECT event_id, CASE WHEN len(output_lines) > 4 THEN output_lines[1:1] || ['... truncated ' || CAST(len(output_lines) - 3 AS VARCHAR) || ' stdout lines ...'] || output_lines[len(output_lines) - 1:len(output_lines)] ELSE output_lines END AS shown
   FROM (SELECT DISTINCT event_id, output_lines FROM raw_trace_event) WHERE output_lines IS NOT NULL""")
def f12_truncated_output(spark: SparkSession, root: str) -> DataFrame:
    """Program output with its middle left out."""
    r = table(spark, root, "raw_trace_event").where("output_lines IS NOT NULL").select("event_id", "output_lines").distinct()
    return r.select("event_id", I.truncated(F.col("output_lines"), 4).alias("shown"))


def tape_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each closed interval's kinds, all of them, next to those of the log's next one."""
    m = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind").select("log_id", "interval_idx", F.col("kinds").alias("a"))
    return m.withColumn("b", F.lead("a").over(Window.partitionBy("log_id").orderBy("interval_idx"))).where("b IS NOT NULL")


_PAIRS = f"(SELECT * FROM (SELECT log_id, interval_idx, kinds AS a, lead(kinds) OVER (PARTITION BY log_id ORDER BY interval_idx) AS b FROM {_MOTIFS}) WHERE b IS NOT NULL)"


_CHARS = "array_to_string(list_transform({}, lambda k: CASE k WHEN 'change' THEN 'c' WHEN 'saida_testar' THEN 'r' WHEN 'submit' THEN 's' WHEN 'kill_program' THEN 'k' WHEN 'keyhandled' THEN 'h' ELSE 't' END), '')"


@query(f"SELECT log_id, interval_idx, round(1 - levenshtein({_CHARS.format('a')}, {_CHARS.format('b')}) / greatest(len(a), len(b)), 9) AS edit_similarity FROM {_PAIRS}")
def j39_edit_similarity(spark: SparkSession, root: str) -> DataFrame:
    """Edit similarity of neighbouring tapes."""
    p = tape_pairs(spark, root)
    return p.select("log_id", "interval_idx", F.round(S.edit_similarity(F.col("a"), F.col("b")), 9).alias("edit_similarity"))


@query(f"""WITH p AS {_PAIRS}, t AS {sequence_tables('p', 'log_id, interval_idx')} SELECT log_id, interval_idx, round(1 - levenshtein({_CHARS.format('a')}, {_CHARS.format('b')}) / greatest(len(a), len(b)), 9) AS edit_similarity,
   round(lcs / greatest(len(a), len(b)), 9) AS lcss, round(greatest(0, 1 - dtw / greatest(len(a), len(b))), 9) AS dtw FROM p JOIN t USING (log_id, interval_idx)""")
def j39_j41_sequence_similarity(spark: SparkSession, root: str) -> DataFrame:
    """Edit similarity, longest common subsequence and time warping of neighbouring tapes."""
    p = tape_pairs(spark, root)
    a, b = F.col("a"), F.col("b")
    return p.select("log_id", "interval_idx", F.round(S.edit_similarity(a, b), 9).alias("edit_similarity"), F.round(S.lcss_ratio(a, b), 9).alias("lcss"),
                    F.round(S.dtw_similarity(a, b), 9).alias("dtw"))


_OVER = "list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda z: z = x)))))"


@query(f"""SELECT log_id, interval_idx, round({_OVER} / (len(a) + len(b) - {_OVER}), 9) AS jaccard,
   CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS BIGINT) AS prefix, a[1:3] = b[1:3] AS same3 FROM {_PAIRS}""")
def j42_j44_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Multiset Jaccard and shared prefixes of neighbouring tapes."""
    p = tape_pairs(spark, root)
    a, b = F.col("a"), F.col("b")
    return p.select("log_id", "interval_idx", F.round(S.multiset_jaccard(a, b), 9).alias("jaccard"), S.shared_prefix(a, b).cast("bigint").alias("prefix"), S.same_prefix(a, b, 3).alias("same3"))


def _bucket(name: str, kind: str) -> str:
    n = f"len(list_filter(kinds, lambda k: k = '{kind}'))"
    return f"'{name}=' || CASE WHEN {n} >= 3 THEN '3+' ELSE CAST({n} AS VARCHAR) END"


@query(f"SELECT log_id, interval_idx, {_bucket('edit', 'change')} || '|' || {_bucket('run', 'saida_testar')} || '|pause=0' AS buckets FROM {_MOTIFS}")
def j48_c21_count_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Buckets of the numbers of edits, runs and pauses."""
    r = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind")
    return r.select("log_id", "interval_idx", S.count_tuple(F.col("kinds")).alias("buckets"))


@query("""SELECT log_id, submit_index_0idx, min(line) AS start, max(line) AS "end" FROM (SELECT *, line - row_number() OVER (PARTITION BY log_id, submit_index_0idx ORDER BY line) AS g
   FROM (SELECT DISTINCT log_id, submit_index_0idx, from_line_0idx AS line FROM change_micro_event WHERE from_line_0idx IS NOT NULL)) GROUP BY log_id, submit_index_0idx, g""")
def j34_contiguous_lines(spark: SparkSession, root: str) -> DataFrame:
    """Spans of consecutive touched lines."""
    c = table(spark, root, "change_micro_event").where("from_line_0idx IS NOT NULL").withColumnRenamed("from_line_0idx", "line")
    return I.contiguous(c, ["log_id", "submit_index_0idx"], "line")


_HISTORY = "(SELECT log_id, list({'t': transition_index_0idx, 'r': visible_run_count} ORDER BY transition_index_0idx) AS h FROM (SELECT DISTINCT log_id, transition_index_0idx, visible_run_count FROM candidate_transition) GROUP BY log_id)"


@query(f"""SELECT log_id, array_to_string(list_transform(h, lambda x, i: 'Attempt ' || i || chr(10) || 'transition_index_0idx: ' || x.t || chr(10) || 'visible_run_count: ' || x.r), chr(10) || chr(10)) AS text FROM {_HISTORY}""")
def j73_rendered_history(spark: SparkSession, root: str) -> DataFrame:
    """A log's visible history as text."""
    from tapeloom.functions.words import rendered

    fields = ["transition_index_0idx", "visible_run_count"]
    t = table(spark, root, "candidate_transition").select("log_id", *fields).distinct()
    h = t.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("h"))
    return h.select("log_id", rendered(F.col("h"), fields).alias("text"))


@query("""SELECT log_id, transition_index_0idx, CASE WHEN b IS NULL THEN 'first visible attempt with ' || r || ' passing tests' WHEN r > b THEN 'pass count improved from ' || b || ' to ' || r WHEN r < b THEN 'pass count dropped from ' || b || ' to ' || r ELSE 'pass count stayed at ' || r END AS note
   FROM (SELECT log_id, transition_index_0idx, r, lag(r) OVER (PARTITION BY log_id ORDER BY transition_index_0idx) AS b FROM (SELECT log_id, transition_index_0idx, min(visible_run_count) AS r FROM candidate_transition GROUP BY ALL))""")
def j36_progress_notes(spark: SparkSession, root: str) -> DataFrame:
    """Note on what became of a count since the attempt before."""
    from tapeloom.functions.words import progress_note

    t = table(spark, root, "candidate_transition").groupBy("log_id", "transition_index_0idx").agg(F.min("visible_run_count").alias("r"))
    b = F.lag("r").over(Window.partitionBy("log_id").orderBy("transition_index_0idx"))
    return t.withColumn("b", b).select("log_id", "transition_index_0idx", progress_note(F.col("b"), F.col("r")).alias("note"))


@query("SELECT delivery_id, CAST(round_even(date_diff('microsecond', (SELECT min(received_ts) FROM scored_row), received_ts) / 1e3, 0) AS BIGINT) AS ms FROM scored_row")
def j74_milliseconds(spark: SparkSession, root: str) -> DataFrame:
    """Milliseconds since the first delivery."""
    from tapeloom.functions.words import milliseconds_between

    r = table(spark, root, "scored_row")
    first = r.agg(F.min("received_ts")).first()[0]  # one value
    return r.select("delivery_id", milliseconds_between(F.col("received_ts"), F.lit(first)).alias("ms"))


_LIFT = f"""WITH m AS (SELECT log_id, motif FROM {_MOTIFS}), g AS (SELECT motif FROM m GROUP BY motif ORDER BY count(*) DESC, motif LIMIT 1),
  r AS (SELECT log_id, count(*) AS n, CAST(count(*) FILTER (motif = own) AS BIGINT) AS own_hits, CAST(count(*) FILTER (motif = (SELECT motif FROM g)) AS BIGINT) AS global_hits FROM (
    SELECT m.*, o.own FROM m JOIN (SELECT log_id, arg_min(motif, (-c, motif)) AS own FROM (SELECT log_id, motif, count(*) AS c FROM m GROUP BY ALL) GROUP BY log_id) o USING (log_id)) GROUP BY log_id)
  SELECT log_id, n, own_hits, global_hits, round((own_hits - global_hits) / n, 9) AS lift FROM r"""


@query(_LIFT)
def motif_lift(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: how much better a log's own commonest motif predicts its intervals than that of all logs."""
    m = I.interval_motifs(events(spark, root), ["log_id"], ORDER, "kind").select("log_id", "motif")
    per_log = written(m.groupBy("log_id", "motif").agg(F.count(F.lit(1)).alias("c")), "motifs")  # three branches read it
    per_all = per_log.groupBy("motif").agg(F.sum("c").alias("c"))
    first = per_all.orderBy(F.desc("c"), "motif").limit(1).select(F.col("motif").alias("top"))
    own = per_log.groupBy("log_id").agg(F.min_by("motif", F.struct((-F.col("c")).alias("c"), "motif")).alias("own"))
    hits = per_log.join(own, "log_id").join(F.broadcast(first), F.col("motif") == F.col("top"), "left")
    return hits.groupBy("log_id").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("motif") == F.col("own"), F.col("c")).otherwise(0)).alias("own_hits"),
        F.sum(F.when(F.col("top").isNotNull(), F.col("c")).otherwise(0)).alias("global_hits"),
    ).withColumn("lift", F.round((F.col("own_hits") - F.col("global_hits")) / F.col("n"), 9))
