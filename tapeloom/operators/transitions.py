"""Transitions from one attempt to the next: attempts, replayed blocks and tapes composed into one row each, with the
stage at which a row fails as data; what is observed, what a reader may see, and donors of whole tapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import code as C
from tapeloom.functions import diff as D
from tapeloom.operators import replay as R
from tapeloom.operators.contracts import step_problem
from tapeloom.shared import beside

#: The stages of a row, in order; the first that doesn't hold is its reason.
STAGES = ("attempts", "replayed", "aligned", "immediate", "edited", "path")


def contexts(attempts: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_attempts, n_blocks, reason) of every log: too_few_attempts, not_replayed, or null where its transitions can
    be built. `attempts` is (keys, attempt, code, ...), `blocks` the output of `replay.replayed_blocks`."""
    a = attempts.groupBy(*keys).agg(F.count_if(F.col("code").isNotNull()).alias("n_attempts"))
    b = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    both = a.join(b, keys, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    return both.withColumn("reason", F.when(F.col("n_attempts") < 2, "too_few_attempts").when(F.col("n_blocks") == 0, "not_replayed"))


def transition_table(attempts: DataFrame, blocks: DataFrame, keys: list[str], mode: str = "narrow") -> DataFrame:
    """One row for each attempt that has a next one: both programs and result vectors, the snapshots they are aligned with,
    the block that led to the next one, a flag for each stage, and the reason of a row that isn't admissible.

    A log's attempts (keys, attempt, code, vector) are aligned with its snapshots as a whole: only one increasing choice may
    fit, the next program's snapshot must follow at once and its block must hold an edit that changes the program and a
    path. Programs are compared in the normal form `mode`, or letter for letter if it is "exact". Attempts with null
    programs end no transition; a log without blocks fails at `replayed`.
    """
    w = Window.partitionBy(*keys).orderBy("attempt")
    live = attempts.where(F.col("code").isNotNull())
    rows = live.select(
        *keys, "attempt", (F.row_number().over(w) - 1).alias("place"), F.col("code").alias("code_n"), F.col("vector").alias("vector_n"),
        F.lead("code").over(w).alias("code_n1"), F.lead("vector").over(w).alias("vector_n1"),
    ).where("code_n1 IS NOT NULL")
    snapshots = blocks.select(*keys, "submit_index", "code")
    if mode == "exact":
        a = live.select(*keys, "attempt", F.sha2("code", 256).alias("h"))
        s = snapshots.select(*keys, "submit_index", F.sha2("code", 256).alias("h"))
        candidates = a.join(s, [*keys, "h"], "left").groupBy(*keys, "attempt").agg(F.array_sort(F.collect_list("submit_index")).alias("candidates"))
    else:
        candidates = R.snapshot_candidates(live, snapshots, keys, mode)
    whole = R.aligned(candidates, keys)
    place = rows.join(whole, keys, "left").withColumns({"snap_n": F.get("alignment", F.col("place")), "snap_n1": F.get("alignment", F.col("place") + 1)})
    block = blocks.select(
        *keys, F.col("submit_index").alias("snap_n1"), "start_code", F.col("code").alias("snap_code"), "n_changes", "n_runs", "first_line", "steps", "steps_reason"
    )
    some = blocks.select(*keys).distinct().withColumn("_some", F.lit(True))
    met = place.join(block, [*keys, "snap_n1"], "left").join(some, keys, "left")
    false = F.lit(False)
    flags = {
        "attempts": F.lit(True),
        "replayed": F.coalesce("_some", false),
        "aligned": F.coalesce(F.col("status") == "matched", false),
        "immediate": F.coalesce(F.col("snap_n1") == F.col("snap_n") + 1, false),
        "edited": F.coalesce((F.col("n_changes") > 0) & (F.col("start_code") != F.col("snap_code")), false),
        "path": F.coalesce(F.col("steps_reason").isNull() & (F.size("steps") > 0), false),
    }
    named = met.withColumns({f"is_{k}": c for k, c in flags.items()})
    reason = F.coalesce(*[F.when(~F.col(f"is_{k}"), F.lit(f"not_{k}")) for k in STAGES])
    return named.withColumn("reason", reason).drop("_some", "alignment", "place", "start_code", "snap_code")


def admissible(table: DataFrame) -> DataFrame:
    """The rows that pass all stages."""
    return table.where("reason IS NULL")


def stage_report(table: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(stage, n_passed, share, n_failed_here, examples): how many rows pass each stage and all before it, and the first ids
    (the keys and the attempt, joined by colons) of those that fail there."""
    row_id = F.concat_ws(":", *keys, "attempt")
    total = table.agg(F.count(F.lit(1)).alias("_total"))
    parts = []
    passed = F.lit(True)
    for k in STAGES:
        passed = passed & F.col(f"is_{k}")
        here = F.col("reason") == f"not_{k}"
        first = table.where(here).select(row_id.alias("id")).orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id")).alias("examples"))
        counts = table.agg(F.count_if(passed).alias("n_passed"), F.count_if(here).alias("n_failed_here"), F.avg(passed.cast("double")).alias("share"))
        parts.append(beside(counts, first).withColumn("stage", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("stage", "n_passed", "share", "n_failed_here", "examples")


def observed_labels(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempt, outcome, next_outcome, edit_scope, n_lines, region, n_passed, n_passed_next, failed, failed_next): what
    became of each transition of a table, from programs and vectors alone."""
    spans = D.repair_spans_udf("code_n", "code_n1")
    lines = F.aggregate("_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"] + 1)
    rows = table.withColumn("_spans", spans).withColumn("n_lines", lines)
    region = D.focus_region_udf("code_n", F.get("_spans", 0)["start"])
    return rows.select(
        *keys, "attempt", C.outcome_bucket(F.col("vector_n"), F.col("vector_n1")).alias("outcome"), C.next_outcome(F.col("vector_n1")).alias("next_outcome"),
        C.touched_bucket(F.col("n_lines")).alias("edit_scope"), "n_lines", region.alias("region"),
        C.pass_count(F.col("vector_n")).alias("n_passed"), C.pass_count(F.col("vector_n1")).alias("n_passed_next"),
        C.failed_tests(F.col("vector_n")).alias("failed"), C.failed_tests(F.col("vector_n1")).alias("failed_next"),
    )


def repair_targets(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempt, target): struct of both programs, the outcome and the changed spans of the next one."""
    target = F.struct(
        "code_n", "code_n1", C.outcome_bucket(F.col("vector_n"), F.col("vector_n1")).alias("outcome"), D.repair_spans_udf("code_n", "code_n1").alias("spans")
    )
    return table.select(*keys, "attempt", target.alias("target"))


def path_artifacts(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempt, snap_n1, steps, problem): the path of each transition's block, and why there is none or it breaks
    its contract (the block's own reason, no_block, or that of `contracts.step_problem`)."""
    problem = F.when(F.col("steps").isNull(), "no_block").otherwise(F.coalesce("steps_reason", step_problem(F.col("steps"), None, None)))
    return table.select(*keys, "attempt", "snap_n1", "steps", problem.alias("problem"))


_COUNTED = {"change": "n_change", "saida_testar": "n_run", "submit": "n_submit", "kill_program": "n_kill", "keyhandled": "n_key", "tab_click": "n_tab", "idle_gap": "n_gap"}


def semantic_tapes(events: DataFrame, keys: list[str], interval: str, position: str, kind: str) -> DataFrame:
    """(keys, interval, tape, n_events, one count for each of seven kinds, n_tests, problem) of the events of each interval.

    n_tests counts kinds with "test" in their name, local runs among them. problem is unknown_kind, no_submit or
    submit_before_end; null for a tape that ends in its only submit.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(position, kind))), lambda x: x[kind])
    counts = [F.count_if(F.col(kind) == k).alias(n) for k, n in _COUNTED.items()]
    known = F.max((~F.coalesce(F.col(kind).isin(*_COUNTED), F.lit(False))).cast("int"))
    tests = F.count_if((F.lower(F.col(kind)).contains("test")))
    per = events.groupBy(*keys, interval).agg(rows.alias("tape"), F.count(F.lit(1)).alias("n_events"), *counts, tests.alias("n_tests"), known.alias("_odd"))
    problem = (
        F.when(F.col("_odd") == 1, "unknown_kind").when(F.col("n_submit") == 0, "no_submit")
        .when((F.col("n_submit") > 1) | (F.try_element_at("tape", F.lit(-1)) != "submit"), "submit_before_end")
    )
    return per.withColumn("problem", problem).drop("_odd")


def next_episodes(table: DataFrame, tapes: DataFrame, keys: list[str], interval: str = "interval_idx") -> DataFrame:
    """(keys, attempt, tape, n_events and the counts): the tape of the block that led to the next attempt; null columns
    where there is none."""
    of = tapes.withColumnRenamed(interval, "snap_n1").drop("problem")
    return table.select(*keys, "attempt", "snap_n1").join(of, [*keys, "snap_n1"], "left").drop("snap_n1")


def payloads(table: DataFrame, tapes: DataFrame, keys: list[str], condition: str = "full", interval: str = "interval_idx") -> DataFrame:
    """(keys, attempt, payload): what a reader of a transition may see, as JSON: the attempts up to n in order, each with its
    program, passes, outcome of the next one and trace under `condition`, and the tape of attempt n.

    The trace of an attempt is the tape of its block, null where it isn't aligned. A window over a log's own rows
    gathers what came before; a log's attempts, not its events, are held together.
    """
    from tapeloom.operators.conditions import visible

    of = tapes.select(*keys, F.col(interval).alias("snap_n"), F.concat_ws(" ", "tape").alias("trace"))
    w = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    met = table.join(of, [*keys, "snap_n"], "left")
    passes = C.pass_count(F.col("vector_n"))
    entry = F.struct("attempt", F.col("code_n").alias("code"), passes.alias("n_passed"), "trace")
    done = met.withColumn("_h", F.collect_list(entry).over(w)).withColumn("history", visible(F.col("_h"), condition))
    tape = F.col("trace") if condition != "no_trace" else F.lit(None).cast("string")
    return done.select(*keys, "attempt", F.to_json(F.struct("history", tape.alias("tape"))).alias("payload"))


def valid_donors(contexts: DataFrame, blocks: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The logs (keys) whose traces may stand in for another's: parsed, replayed, with `least` blocks or more."""
    return contexts.where(F.col("reason").isNull() & (F.col("n_blocks") >= least)).select(*keys)


def donor_tapes(targets: DataFrame, tapes: DataFrame, target_log: str, donor_log: str, log: str = "log_id", interval: str = "interval_idx") -> DataFrame:
    """(target_log, donor_log, interval, tape): of each target with a donor the donor's tapes of the same intervals as its own."""
    mine = targets.select(target_log, donor_log).join(tapes.select(F.col(log).alias(target_log), interval), target_log)
    theirs = tapes.select(F.col(log).alias(donor_log), interval, "tape")
    return mine.join(theirs, [donor_log, interval], "left").select(target_log, donor_log, interval, "tape")


def transition_specs(specs: DataFrame, spec: str, parts: Sequence[str]) -> DataFrame:
    """(spec, the parts, index, reason) of texts like `a:b:c:3`: wrong_parts, bad_index, or duplicate for all but the first of
    equal ones in the order of `position`; null for a good one. `specs` has the column and position."""
    split = F.split(spec, ":")
    index = F.try_element_at(split, F.lit(-1)).try_cast("int")
    w = Window.partitionBy(spec).orderBy("position")
    reason: Column = (
        F.when(F.size(split) != len(parts) + 1, "wrong_parts").when(F.exists(split, lambda p: p == ""), "wrong_parts")
        .when(index.isNull() | (index < 0), "bad_index").when(F.row_number().over(w) > 1, "duplicate")
    )
    return specs.select(spec, "position", *[F.get(split, k).alias(p) for k, p in enumerate(parts)], index.alias("index"), reason.alias("reason"))
