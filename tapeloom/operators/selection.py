"""Selection of cohorts: strata, quotas, samplers, round robin, representatives, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.shared import first_rows


def tertiles(rows: DataFrame, value: str) -> DataFrame:
    """`rows` with tertile T1, T2 or T3 by the linear quantiles .33 and .67 of `value`, equal values to the lower; null stays null."""
    low, high = rows.agg(F.percentile(value, 0.33), F.percentile(value, 0.67)).first()  # two numbers
    v = F.col(value)
    if low is None:
        return rows.withColumn("tertile", F.lit(None).cast("string"))
    return rows.withColumn("tertile", F.when(v <= low, "T1").when(v <= high, "T2").when(v.isNotNull(), "T3"))


def fixed_bins(value: Column, cuts: list[float]) -> Column:
    """Number of the half-open bin between cuts, from 0; null for null."""
    return F.when(value.isNotNull(), sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0)))


def quotas(target: int, strata: list[str]) -> dict[str, int]:
    """A target split evenly, the rest to the first strata."""
    return {s: target // len(strata) + (k < target % len(strata)) for k, s in enumerate(strata)}


def rebalanced(wanted: dict[str, int], available: dict[str, int]) -> dict[str, int]:
    """Quotas as far as strata go, what is missing taken one by one from the stratum with most left, ties by name."""
    take = {s: min(n, available.get(s, 0)) for s, n in wanted.items()}
    missing = sum(wanted.values()) - sum(take.values())
    while missing > 0:
        left = {s: available.get(s, 0) - take[s] for s in take}
        best = min(left, key=lambda s: (-left[s], s))
        if left[best] <= 0:
            break
        take[best] += 1
        missing -= 1
    return take


def stratified_sample(rows: DataFrame, stratum: str, key: str, target: int, seed: int, strata: list[str]) -> DataFrame:
    """Rows by quota per stratum in the order of a seeded hash of `key`; only the numbers of the strata are collected."""
    have = {r[stratum]: r["n"] for r in rows.where(F.col(stratum).isin(*strata)).groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    take = rebalanced(quotas(target, strata), have)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in take.items() for x in kv]), F.col(stratum))
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key]
    return first_rows(rows.where(F.col(stratum).isin(*strata)), [stratum], order, max(take.values()), "pick").where(F.col("pick") <= limit)


def matched_groups(rows: DataFrame, scope: list[str], signature: str, actor: str) -> DataFrame:
    """Rows whose (scope, signature) has two actors or more."""
    per = rows.where(F.col(signature).isNotNull()).groupBy(*scope, signature).agg(F.count_distinct(actor).alias("n_actors"))
    return rows.join(per.where("n_actors >= 2"), [*scope, signature])


def dropped_scopes(rows: DataFrame, scope: list[str], signature: str, actor: str) -> DataFrame:
    """(scope, reason) of the scopes without a matched group: no_signature, one_actor or no_shared_state."""
    state = rows.groupBy(*scope).agg(F.count_distinct(actor).alias("a"), F.count(signature).alias("s"))
    kept = matched_groups(rows, scope, signature, actor).select(*scope).distinct()
    reason = F.when(F.col("s") == 0, "no_signature").when(F.col("a") < 2, "one_actor").otherwise("no_shared_state")
    return state.join(kept, scope, "left_anti").select(*scope, reason.alias("reason"))


def round_robin(rows: DataFrame, slice_: list[str], actor: str, order: list[str], count: int | None = None, good: Column | None = None) -> DataFrame:
    """Rows with `turn`, the order in which slices take turns, and inside a slice its actors; the first `count` if given.

    A row for which `good` doesn't hold takes its slice's turn but isn't chosen.
    """
    mine = Window.partitionBy(*slice_, actor).orderBy(*order)
    inside = Window.partitionBy(*slice_).orderBy("_k", actor)
    laid = rows.withColumn("_k", F.row_number().over(mine)).withColumn("cycle", F.row_number().over(inside)).drop("_k")
    if good is not None:
        laid = laid.where(good)
    return laid.orderBy("cycle", *slice_).limit(count) if count is not None else laid


def deepest(rows: DataFrame, keys: list[str], depth: str) -> DataFrame:
    """The row of each key with the largest depth, the first one if there are just two."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.max_by(whole, depth).alias("d"), F.min_by(whole, depth).alias("f"), F.count(F.lit(1)).alias("n"))
    return best.select(F.when(F.col("n") == 2, F.col("f")).otherwise(F.col("d")).alias("r")).select("r.*")


def history_first(rows: DataFrame, attempts: Column, order: list[str], count: int) -> DataFrame:
    """`count` rows, those with three attempts or more before those with two."""
    return rows.where(attempts >= 2).withColumn("_p", F.when(attempts >= 3, 0).otherwise(1)).orderBy("_p", *order).limit(count).drop("_p")


def representatives(rows: DataFrame, group: list[str], order: list[str], most: int = 10) -> DataFrame:
    """The middle row (n // 2 in order) of each of the `most` largest groups, ties by key, with alias S01, S02, ..."""
    per = Window.partitionBy(*group)
    ranked = rows.withColumn("group_size", F.count(F.lit(1)).over(per)).withColumn("_k", F.row_number().over(per.orderBy(*order)) - 1)
    middle = ranked.where(F.col("_k") == F.floor(F.col("group_size") / 2)).drop("_k")
    top = middle.orderBy(F.desc("group_size"), *group).limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("group_size"), *group))  # at most `most` rows
    return top.withColumn("alias", F.format_string("S%02d", place))


def extremes(rows: DataFrame, value: str, tie: list[str], k: int = 5) -> DataFrame:
    """The k lowest and the k highest rows, with end low or high."""
    live = rows.where(F.col(value).isNotNull())
    return live.orderBy(value, *tie).limit(k).withColumn("end", F.lit("low")).unionByName(live.orderBy(F.desc(value), *tie).limit(k).withColumn("end", F.lit("high")))


def funnel(rows: DataFrame, keys: list[str], stages: dict[str, Column]) -> DataFrame:
    """Numbers that pass each of the stages, one after another, with the share of all and of the stage before."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n_all")]
    for name, ok in stages.items():
        passed = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n_{name}"))
    out = rows.groupBy(*keys).agg(*counts) if keys else rows.agg(*counts)
    before = "n_all"
    for name in stages:
        out = out.withColumn(f"share_{name}", F.col(f"n_{name}") / F.nullif(F.col("n_all"), F.lit(0)))
        out = out.withColumn(f"step_{name}", F.col(f"n_{name}") / F.nullif(F.col(before), F.lit(0)))
        before = f"n_{name}"
    return out


def reasons(rows: DataFrame, reason: str, example: str, most: int = 10) -> DataFrame:
    """(reason, n, examples): number of rows and the first `most` ids for each reason."""
    live = rows.where(F.col(reason).isNotNull())
    few = first_rows(live.select(reason, example), [reason], [example], most, "_k")
    examples = few.groupBy(reason).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return live.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).join(examples, reason)


def ranked_slices(rows: DataFrame, order: list[Column], minimum: Column | None = None, count: int | None = None) -> DataFrame:
    """Rows that meet `minimum` in a mixed-direction order, the first `count` if given."""
    live = rows.where(minimum) if minimum is not None else rows
    out = live.orderBy(*order)
    return out.limit(count) if count is not None else out


def scope_profile(rows: DataFrame, scope: list[str], actor: str, code: str) -> DataFrame:
    """(scope, n_students, distinct_codes, top_share, canonical_80): how alike the final programs of a scope are."""
    per = rows.where(F.col(code).isNotNull()).groupBy(*scope, F.sha2(code, 256).alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    codes = per.groupBy(*scope).agg(F.count(F.lit(1)).alias("distinct_codes"), (F.max("n") / F.sum("n")).alias("top_share"))
    students = rows.groupBy(*scope).agg(F.count_distinct(actor).alias("n_students"))
    return students.join(codes, scope, "left").withColumn("canonical_80", F.col("top_share") >= 0.8)


ENCODING_LIMITS = {"chars": 900_000, "events": 2_000, "raw_events": 8_000}


def encoding_case(n_events: Column, n_submits: Column, n_changes: Column, n_runs: Column) -> Column:
    """submit_only, run_heavy_no_change, large_dense or repair_focused, the first that holds."""
    return (
        F.when((n_events <= 1) & (n_submits == 1) & (n_changes == 0), "submit_only")
        .when((n_changes == 0) & (n_runs >= 1), "run_heavy_no_change")
        .when((n_events >= 400) | (n_changes >= 350), "large_dense")
        .otherwise("repair_focused")
    )


def encoding_flags(n_events: Column, n_changes: Column, n_runs: Column, n_gaps: Column, n_kills: Column) -> Column:
    """The flags that hold."""
    flags = {
        "very_small_event_log": n_events <= 5, "no_code_edits": n_changes == 0, "run_heavy_with_few_edits": (n_runs >= 2) & (n_changes < 3),
        "many_idle_gaps": n_gaps >= 20, "many_local_runs": n_runs >= 20, "contains_kill_program": n_kills >= 1,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
