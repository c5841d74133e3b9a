"""Contracts: checks of keys, schemas and responses that give a reason for each violation, and guards on key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.code import pass_signature


def row_key(custom_id: Column) -> Column:
    """Struct (class_id, student_id, assessment_id, exercise_id, n, valid) of `class:student:assessment:exercise:n`."""
    parts = F.split(custom_id, ":")
    part = lambda k: F.get(parts, k)
    n = part(4).try_cast("int")
    ok = (F.size(parts) == 5) & F.forall(parts, lambda p: p != "") & n.isNotNull()
    return F.struct(
        part(0).alias("class_id"), part(1).alias("student_id"), part(2).alias("assessment_id"),
        part(3).alias("exercise_id"), n.alias("n"), F.coalesce(ok, F.lit(False)).alias("valid"),
    )


def signature_problem(vector: Column, signature: Column) -> Column:
    """missing or signature_differs; null if the signature is that of the vector."""
    return F.when(vector.isNull() | signature.isNull(), "missing").when(
        pass_signature(vector) != signature, "signature_differs"
    )


def probability_problem(p: Column, least: int, most: int, tolerance: float) -> Column:
    """Why an array of probabilities isn't a distribution over `least` to `most` hypotheses; null if it is."""
    count = "not_three" if least == most == 3 else "wrong_number"
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(p.isNull(), "missing")
        .when((F.size(p) < least) | (F.size(p) > most), count)
        .when(F.exists(p, lambda x: (x <= 0) | (x > 1) | F.isnan(x)), "out_of_range")
        .when(F.abs(total - 1) > tolerance, "not_one")
    )


def step_problem(steps: Column, most: int | None = 8, sentinel: int | None = -1) -> Column:
    """Why an array of steps (action, start, end) isn't a path; null if it is.

    Edits need lines of at least 0 in order; other steps have null lines, or `sentinel`.
    A path ends in its only submit and has at most `most` steps.
    """
    blank = lambda x: x.isNull() if sentinel is None else x.isNull() | (x == sentinel)
    good = lambda s: F.coalesce(
        F.when(s["action"] == "edit", (s["start"] >= 0) & (s["end"] >= s["start"])).otherwise(
            s["action"].isin("local_run", "submit") & blank(s["start"]) & blank(s["end"])
        ),
        F.lit(False),
    )
    n = F.size(steps)
    last = F.try_element_at(steps, F.lit(-1))
    return (
        F.when(steps.isNull() | (n < 1), "empty")
        .when(n > most if most else F.lit(False), "too_long")
        .when(~F.forall(steps, good), "bad_step")
        .when(last["action"] != "submit", "no_submit_at_end")
        .when(F.size(F.filter(steps, lambda s: s["action"] == "submit")) != 1, "submit_before_end")
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that stand in more than one row, with their number; no rows if the keys are unique."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with side `left` or `right`; nulls match nulls; no rows if the sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def column_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column_name) of every column that differs between two tables with the same keys; null equals null."""
    b = right.select(*keys, *[F.col(c).alias(f"{c}__right") for c in columns])
    bad = [F.when(~F.col(c).eqNullSafe(F.col(f"{c}__right")), F.lit(c)) for c in columns]
    return (
        left.select(*keys, *columns).join(b, keys).select(*keys, F.explode(F.array_compact(F.array(*bad))).alias("column_name"))
    )


def require_none(violations: DataFrame, what: str) -> None:
    """Raise with an example if there is any violation; looks at one row only."""
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def expectations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, n_violations, holds) of named tables of violations, zeros included."""
    parts = [v.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(k).alias("check_name"), "n_violations") for k, v in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("holds", F.col("n_violations") == 0)


def strict_pairs(left: DataFrame, right: DataFrame, keys: list[str], same: list[str] | None = None) -> DataFrame:
    """Inner join on unique keys that both sides share exactly and with equal columns `same`; anything else is an error.

    Columns of the right side other than the keys and `same` get the suffix _right.
    """
    require_none(duplicate_keys(left, keys), "repeated key on the left")
    require_none(duplicate_keys(right, keys), "repeated key on the right")
    require_none(key_differences(left, right, keys), "key of one side only")
    if same:
        require_none(column_differences(left, right, keys, same), "different values")
    drop = [*keys, *(same or [])]
    return left.join(right.select(*keys, *[F.col(c).alias(f"{c}_right") for c in right.columns if c not in drop]), keys)


def missing_json_keys(document: Column, keys: list[str]) -> Column:
    """The keys of `keys` that a JSON object hasn't, in order; all of them for text that is no object."""
    have = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, keys)), have)


def event_problem(kind: Column, payload: Column, kinds: list[str]) -> Column:
    """unknown_kind, bad_change (a change without the JSON of a range and its text) or no_key (a handled key without a name);
    null for an event that keeps its kind's contract."""
    line = lambda side: F.get_json_object(payload, f"$.{side}.line").try_cast("int").isNull() | F.get_json_object(payload, f"$.{side}.ch").try_cast("int").isNull()
    bad = F.get_json_object(payload, "$.text").isNull() | line("from") | line("to")
    return (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "unknown_kind").when((kind == "change") & F.coalesce(bad, F.lit(True)), "bad_change")
        .when((kind == "keyhandled") & (F.coalesce(F.trim(payload), F.lit("")) == ""), "no_key")
    )


def response_problem(n: Column, total: Column, least_p: Column, most_p: Column, longest: Column, tolerance: float, fewest: int = 2, most: int = 5, most_events: int | None = None) -> Column:
    """Why a response of several hypotheses breaks its contract: wrong_number, out_of_range, not_one or too_long; null if it doesn't."""
    long = (longest > most_events) if most_events is not None else F.lit(False)
    return (
        F.when((n < fewest) | (n > most), "wrong_number").when((least_p <= 0) | (most_p > 1), "out_of_range")
        .when(F.abs(total - 1) > tolerance, "not_one").when(long, "too_long")
    )


def exact_lookup(slots: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The slots with the number of rows that match each, and no_match or several_matches where it isn't one; null for a good slot."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"))
    met = slots.join(n, keys, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return met.withColumn("reason", F.when(F.col("n_matches") == 0, "no_match").when(F.col("n_matches") > 1, "several_matches"))


def ordered_distinct(text: str) -> list[str]:
    """The names of a comma-separated list, each once, in the order they are first given."""
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def thresholds(text: str) -> list[float]:
    """The sorted distinct numbers of a comma-separated list; one outside [0, 1] is an error."""
    found = sorted({float(x) for x in ordered_distinct(text)})
    if any(not 0 <= x <= 1 for x in found):
        raise ValueError(f"thresholds outside [0, 1]: {text}")
    return found


def key_set_problem(keys: Column, expected: list) -> Column:
    """missing_key or unexpected_key of an array of keys against the expected ones; null if the sets are equal."""
    want = F.array(*map(F.lit, expected))
    return F.when(F.size(F.array_except(want, keys)) > 0, "missing_key").when(F.size(F.array_except(keys, want)) > 0, "unexpected_key")


def error_class(message: Column, classes: dict[str, str]) -> Column:
    """The class of an error message: that of the first pattern it matches, else other; null for null."""
    hit = F.coalesce(*[F.when(message.rlike(p), F.lit(k)) for k, p in classes.items()], F.lit("other"))
    return F.when(message.isNotNull(), hit)
