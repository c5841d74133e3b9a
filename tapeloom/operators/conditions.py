"""Conditions: what of a nested history a reader may see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOSAGES = {"dosage_25": 0.25, "dosage_50": 0.5, "dosage_75": 0.75}


def visible(attempts: Column, condition: str, trace: str = "trace", donor: Column | None = None) -> Column:
    """An array of attempt structs under a condition: full keeps `trace`, no_trace nulls it, dosage_25/50/75 keep it for
    the last ceil(n f) attempts (one at least), shuffled puts a donor's traces, by place, in its stead."""
    if condition == "full":
        return attempts
    if condition == "no_trace":
        return F.transform(attempts, lambda a: a.withField(trace, F.lit(None)))
    if condition in DOSAGES:
        n = F.size(attempts)
        keep = F.greatest(F.lit(1), F.ceil(n * DOSAGES[condition]).cast("int"))
        return F.transform(attempts, lambda a, i: a.withField(trace, F.when(i >= n - keep, a[trace])))
    if condition == "shuffled" and donor is not None:
        return F.transform(attempts, lambda a, i: a.withField(trace, F.get(donor, i)))
    raise ValueError(f"unknown condition {condition}")


def without_trace(attempts: Column, trace: str = "trace") -> Column:
    """The attempts without the field `trace` at all."""
    return F.transform(attempts, lambda a: a.dropFields(trace))


def windowed(attempts: Column, indexes: Column, trace: str = "trace") -> Column:
    """Traces of the attempts whose place is in `indexes`; null for the others."""
    return F.transform(attempts, lambda a, i: a.withField(trace, F.when(F.array_contains(indexes, i), a[trace])))


def leak(attempts: Column, condition: str, trace: str = "trace") -> Column:
    """unknown_condition, missing_condition or trace_left_in; null for a payload that keeps its contract."""
    left = F.exists(attempts, lambda a: a[trace].isNotNull())
    known = condition in ("full", "no_trace", "shuffled", *DOSAGES)
    if not known:
        return F.lit("unknown_condition" if condition else "missing_condition")
    return F.when(left, "trace_left_in") if condition == "no_trace" else F.lit(None).cast("string")
