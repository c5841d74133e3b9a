"""Column expressions on arrays: similarities of sequences, run compression, motifs. All run in the JVM but the three
dynamic programmes, whose tables higher-order functions copy at every cell: Arrow UDFs, fit for sequences of any length."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.code import overlap
from tapeloom.functions.diff import distance

#: The family of each kind of event.
FAMILIES = {
    "change": "edit",
    "saida_testar": "run",
    "submit": "submit",
    "kill_program": "runtime",
    "keyhandled": "navigate",
    "tab_click": "navigate",
    "idle_gap": "pause",
}


#: Handled keys that change or leave a line.
MEANINGFUL_KEYS = ("Enter", "Backspace", "Tab", "Delete", "Insert")


def is_semantic(kind: Column, payload: Column, keys: bool = False, navigation: bool = True) -> Column:
    """Whether an event belongs on a tape: edits, runs, submits and kills do; tab clicks with `navigation`, handled
    keys with `keys` if they are among the meaningful ones."""
    always = kind.isin("change", "saida_testar", "submit", "kill_program")
    key = (kind == "keyhandled") & F.trim(payload, F.lit('"')).isin(*MEANINGFUL_KEYS)
    return F.coalesce(always | ((kind == "tab_click") & F.lit(navigation)) | (key & F.lit(keys)), F.lit(False))


def event_kind(raw_type: Column) -> Column:
    """One spelling of a raw type: lower case, `_` for `-`, kill as kill_program."""
    c = F.regexp_replace(F.lower(F.trim(raw_type)), "-", "_")
    return F.when(c == "kill", "kill_program").otherwise(c)


def event_family(kind: Column) -> Column:
    """The family of a kind of event; null for one that has none."""
    pairs = [F.lit(x) for kv in FAMILIES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), kind)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all, counted with multiplicity; 1 for two empty arrays."""
    s = overlap(a, b)
    every = F.size(a) + F.size(b) - s
    return F.when(every == 0, 1.0).otherwise(s / every)


def _spelled(a, b) -> tuple[str, str]:
    """Both sequences with a character for each element; a null is like no other element."""
    seen, fresh = {}, count(0x10000)
    spell = lambda xs: "".join(chr(next(fresh) if x is None else seen[x] if x in seen else seen.setdefault(x, next(fresh))) for x in xs)
    return spell(a), spell(b)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table at a time, as the bits where it doesn't rise."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def warping_cost(a: str, b: str) -> int:
    """Least number of unequal pairs on a warping path over two texts that aren't empty."""
    far = len(a) + len(b)
    row = [0] + [far] * len(b)
    for x in a:
        diag, left, new = row[0], far, [far]
        for y, up in zip(b, row[1:]):
            left = min(up, left, diag) + (x != y)
            new.append(left)
            diag = up
        row = new
    return row[-1]


def _each(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None or not len(x) or not len(y) else f(*_spelled(x, y)) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(distance, a, b)


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(common_length, a, b)


@F.pandas_udf(T.LongType())
def _warping(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(warping_cost, a, b)


def _guard(a: Column, b: Column, value: Column, empty: float) -> Column:
    """`value` where neither array is empty; 1 if both are, else `empty`; null if one is null."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), empty)
        .otherwise(value)
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length."""
    return _guard(a, b, 1 - _edits(a, b) / F.greatest(F.size(a), F.size(b)), 0.0)


def lcss_ratio(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence over the longer length."""
    return _guard(a, b, _common(a, b) / F.greatest(F.size(a), F.size(b)), 0.0)


def dtw_similarity(a: Column, b: Column) -> Column:
    """1 - time-warping cost / longer length, at least 0; a step costs 1 where the elements differ."""
    return _guard(a, b, F.greatest(F.lit(0.0), 1 - _warping(a, b) / F.greatest(F.size(a), F.size(b))), 0.0)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of equal elements before the first difference."""
    n = F.least(F.size(a), F.size(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.element_at(a, i) == F.element_at(b, i)), k + 1).otherwise(k),
    )


def same_prefix(a: Column, b: Column, k: int) -> Column:
    """Whether the first k elements are equal."""
    return F.slice(a, 1, k) == F.slice(b, 1, k)


def compressed(a: Column) -> Column:
    """Each run of equal neighbours as one element."""
    return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))


def motif(kinds: Column) -> Column:
    """Compressed families joined by `->`; "empty" for no event."""
    text = F.array_join(compressed(F.transform(kinds, event_family)), "->")
    return F.when(text == "", "empty").otherwise(text)


def count_bucket(n: Column) -> Column:
    """0, 1, 2 or 3+."""
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def count_tuple(kinds: Column) -> Column:
    """Buckets of the numbers of edits, runs and pauses."""
    families = F.transform(kinds, event_family)

    def part(name: str) -> Column:
        return F.concat(F.lit(f"{name}="), count_bucket(F.size(F.filter(families, lambda f: f == name))))

    return F.concat_ws("|", part("edit"), part("run"), part("pause"))


def touched_lines(starts: Column, ends: Column) -> Column:
    """Sorted distinct lines of paired ranges."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.sequence(r["s"], F.greatest(r["s"], r["e"]))))))


def within_lines(predicted: Column, observed: Column, tolerance: int) -> Column:
    """Whether a line is at most `tolerance` off; null without truth, false without a prediction."""
    return F.when(observed.isNotNull(), F.coalesce(F.abs(predicted - observed) <= tolerance, F.lit(False)))


def merged_steps(steps: Column) -> Column:
    """Adjacent steps (action, start, end) of one action as one; edits keep the outer lines of their spans."""
    empty = F.slice(steps, 1, 0)

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["action"] == s["action"])
        both = F.struct(
            s["action"].alias("action"), F.least(last["start"], s["start"]).alias("start"), F.greatest(last["end"], s["end"]).alias("end")
        )
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(steps, empty, add)


def binned_steps(steps: Column, most: int = 8) -> Column:
    """At most `most` steps that end in submit: merged, and the steps before the submit in `most` - 1 ordered
    bins if there are more, a bin with an edit as one edit, else as a run."""
    done = merged_steps(steps)
    body = F.filter(done, lambda s: s["action"] != "submit")
    n = F.size(body)
    bins = most - 1

    def one(i: Column) -> Column:
        lo = F.floor(i * n / bins).cast("int")
        hi = F.floor((i + 1) * n / bins).cast("int")
        part = F.slice(body, lo + 1, hi - lo)
        edits = F.filter(part, lambda s: s["action"] == "edit")
        return F.when(
            F.size(edits) > 0,
            F.struct(
                F.lit("edit").alias("action"),
                F.array_min(F.transform(edits, lambda s: s["start"])).alias("start"),
                F.array_max(F.transform(edits, lambda s: s["end"])).alias("end"),
            ),
        ).otherwise(F.struct(F.lit("local_run").alias("action"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))

    submit = F.array(F.struct(F.lit("submit").alias("action"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    short = merged_steps(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one))
    return F.concat(F.when(n + 1 > most, short).otherwise(body), submit)
