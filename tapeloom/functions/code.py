"""Column expressions on program text: normal forms, tokens, distances and gains. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.shared import SPACES, UNI_SPACE, WORD_CHARS

#: The words that count as structure, not as identifiers.
KEYWORDS = (
    "False None True and as assert async await break case class continue def del elif else except finally "
    "for from global if import in is lambda match nonlocal not or pass raise return try while with yield"
).split()

#: Fixed value: tokens are names, numbers, two-character operators, single signs, and any other character.
TOKEN = rf"[A-Za-z_][{WORD_CHARS}]*|\p{{Nd}}+|==|!=|<=|>=|:=|->|[-+*/%<>=(){{}}\[\],.:;]|[^{SPACES}]"
_LINE_SPACES = SPACES.replace(r"\n", "")


def _lf(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def narrow(c: Column) -> Column:
    """Line ends as LF, one final line end dropped, blanks and tabs at line ends dropped."""
    one_less = F.regexp_replace(_lf(c), r"\n\z", "")
    return F.regexp_replace(one_less, r"(?md)[ \t]+$", "")


def without_blank_end(c: Column) -> Column:
    """White space at line ends and all blank lines at the end dropped."""
    return F.regexp_replace(F.regexp_replace(_lf(c), rf"(?md)[{_LINE_SPACES}]+$", ""), r"\n+\z", "")


def output_form(c: Column) -> Column:
    """Program output for comparison: white space at line ends and around the whole dropped."""
    return F.regexp_replace(F.regexp_replace(_lf(c), rf"(?md)[{_LINE_SPACES}]+$", ""), rf"\A{UNI_SPACE}+|{UNI_SPACE}+\z", "")


def normalize_code(c: Column, mode: str = "narrow") -> Column:
    """One of the three normal forms: narrow, blank or output. Null stays null."""
    return {"narrow": narrow, "blank": without_blank_end, "output": output_form}[mode](c)


def code_tokens(c: Column) -> Column:
    """Tokens of a program in order; an empty array for an empty one."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def _is_name(t: Column) -> Column:
    return t.rlike("^[A-Za-z_]") & ~F.array_contains(F.array(*map(F.lit, KEYWORDS)), t)


def identifier_tokens(tokens: Column) -> Column:
    """The names among tokens, keywords excluded."""
    return F.filter(tokens, _is_name)


def structural_tokens(tokens: Column) -> Column:
    """Keywords, numbers and operators among tokens."""
    return F.filter(tokens, lambda t: ~_is_name(t))


def occurrences(a: Column) -> Column:
    """An array of strings as a set: each element with the number of equal ones before it."""

    def number(s: Column) -> Column:
        return F.transform(
            s, lambda x, i: F.concat(x.cast("string"), F.lit("\x1f"), (i - F.array_position(s, x)).cast("string"))
        )

    return F.get(F.transform(F.array(F.array_sort(a)), number), 0)  # the sorted array is bound once


def overlap(a: Column, b: Column) -> Column:
    """Number of elements two arrays share, each as often as in both."""
    return F.size(F.array_intersect(occurrences(a), occurrences(b)))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of the shared tokens: 1 if both are empty, 0 if one is."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * overlap(a, b) / both)


def edit_distance(a: Column, b: Column) -> Column:
    """Number of characters put in, left out or changed; null if a text is null. An Arrow UDF over bit vectors, a column of the
    table at a time: for programs of a thousand characters many times as fast as the engine's own table of cells."""
    from tapeloom.functions.diff import distance_udf

    return distance_udf(a, b)


def code_distance(a: Column, b: Column) -> Column:
    """Edit distance over the sum of the lengths; 0 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 0.0).otherwise(edit_distance(a, b) / both)


def code_distance_within(a: Column, b: Column, limit: float) -> Column:
    """Whether `code_distance` is at most `limit`; texts whose lengths alone forbid it aren't compared."""
    both = F.length(a) + F.length(b)
    return (F.abs(F.length(a) - F.length(b)) <= limit * both) & (code_distance(a, b) <= limit)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Share of the summed lengths that needn't be edited; 1 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise((both - edit_distance(a, b)) / both)


def gain_raw(before: Column, predicted: Column, observed: Column) -> Column:
    """1 - d(predicted, observed) / d(before, observed); null where nothing was changed."""
    base = edit_distance(before, observed)
    return F.when(base > 0, 1 - edit_distance(predicted, observed) / base)


def gain_bounded(before: Column, predicted: Column, observed: Column) -> Column:
    """The gain over copying within [-1, 1]; null where nothing was changed."""
    base, left = edit_distance(before, observed), edit_distance(predicted, observed)
    return F.when(base > 0, (base - left) / F.greatest(base, left))


def pass_signature(vector: Column) -> Column:
    """P and F for each test of a boolean array; null for a null array."""
    return F.array_join(F.transform(vector, lambda x: F.when(x, "P").otherwise("F")), "")


def failed_tests(vector: Column) -> Column:
    """0-based places of the tests that failed."""
    spots = F.transform(vector, lambda x, i: F.when(~x, i))
    return F.filter(spots, lambda i: i.isNotNull())


def pass_count(vector: Column) -> Column:
    """Number of tests passed."""
    return F.size(F.filter(vector, lambda x: x))


def next_outcome(vector: Column) -> Column:
    """all_fail, all_pass or mixed; null for a null or empty array. all_fail is tested first."""
    return F.when(F.size(vector) > 0, F.when(F.forall(vector, lambda x: ~x), "all_fail")
                  .when(F.forall(vector, lambda x: x), "all_pass").otherwise("mixed"))


def outcome_bucket(before: Column, after: Column) -> Column:
    """solved, partial_fix, no_improvement or regressed, from the results of two attempts."""
    a, b = pass_count(before), pass_count(after)
    return (
        F.when(F.forall(after, lambda x: x), "solved").when(b > a, "partial_fix").when(b == a, "no_improvement")
        .when(b < a, "regressed")
    )


def slug(c: Column) -> Column:
    """Lower case with runs of other characters than letters and digits as one underscore; "unknown" if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def grade(c: Column) -> Column:
    """The first decimal number of a grade line; null if there is none."""
    return F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def without_fence(c: Column) -> Column:
    """A text without the code fence around it, if it has one."""
    return F.regexp_replace(F.regexp_replace(c, r"\A\s*```[A-Za-z]*\s*\n", ""), r"\n?\s*```\s*\z", "")


def mismatch_signature(expected: Column, actual: Column, given: Column) -> Column:
    """How an output differs from the expected one, on the normal forms of both; the first of the cases that holds."""
    e, a = output_form(expected), output_form(actual)
    lines = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))
    x, y = lines(e), lines(a)
    more = F.when(F.size(F.array_distinct(y)) < F.size(y), "repeated_output_value").otherwise("extra_output_lines")
    return (
        F.when(a == "", "empty_output")
        .when(a == output_form(given), "unchanged_input_echo")
        .when(F.size(y) < F.size(x), "missing_output_lines")
        .when(F.size(y) > F.size(x), more)
        .when(F.get(x, 0) != F.get(y, 0), "wrong_first_output_line")
        .when(F.try_element_at(x, F.lit(-1)) != F.try_element_at(y, F.lit(-1)), "wrong_final_output_line")
        .when(a.isNotNull() & e.isNotNull(), "other_output_mismatch")
    )


def steps_bucket(n: Column) -> Column:
    """0, 1 or 2_plus."""
    return F.when(n <= 0, "0").when(n == 1, "1").when(n > 1, "2_plus")


def passed_bucket(vector: Column) -> Column:
    """0, partial or all tests passed."""
    n = pass_count(vector)
    return F.when(n == 0, "0").when(n == F.size(vector), "all").when(n > 0, "partial")


def touched_bucket(n: Column) -> Column:
    """Scope of an edit by its number of distinct lines."""
    return F.when(n <= 2, "local_1_to_2_lines").when(n <= 5, "regional_3_to_5_lines").otherwise("broad_6_plus_lines")
