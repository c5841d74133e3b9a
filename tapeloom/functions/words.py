"""Column expressions on prose: sentences, n-grams, phrases, clause kinds, references to code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.shared import WORD_CHARS

#: A word, and a place where one begins or ends.
WORD = f"[{WORD_CHARS}]+"
_EDGE = f"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"

#: Common words that carry no content, for the operators below; pass others as parameters.
STOPWORDS = (
    "a an and are as at be but by for from has have he her his i in is it its of on or she that the their them "
    "they this to was were which will with"
).split()

#: Kinds of clauses by their words.
CLAUSE_WORDS = {
    "difficulty": ["fails", "failed", "error", "errors", "wrong", "problem", "misses"],
    "repair": ["fix", "fixes", "change", "changes", "patches", "move", "rename", "renamed", "rewrote"],
    "test": ["test", "tests", "case", "cases", "run", "runs", "passed", "passes"],
    "region": ["line", "lines", "loop", "condition", "output", "input"],
}

#: Words that name an action, by kind of event.
ACTION_PATTERNS = {
    "change": r"(?i)\b(edit|edits|edited|change|changes|changed|rewrote|patches|reverted|deleted)\b",
    "saida_testar": r"(?i)\b(run|runs|ran|test|tests|tested|printed)\b",
    "submit": r"(?i)\b(submit|submits|submitted|submission)\b",
}


def word_list(c: Column) -> Column:
    """Lower-case words, letters digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bounded(pattern: str) -> str:
    """A pattern whose `\\b` and `\\d` hold for letters and digits of any script."""
    return pattern.replace(r"\b", _EDGE).replace(r"\d", r"\p{Nd}")


def sentences(c: Column) -> Column:
    """Parts of a text after a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def leading_phrase(c: Column, n: int = 3) -> Column:
    """The first n words."""
    return F.array_join(F.slice(word_list(c), 1, n), " ")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` uses it and inside however many lambdas."""
    return F.get(F.transform(F.array(c), f), 0)


def _ngrams(tokens: Column, n: int) -> Column:
    spots = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array in order; none for a shorter array."""
    return bound(tokens, lambda t: _ngrams(t, n))


def distinct_ngrams(tokens: Column, low: int, high: int, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct n-grams of low to high words that aren't all stopwords."""
    stop = F.array(*map(F.lit, stopwords))
    every = bound(tokens, lambda t: F.array_distinct(F.concat(*[_ngrams(t, n) for n in range(low, high + 1)])))
    return F.filter(every, lambda g: F.exists(F.split(g, " "), lambda w: ~F.array_contains(stop, w)))


def leading_ngrams(tokens: Column, low: int = 3, high: int = 6) -> Column:
    """The first low, ..., high words as phrases, as far as there are so many."""
    made = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.size(tokens) >= n, F.array_join(F.slice(tokens, F.lit(1), n), " ")))
    return F.filter(made, lambda p: p.isNotNull())


def phrase_candidates(tokens: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct phrases of one to three words that neither begin nor end with a stopword."""
    stop = F.array(*map(F.lit, stopwords))

    def good(g: Column) -> Column:
        w = F.split(g, " ")
        return ~F.array_contains(stop, F.element_at(w, 1)) & ~F.array_contains(stop, F.element_at(w, -1))

    return F.filter(bound(tokens, lambda t: F.array_distinct(F.concat(*[_ngrams(t, n) for n in (1, 2, 3)]))), good)


def type_token_ratio(tokens: Column) -> Column:
    """Distinct words over words; null for none."""
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens))


def clauses(c: Column) -> Column:
    """Parts of a text between `;`, `,`, `.` or the word and."""
    return F.filter(F.transform(F.split(F.lower(c), bounded(r"[;,.]|\band\b")), lambda p: F.trim(p)), lambda p: p != "")


def clause_counts(c: Column, kinds: dict[str, list[str]] | None = None) -> Column:
    """Struct with the number of clauses of each kind, a clause counting for all its kinds, and of `other`."""
    kinds = kinds or CLAUSE_WORDS
    parts = F.transform(clauses(c), word_list)

    def has(words: list[str]):
        return lambda t: F.arrays_overlap(t, F.array(*map(F.lit, words)))

    every = [w for ws in kinds.values() for w in ws]
    return F.struct(
        *[F.size(F.filter(parts, has(ws))).alias(k) for k, ws in kinds.items()],
        F.size(F.filter(parts, lambda t: ~has(every)(t))).alias("other"),
    )


def line_mentions(c: Column) -> Column:
    """0-based lines a text names, as `line 3` or `lines 3 to 5` (also 3-5), sorted and distinct."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"lines?\s+(\d{1,6}(?:\s*(?:-|to|and)\s*\d{1,6})?)"), F.lit(1))

    def lines(m: Column) -> Column:
        a = F.regexp_extract(m, r"^(\d+)", 1).cast("int")
        b = F.coalesce(F.regexp_extract(m, r"(\d+)$", 1).try_cast("int"), a)
        apart = F.array(F.least(a, b) - 1, F.greatest(a, b) - 1)
        span = F.sequence(F.least(a, b) - 1, F.least(F.greatest(a, b), F.least(a, b) + 10_000) - 1)
        return F.when(m.contains("and"), apart).otherwise(span)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lines))))


def line_hit(mentions: Column, observed: Column, tolerance: int = 2) -> Column:
    """1.0 if any mentioned line is near the observed one, else 0.0; null without a mention or truth."""
    near = F.exists(mentions, lambda m: F.abs(m - observed) <= tolerance)
    return F.when((F.size(mentions) > 0) & observed.isNotNull(), near.cast("double"))


def action_kinds(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """The kinds of events a text speaks of."""
    made = [F.when(c.rlike(bounded(p)), F.lit(k)) for k, p in (patterns or ACTION_PATTERNS).items()]
    return F.array_compact(F.array(*made))


def action_alignment(implied: Column, observed: Column) -> Column:
    """Share of the implied kinds that were observed; null if none is implied."""
    return F.when(F.size(implied) > 0, F.size(F.array_intersect(implied, observed)) / F.size(implied))


def identifier_references(c: Column, code: Column) -> Column:
    """Distinct words of a text that are names in a program: with an underscore or a digit, or of four letters or more."""
    from tapeloom.functions.code import code_tokens, identifier_tokens

    names = identifier_tokens(code_tokens(code))
    said = F.filter(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"[_\d]") | (F.length(w) >= 4))
    return F.array_sort(F.array_intersect(said, names))


def terms_per_thousand(hits: Column, tokens: Column) -> Column:
    """Rate of hits per 1000 words; null for no words."""
    return F.when(tokens > 0, 1000.0 * hits / tokens)


def progress_note(before: Column, now: Column) -> Column:
    """What became of the number of passed tests since the attempt before; a null `before` is a first attempt."""
    n, b = now.cast("string"), before.cast("string")
    return (
        F.when(before.isNull(), F.concat(F.lit("first visible attempt with "), n, F.lit(" passing tests")))
        .when(now > before, F.concat(F.lit("pass count improved from "), b, F.lit(" to "), n))
        .when(now < before, F.concat(F.lit("pass count dropped from "), b, F.lit(" to "), n))
        .otherwise(F.concat(F.lit("pass count stayed at "), n))
    )


def milliseconds_between(later: Column, earlier: Column) -> Column:
    """Whole milliseconds between two times, rounded half-even."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.bround((us(later) - us(earlier)) / 1e3, 0).cast("bigint")


def rendered(history: Column, fields: Sequence[str], title: str = "Attempt") -> Column:
    """An array of structs as text: a numbered heading for each and a line `field: value` for each field it has."""
    def one(a: Column, i: Column) -> Column:
        lines = [F.when(a[f].isNotNull(), F.concat(F.lit(f"{f}: "), a[f].cast("string"))) for f in fields]
        return F.concat_ws("\n", F.format_string(f"{title} %d", i + 1), *lines)

    return F.array_join(F.transform(history, one), "\n\n")
