"""What no SQL expression gives: line diffs, hunk matching, step alignment, syntax regions. Plain functions on
Python values, and Arrow UDFs of them. Sets of lines are integers with a bit for each line."""

from __future__ import annotations

import ast
import math
import os
import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.code import KEYWORDS, TOKEN
from tapeloom.shared import SPACES, WORD_CHARS

_KEYWORDS = frozenset(KEYWORDS)
#: `code.TOKEN` in Python's spelling, which has no \p{} classes but Unicode's \w, \d and \s.
_TOKEN = re.compile(TOKEN.replace(rf"[A-Za-z_][{WORD_CHARS}]", r"[A-Za-z_][\w]").replace(r"\p{Nd}", r"\d").replace(f"[^{SPACES}]", r"\S"))
REPAIR = (
    "strict_footprint_precision strict_footprint_recall strict_footprint_f1 windowed_footprint_precision "
    "windowed_footprint_recall windowed_footprint_f1 windowed_footprint_mean_iou aligned_content_f1 "
    "aligned_content_structural_f1 aligned_content_identifier_f1 code_gain_over_copy_raw code_gain_over_copy_bounded"
).split()
TRAJECTORY = (
    "trajectory_alignment_score edit_span_overlap edit_region_overlap_unordered local_run_presence_match "
    "local_run_count_agreement"
).split()
FULL_CODE = "exact_next_code_match structural_lift_over_copy full_code_structural_similarity_diagnostic worse_than_copy_rate".split()
REPAIR_V1 = "repair_footprint_precision repair_footprint_recall repair_footprint_f1 repair_content_similarity code_gain_over_copy".split()
TRAJECTORY_V1 = "trajectory_alignment_score edit_span_overlap local_run_presence_match local_run_count_match".split()
FULL_CODE_V1 = "exact_next_code_match full_code_structural_similarity worse_than_copy_rate".split()


def narrow(code: str) -> str:
    """LF line ends, one terminal line end dropped, blanks and tabs at line ends dropped."""
    text = code.replace("\r\n", "\n").replace("\r", "\n")
    text = text[:-1] if text.endswith("\n") else text
    return re.sub(r"[ \t]+$", "", text, flags=re.M)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def is_identifier(token: str) -> bool:
    return (token[0].isalpha() or token[0] == "_") and token.isascii() and token not in _KEYWORDS


def bag_f1(a: list[str], b: list[str]) -> float:
    if not a and not b:
        return 1.0
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


@dataclass(frozen=True)
class Hunk:
    """A changed stretch: source lines [start, stop), empty for an insertion before line `start`."""

    start: int
    stop: int
    removed: str
    added: str

    def units(self) -> set[tuple[str, int]]:
        if self.start == self.stop:
            return {("A", self.start)}
        return {("L", k) for k in range(self.start, self.stop)}

    def window(self, radius: int) -> int:
        last = max(self.stop - 1, self.start)
        return bits(self.start - radius, last + radius, radius)

    @property
    def text(self) -> str:
        return f"{self.removed}\n{self.added}"


def bits(low: int, high: int, shift: int) -> int:
    """Lines low to high as a set; `shift` keeps lines before the first one apart from it."""
    return ((1 << (high - low + 1)) - 1) << (low + shift)


def iou(a: int, b: int) -> float:
    every = (a | b).bit_count()
    return (a & b).bit_count() / every if every else 0.0


def hunks(before: str, after: str, junk: bool = False, normal: bool = True) -> list[Hunk]:
    """Changed stretches of a line diff, in order."""
    a, b = (narrow(before), narrow(after)) if normal else (before, after)
    x, y = a.split("\n") if a else [], b.split("\n") if b else []
    steps = SequenceMatcher(None, x, y, autojunk=junk).get_opcodes()
    return [Hunk(i1, i2, "\n".join(x[i1:i2]), "\n".join(y[j1:j2])) for tag, i1, i2, j1, j2 in steps if tag != "equal"]


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest sum of weights, of equal sums the one with most pairs; pairs of
    weight 0 don't count. Hungarian method with potentials."""
    if not weight.size:
        return []
    flip = weight.shape[0] > weight.shape[1]
    cost = -(np.where(weight > 0, weight + 1e-9, 0.0).T if flip else np.where(weight > 0, weight + 1e-9, 0.0))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            seen[j0] = True
            free = np.flatnonzero(~seen)
            slack = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            closer = slack < least[free]
            least[free[closer]], back[free[closer]] = slack[closer], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(j, i) if flip else (i, j) for i, j in pairs]
    return sorted((i, j) for i, j in pairs if weight[i, j] > 0)


def _f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


@lru_cache(maxsize=8192)
def distance(a: str, b: str) -> int:
    """Edit distance: a column of the table at a time, as two bit vectors of the places where it rises and falls."""
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, total = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = ((same & rise) + rise) ^ rise | same | fall
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
        total += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rise, fall = (down | ~(diagonal | up)) & full, up & diagonal & full
    return total


def footprint(predicted: list[Hunk], observed: list[Hunk]) -> tuple[float, float, float]:
    """Precision, recall and F1 of the touched units; 0 where a side has none."""
    p = set().union(*(h.units() for h in predicted)) if predicted else set()
    o = set().union(*(h.units() for h in observed)) if observed else set()
    both = len(p & o)
    a, b = both / len(p) if p else 0.0, both / len(o) if o else 0.0
    return a, b, _f1(a, b)


def repair_scores(before: str, predicted: str, observed: str, radius: int = 1) -> dict[str, float | None]:
    """The twelve repair scores; gains are None where nothing was changed."""
    p, o = hunks(before, predicted), hunks(before, observed)
    weight = np.array([[iou(a.window(radius), b.window(radius)) for b in o] for a in p]).reshape(len(p), len(o))
    pairs = best_matching(weight)
    total = float(sum(weight[i, j] for i, j in pairs))
    if not p and not o:
        windowed, content = (1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0)
    else:
        a, b = total / len(p) if p else 0.0, total / len(o) if o else 0.0
        windowed = (a, b, _f1(a, b), total / len(pairs) if pairs else 0.0)
        most = max(len(p), len(o))
        sums = np.zeros(3)
        for i, j in pairs:
            x, y = tokens(p[i].text), tokens(o[j].text)
            for k, keep in enumerate((lambda t: True, lambda t: not is_identifier(t), is_identifier)):
                sums[k] += bag_f1([t for t in x if keep(t)], [t for t in y if keep(t)])
        content = tuple(float(s) for s in sums / most)
    base, left = distance(narrow(before), narrow(observed)), distance(narrow(predicted), narrow(observed))
    raw = 1 - left / base if base else None
    bounded = (base - left) / max(base, left) if base else None
    return dict(zip(REPAIR, (*footprint(p, o), *windowed, *content, raw, bounded)))


def _body(steps: list[dict]) -> list[dict]:
    return list(steps[:-1]) if steps and steps[-1]["action"] == "submit" else list(steps)


def _span(step: dict, radius: int) -> int:
    low, high = int(step["start"]), int(step["end"])
    return bits(low - radius, high + radius, radius) if high >= low else 0


def step_alignment(predicted: list[dict], observed: list[dict], radius: int = 1) -> tuple[float, list[tuple[int, int, float]]]:
    """Score and aligned pairs of two paths without their submit: runs match runs, edits by overlap of their lines."""
    p, o = _body(predicted), _body(observed)
    if not p and not o:
        return 1.0, []
    gain = np.zeros((len(p) + 1, len(o) + 1))
    best = np.zeros_like(gain)
    for i, a in enumerate(p, 1):
        for j, b in enumerate(o, 1):
            if a["action"] == b["action"]:
                gain[i, j] = 1.0 if a["action"] == "local_run" else iou(_span(a, radius), _span(b, radius)) if a["action"] == "edit" else 0.0
            best[i, j] = max(best[i - 1, j - 1] + gain[i, j], best[i - 1, j], best[i, j - 1])
    pairs = []
    i, j = len(p), len(o)
    while i and j:
        if gain[i, j] > 0 and best[i, j] == best[i - 1, j - 1] + gain[i, j]:
            pairs.append((i - 1, j - 1, float(gain[i, j])))
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return float(best[-1, -1]) / max(len(p), len(o), 1), pairs[::-1]


def path_scores(predicted: list[dict], observed: list[dict], radius: int = 1) -> dict[str, float]:
    """The five scores of two paths."""
    score, pairs = step_alignment(predicted, observed, radius)
    p, o = _body(predicted), _body(observed)
    overlaps = [g for i, _, g in pairs if p[i]["action"] == "edit"]
    area = []
    for side in (p, o):
        lines = 0
        for s in side:
            lines |= _span(s, radius) if s["action"] == "edit" else 0
        area.append(lines)
    n, m = (sum(s["action"] == "local_run" for s in side) for side in (p, o))
    edits = any(s["action"] == "edit" for s in p + o)
    return dict(zip(TRAJECTORY, (
        score, sum(overlaps) / len(overlaps) if overlaps else 0.0, iou(*area) if edits else 1.0,
        float((n > 0) == (m > 0)), 1.0 - abs(n - m) / max(n, m, 1),
    )))


@lru_cache(maxsize=8192)
def token_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of the tokens."""
    return SequenceMatcher(None, tokens(narrow(a)), tokens(narrow(b)), autojunk=False).ratio()


def full_code_scores(before: str, predicted: str, observed: str) -> dict[str, float | None]:
    """The four scores of whole programs."""
    ratio = token_ratio(predicted, observed)
    lift = ratio - token_ratio(before, observed) if tokens(narrow(observed)) else 0.0
    base, left = distance(narrow(before), narrow(observed)), distance(narrow(predicted), narrow(observed))
    return dict(zip(FULL_CODE, (float(narrow(predicted) == narrow(observed)), lift, ratio, float(left > base) if base else None)))


def scores(before: str, predicted: str, observed: str, predicted_steps: list[dict], observed_steps: list[dict], version: str = "v2", radius: int = 1) -> dict[str, float | None]:
    """All scores of one prediction; version v1 diffs raw lines, knows no radius and has twelve scores."""
    if version == "v2":
        return repair_scores(before, predicted, observed, radius) | path_scores(predicted_steps, observed_steps, radius) | full_code_scores(before, predicted, observed)
    p, o = hunks(before, predicted, normal=False), hunks(before, observed, normal=False)
    parts = []
    for side in ("removed", "added"):
        x, y = ("\n".join(t for h in hs if (t := getattr(h, side))) for hs in (p, o))
        if x or y:
            parts.append(bag_f1(tokens(x), tokens(y)))
    base, left = distance(narrow(before), narrow(observed)), distance(narrow(predicted), narrow(observed))
    gain = 1 - left / base if base else None
    score, pairs = step_alignment(predicted_steps, observed_steps, 0)
    body, other = _body(predicted_steps), _body(observed_steps)
    overlaps = [g for i, _, g in pairs if body[i]["action"] == "edit"]
    n, m = (sum(s["action"] == "local_run" for s in side) for side in (body, other))
    return (
        dict(zip(REPAIR_V1, (*footprint(p, o), sum(parts) / len(parts) if parts else 1.0, gain)))
        | dict(zip(TRAJECTORY_V1, (score, sum(overlaps) / len(overlaps) if overlaps else 0.0, float((n > 0) == (m > 0)), float(n == m))))
        | dict(zip(FULL_CODE_V1, (float(narrow(predicted) == narrow(observed)), token_ratio(predicted, observed), float(gain < 0) if gain is not None else None)))
    )


def changed_span(before: str, after: str) -> tuple[int, int] | None:
    """Lines of `after` between the common start and the common end; the anchor of a pure deletion; None if equal."""
    x, y = before.split("\n"), after.split("\n")
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    if head <= len(y) - 1 - tail:
        return head, len(y) - 1 - tail
    return None if before == after else (min(head, len(y) - 1),) * 2


def projected_span(source: str, final: str, span: tuple[int, int]) -> tuple[int, int] | None:
    """Where lines of `source` stand in `final`; None if none of them does."""
    return _projected(SequenceMatcher(None, source.split("\n"), final.split("\n"), autojunk=False).get_opcodes(), span)


def _projected(steps: list[tuple[str, int, int, int, int]], span: tuple[int, int]) -> tuple[int, int] | None:
    places = []
    for tag, i1, i2, j1, j2 in steps:
        low, high = max(i1, span[0]), min(i2, span[1] + 1)
        if low < high and tag == "equal":
            places += [j1 + low - i1, j1 + high - 1 - i1]
        elif low < high and tag == "replace":
            places += [j1, j2 - 1]
    return (min(places), max(places)) if places else None


class Shared:
    """`changed_span` and `projected_span` of programs that share the first `pre` and the last `suf` of `lines`, each given as
    the list of what stands between. `lines` is the final program and `times` how often it has each line."""

    #: Ends shorter than this are left to the matcher.
    SHORT = 32

    def __init__(self, lines: list[str], pre: int, suf: int, times: Counter):
        self.lines, self.pre, self.suf, self.times = lines, pre, suf, times

    def size(self, mid: list[str]) -> int:
        return self.pre + len(mid) + self.suf

    def line(self, mid: list[str], k: int) -> str:
        if k < self.pre:
            return self.lines[k]
        k -= self.pre
        return mid[k] if k < len(mid) else self.lines[len(self.lines) - self.suf + k - len(mid)]

    def part(self, mid: list[str], low: int, high: int) -> list[str]:
        end = self.pre + len(mid)
        last = [] if high <= end else self.lines[len(self.lines) - self.suf + max(low - end, 0) : len(self.lines) - self.suf + high - end]
        return [*self.lines[low : min(high, self.pre)], *mid[max(low - self.pre, 0) : max(high - self.pre, 0)], *last]

    def ends(self, x: list[str], y: list[str], apart: bool) -> tuple[int, int]:
        """Numbers of equal lines at the start and at the end; `apart`: the end doesn't reach into the start."""
        n, m = self.size(x), self.size(y)
        head = min(self.pre, n, m)
        while head < min(n, m) and self.line(x, head) == self.line(y, head):
            head += 1
        most = min(n, m) - head if apart else min(n, m)
        tail = min(self.suf, most)
        while tail < most and self.line(x, n - 1 - tail) == self.line(y, m - 1 - tail):
            tail += 1
        return head, tail

    def changed_span(self, x: list[str], y: list[str]) -> tuple[int, int] | None:
        if x == y:
            return None
        head, tail = self.ends(x, y, True)
        last = self.size(y) - 1
        return (head, last - tail) if head <= last - tail else (min(head, last),) * 2

    def weak_run(self, mid: list[str], head: int, tail: int, q: int) -> bool:
        """Whether `q` lines in a row may stand elsewhere too: those between the ends, and those there more than once."""
        n, times = self.size(mid), self.times
        lines = self.part(mid, 0, n)
        inner = set(lines[head : n - tail])
        at = q - 1
        while at < n:
            k = at
            while k > at - q and (head <= k < n - tail or times.get(t := lines[k]) != 1 or t in inner):
                k -= 1
            if k == at - q:
                return True
            at = k + q
        return False

    def projected_span(self, x: list[str], final: list[str], span: tuple[int, int]) -> tuple[int, int] | None:
        """The matcher takes the longest common stretch first, then the longest on each side of it. Where the common start or
        end is longer than any other common stretch can be, it is taken without being looked for."""
        if x == final:
            return span
        n, m = self.size(x), self.size(final)
        p, s = head, tail = self.ends(x, final, False)
        if p + s > min(n, m):
            p = s = 0
        longer, shorter = max(p, s), min(p, s)
        if longer < self.SHORT or self.weak_run(x, head, tail, longer):
            p = s = 0
        elif shorter < self.SHORT or self.weak_run(x, head, tail, shorter):
            p, s = (p, 0) if p >= s else (0, s)
        inner = SequenceMatcher(None, self.part(x, p, n - s), self.part(final, p, m - s), autojunk=False).get_opcodes()
        steps = [("equal", 0, p, 0, p), *((tag, i1 + p, i2 + p, j1 + p, j2 + p) for tag, i1, i2, j1, j2 in inner), ("equal", n - s, n, m - s, m)]
        return _projected(steps, span)


def coarse_steps(start: str, anchors: list[tuple[str, str, bool]]) -> tuple[list[dict], str | None]:
    """Steps of a block and why they can't be had. `anchors` are (kind, code, edited) with the block's submit last:
    each anchor after an edit gives an edit step with its lines in the final program, then its own step."""
    if not anchors or anchors[-1][0] != "submit":
        return [], "not_submit_bounded"
    final, now, out = anchors[-1][1], start, []
    for kind, code, edited in anchors:
        if edited:
            span = changed_span(now, code)
            if span is None:
                return [], "no_net_change"
            span = projected_span(code, final, span)
            if span is None:
                return [], "edit_not_in_final_code"
            out.append({"action": "edit", "start": span[0], "end": span[1]})
        out.append({"action": "submit" if kind == "submit" else "local_run", "start": None, "end": None})
        now = code
    return out, None


def repair_spans(before: str, after: str) -> list[tuple[int, int]]:
    """Changed spans in the lines of `after` with the diff's junk heuristic on; a deletion is the line it stands before."""
    x, y = before.split("\n"), after.split("\n")
    marked: set[int] = set()
    for tag, _, _, j1, j2 in SequenceMatcher(None, x, y).get_opcodes():
        if tag != "equal":
            marked |= set(range(j1, j2)) if j2 > j1 else {min(j1, len(y) - 1)}
    lines = np.array(sorted(marked), dtype=int)
    if not len(lines):
        return []
    return [(int(part[0]), int(part[-1])) for part in np.split(lines, np.flatnonzero(np.diff(lines) > 1) + 1)]


def delta_summary(before: str, after: str) -> str:
    """changed_N_lines with the constructs that the new program has and the old one hasn't, by substring."""
    n = sum(max(1, j2 - j1) for tag, _, _, j1, j2 in SequenceMatcher(None, before.splitlines(), after.splitlines()).get_opcodes() if tag != "equal")
    marks = {"loop": ("while", "for"), "conditional": ("if", "elif", "else:"), "print": ("print(",), "input": ("input(",)}
    new = [f"introduced_{k}" for k, ws in marks.items() if any(w in after for w in ws) and not any(w in before for w in ws)]
    return " ".join([f"changed_{n}_lines", *new])


def regions(code: str) -> dict[str, set[int]] | None:
    """0-based lines of print calls, conditionals and loops; None for a program that doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: dict[str, set[int]] = {"output": set(), "conditional": set(), "loop": set()}
    for node in ast.walk(tree):
        kind = (
            "conditional" if isinstance(node, ast.If) else "loop" if isinstance(node, (ast.For, ast.While))
            else "output" if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "print" else None
        )
        if kind:
            out[kind] |= set(range(node.lineno - 1, (node.end_lineno or node.lineno)))
    return out


def focus_region(code: str, line: int) -> str:
    """output_region, conditional_region or loop_region of a line, the first that holds it, or why there is none."""
    if not 0 <= line < len(code.splitlines()):
        return "line_out_of_bounds"
    found = regions(code)
    if found is None:
        return "does_not_parse"
    return next((f"{k}_region" for k in ("output", "conditional", "loop") if line in found[k]), "no_region")


def string_literals(source: str) -> list[str]:
    """String constants of a Python source in order; none for one that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = [n for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
    return [n.value for n in sorted(found, key=lambda n: (n.lineno, n.col_offset))]


# Arrow UDFs
_LONGS = T.ArrayType(T.LongType())
_STEP = T.StructType([T.StructField("action", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
HUNK = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("removed", T.StringType()), T.StructField("added", T.StringType())])


def _each(f, *columns: pd.Series) -> list:
    return [None if any(x is None for x in row) else f(*row) for row in zip(*columns)]


@F.pandas_udf(T.ArrayType(HUNK))
def hunks_udf(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda a, b: [vars(h) for h in hunks(a, b)], before, after))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def repair_spans_udf(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda a, b: [{"start": s, "end": e} for s, e in repair_spans(a, b)], before, after))


@F.pandas_udf(T.StringType())
def delta_summary_udf(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(_each(delta_summary, before, after))


@F.pandas_udf(T.StringType())
def focus_region_udf(code: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or n is None or math.isnan(n) else focus_region(c, int(n)) for c, n in zip(code, line)])


@F.pandas_udf(T.LongType())
def distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each(distance, a, b), dtype="Int64")


@F.pandas_udf(T.DoubleType())
def token_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each(token_ratio, a, b), dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_literals_udf(source: pd.Series) -> pd.Series:
    return pd.Series(_each(string_literals, source))


def score_names(version: str = "v2") -> list[tuple[str, str]]:
    """(family, metric) of all scores of a version."""
    parts = (REPAIR, TRAJECTORY, FULL_CODE) if version == "v2" else (REPAIR_V1, TRAJECTORY_V1, FULL_CODE_V1)
    return [(family, m) for family, names in zip(("repair", "trajectory", "full_code"), parts) for m in names]


def score_udf(version: str = "v2", radius: int = 1):
    """UDF (before, predicted, observed, predicted steps, observed steps) to a struct of all scores; null for a null program."""
    names = [m for _, m in score_names(version)]

    @F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in names]))
    def run(before: pd.Series, predicted: pd.Series, observed: pd.Series, ps: pd.Series, os: pd.Series) -> pd.DataFrame:
        rows = []
        for b, p, o, s, t in zip(before, predicted, observed, ps, os):
            if b is None or p is None or o is None:
                rows.append(dict.fromkeys(names))
            else:
                rows.append(scores(b, p, o, list(s) if s is not None else [], list(t) if t is not None else [], version, radius))
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return run
