import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import code as C
from tapeloom.functions import diff as D
from tapeloom.functions import sequences as S
from tapeloom.functions import words as W


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


def test_normal_forms(spark):
    c = F.col("c")
    text = "a \t\r\nb\r\n\n"
    assert one(spark, C.narrow(c), c=text) == "a\nb\n"
    assert one(spark, C.without_blank_end(c), c=text) == "a\nb"
    assert one(spark, C.output_form(c), c="  x \n y \n") == "x\n y"
    assert one(spark, C.narrow(c), c=None) is None


def test_distances(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, C.code_distance(a, b), a="x=1\nprint(x)", b="x=2\nprint(x)") == pytest.approx(1 / 24)
    assert one(spark, C.code_distance(a, b), a="", b="") == 0 and one(spark, C.levenshtein_ratio(a, b), a="", b="") == 1
    assert one(spark, C.code_distance_within(a, b, 0.1), a="x=1\nprint(x)", b="x = 1\nprint(x)")


def test_gains(spark):
    x, p, o = F.col("x"), F.col("p"), F.col("o")
    assert one(spark, C.gain_bounded(x, p, o), x="x = 1", p="x = 2", o="x = 2") == 1
    far = dict(x="x = 1", p="y" * 200, o="x = 2")
    assert one(spark, C.gain_raw(x, p, o), **far) < -10 and -1 <= one(spark, C.gain_bounded(x, p, o), **far) <= 0
    assert one(spark, C.gain_raw(x, p, o), x="a", p="b", o="a") is None


def test_bags(spark):
    a, b = F.col("a"), F.col("b")
    v = dict(a=["a", "a", "b"], b=["a", "b", "c"])
    assert one(spark, C.token_f1(a, b), **v) == pytest.approx(2 / 3)
    assert one(spark, S.multiset_jaccard(a, b), **v) == 0.5
    assert one(spark, C.token_f1(a, b), a=[], b=[]) == 1 and one(spark, C.token_f1(a, b), a=[], b=["x"]) == 0


def test_sequences(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.lcss_ratio(a, b), a=list("abcbd"), b=list("bdcb")) == pytest.approx(3 / 5)
    assert one(spark, S.edit_similarity(a, b), a=list("ab"), b=list("acb")) == pytest.approx(2 / 3)
    assert one(spark, S.dtw_similarity(a, b), a=list("aab"), b=list("ab")) == 1
    assert one(spark, S.edit_similarity(a, b), a=[], b=[]) == 1 and one(spark, S.lcss_ratio(a, b), a=[], b=["x"]) == 0
    assert one(spark, S.motif(a), a=["change", "change", "saida_testar", "idle_gap", "submit"]) == "edit->run->pause->submit"
    assert one(spark, S.motif(a), a=[]) == "empty"
    assert one(spark, S.shared_prefix(a, b), a=list("abx"), b=list("aby")) == 2


def _dp(a, b, join, first):
    row = [first(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [first(i)]
        for j, y in enumerate(b, 1):
            new.append(join(row[j], new[-1], row[j - 1], x == y))
        row = new
    return row[-1]


def test_sequence_programmes_against_plain_ones(spark):
    import random

    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(1, 8))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", S.edit_similarity(a, b).alias("e"), S.lcss_ratio(a, b).alias("l"), S.dtw_similarity(a, b).alias("d")).collect()
    for r in got:
        n = max(len(r.a), len(r.b))
        assert r.e == pytest.approx(1 - _dp(r.a, r.b, lambda u, v, d, q: min(u + 1, v + 1, d + (not q)), lambda k: k) / n)
        assert r.l == pytest.approx(_dp(r.a, r.b, lambda u, v, d, q: d + 1 if q else max(u, v), lambda k: 0) / n)
        cost = _dp(r.a, r.b, lambda u, v, d, q: min(u, v, d) + (not q), lambda k: 10**6 * bool(k))
        assert r.d == pytest.approx(max(0, 1 - cost / n))


def test_whole_tapes_are_scored(spark, tmp_path):
    from datetime import datetime, timedelta

    from tapeloom.plans import sequences, studies

    tapes = [["change"] * 45 + ["saida_testar", "submit"], ["change"] * 45 + ["kill_program", "change", "submit"], ["change"] * 45 + ["saida_testar", "change", "submit"]]
    kinds = [k for t in tapes for k in t]
    rows = [(i, 7, datetime(2024, 3, 4) + timedelta(seconds=i), i, k, "") for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id bigint, log_id bigint, event_ts timestamp, line_number bigint, raw_type string, payload string").write.parquet(f"{tmp_path}/raw_trace_event.parquet")
    edits = lambda a, b: 1 - _dp(a, b, lambda u, v, d, q: min(u + 1, v + 1, d + (not q)), lambda k: k) / max(len(a), len(b))
    common = lambda a, b: _dp(a, b, lambda u, v, d, q: d + 1 if q else max(u, v), lambda k: 0) / max(len(a), len(b))
    warped = lambda a, b: 1 - _dp(a, b, lambda u, v, d, q: min(u, v, d) + (not q), lambda k: 10**6 * bool(k)) / max(len(a), len(b))
    pairs = {i: (tapes[i], tapes[i + 1]) for i in (0, 1)}
    got = {r.interval_idx: r for r in sequences.j39_j41_sequence_similarity(spark, str(tmp_path)).collect()}
    one_of = {r.interval_idx: r.edit_similarity for r in sequences.j39_edit_similarity(spark, str(tmp_path)).collect()}
    shared = {r.interval_idx: r for r in sequences.j42_j44_prefixes(spark, str(tmp_path)).collect()}
    for i, (a, b) in pairs.items():
        both = sum((Counter(a) & Counter(b)).values())
        assert (got[i].edit_similarity, got[i].lcss, got[i].dtw) == pytest.approx((edits(a, b), common(a, b), warped(a, b)))
        assert one_of[i] == pytest.approx(edits(a, b)) and shared[i].prefix == 45
        assert shared[i].jaccard == pytest.approx(both / (len(a) + len(b) - both))
    scores = {r.metric: r for r in studies.l09_l15_sequence_metrics(spark, str(tmp_path)).collect()}
    assert scores["edit"].expected_score == pytest.approx(0.7 * edits(tapes[1], tapes[2]) + 0.3 * edits(tapes[0], tapes[2]))
    assert scores["lcss"].top1_score == pytest.approx(common(tapes[1], tapes[2])) and scores["prefix"].top1_score == pytest.approx(45 / 48)


def test_binned_steps(spark):
    kinds = ["local_run", "edit"] * 36
    steps = ", ".join(f"named_struct('action', '{k}', 'start', {i if k == 'edit' else 'CAST(NULL AS INT)'}, 'end', {i if k == 'edit' else 'CAST(NULL AS INT)'})" for i, k in enumerate(kinds))
    end = "named_struct('action', 'submit', 'start', CAST(NULL AS INT), 'end', CAST(NULL AS INT))"
    got = spark.sql(f"SELECT array({steps}, {end}) AS s").select(S.binned_steps(F.col("s")).alias("s")).first().s
    assert len(got) <= 8 and got[-1].action == "submit" and got[0].action == "edit"
    assert got[0].start == 1 and got[-2].end == 71


def test_words(spark):
    c = F.col("c")
    assert one(spark, W.sentences(c), c="One. Two? Three") == ["One.", "Two?", "Three"]
    assert one(spark, W.line_mentions(c), c="Line 3 and lines 5-7, line 3") == [2, 4, 5, 6]
    assert one(spark, W.action_kinds(c), c="They edited it, then ran the tests") == ["change", "saida_testar"]
    assert one(spark, W.ngrams(W.word_list(c), 3), c="a b") == []
    assert one(spark, W.type_token_ratio(W.word_list(c)), c="") is None


text = st.text("abc \n", max_size=25)


@settings(max_examples=150, deadline=None)
@given(text, text)
def test_bit_parallel_distance(a, b):
    assert D.distance(a, b) == _dp(a, b, lambda u, v, d, q: min(u + 1, v + 1, d + (not q)), lambda k: k)


def test_matching_of_spans():
    span = lambda lines: sum(1 << (x + 1) for x in lines)
    import numpy as np

    p, o = [[-1], [-1, 0], [-1, 0, 1]], [[-1], [-1, 0, 1, 2], [0, 1]]
    w = np.array([[D.iou(span(a), span(b)) for b in o] for a in p])
    pairs = D.best_matching(w)
    assert len(pairs) == 3 and sum(w[i, j] for i, j in pairs) == pytest.approx(13 / 6)
    assert D.best_matching(np.zeros((2, 3))) == []


BEFORE = "def f(xs):\n    total = 0\n    for n in xs:\n        total = total + n\n    return total"
OBSERVED = BEFORE.replace("total = total + n", "total += n")
PATH = [{"action": "edit", "start": 3, "end": 3}, {"action": "local_run", "start": None, "end": None}, {"action": "submit", "start": None, "end": None}]


def test_perfect_prediction():
    s = D.scores(BEFORE, OBSERVED, OBSERVED, PATH, PATH)
    assert len(s) == 21 and s["structural_lift_over_copy"] > 0 and s["worse_than_copy_rate"] == 0
    assert all(v == 1 for k, v in s.items() if k not in ("structural_lift_over_copy", "worse_than_copy_rate"))
    assert len(D.scores(BEFORE, OBSERVED, OBSERVED, PATH, PATH, "v1")) == 12


def test_relations_of_scores():
    spaced = OBSERVED.replace("\n", "  \n")
    assert D.repair_scores(BEFORE, spaced, OBSERVED) == D.repair_scores(BEFORE, OBSERVED, OBSERVED)
    wrong = BEFORE.replace("total = 0", "total += n")
    right, other = D.repair_scores(BEFORE, OBSERVED, OBSERVED), D.repair_scores(BEFORE, wrong, OBSERVED)
    assert other["aligned_content_f1"] < right["aligned_content_f1"]
    named = OBSERVED.replace("total += n", "summe += n")
    s = D.repair_scores(BEFORE, named, OBSERVED)
    assert s["aligned_content_structural_f1"] > s["aligned_content_identifier_f1"]
    assert D.repair_scores(BEFORE, OBSERVED, BEFORE)["code_gain_over_copy_raw"] is None
    assert D.repair_scores(BEFORE, BEFORE, BEFORE)["strict_footprint_f1"] == 0 and D.repair_scores(BEFORE, BEFORE, BEFORE)["windowed_footprint_f1"] == 1


def test_spans_and_regions():
    assert D.changed_span("a\nb\nc", "a\nx\ny\nc") == (1, 2) and D.changed_span("a\nb", "a") == (0, 0) and D.changed_span("a", "a") is None
    assert D.projected_span("a\nb", "z\na\nb", (1, 1)) == (2, 2) and D.projected_span("a\nb", "a", (1, 1)) is None
    assert D.repair_spans("a\nb\nc", "a\nx\nc\nd") == [(1, 1), (3, 3)]
    code = "for i in x:\n    if i:\n        print(i)\ny = 1"
    assert [D.focus_region(code, k) for k in range(5)] == ["loop_region", "conditional_region", "output_region", "no_region", "line_out_of_bounds"]
    assert D.focus_region("if", 0) == "does_not_parse"
    assert D.delta_summary("x = 1", "for i in x:\n    print(i)") == "changed_2_lines introduced_loop introduced_print"
    assert D.string_literals("a = 'x'\nb = f(\"y\")") == ["x", "y"] and D.string_literals("(") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_bag_f1(a, b):
    both = sum((Counter(a) & Counter(b)).values())
    want = 1.0 if not a and not b else 0.0 if not both else 2 * both / (len(a) + len(b))
    assert math.isclose(D.bag_f1(a, b), want)
