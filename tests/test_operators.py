import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import baselines as B
from tapeloom.operators import conditions as O
from tapeloom.operators import contracts as K
from tapeloom.operators import inference as N
from tapeloom.operators import intervals as I
from tapeloom.operators import peers as P
from tapeloom.operators import replay as R
from tapeloom.operators import selection as L
from tapeloom.operators import views as V
from tapeloom.sources import documents as DOC
from tapeloom.sources import editor_log, execution_log

START = datetime(2024, 3, 4, 8)


def test_idle_gap_at_the_threshold(spark):
    t = [0, 30, 59.999]
    df = spark.createDataFrame([(1, START + timedelta(seconds=s), k, "change") for k, s in enumerate(t)], "log_id int, ts timestamp, n int, kind string")
    got = [r.kind for r in I.idle_gap_tape(df, ["log_id"], "ts", ["n"], "kind").orderBy("position").collect()]
    assert got == ["change", "idle_gap", "change", "change"]


def test_running_sums_over_buckets(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), START + timedelta(seconds=rng.choice([0, 1, 3600, 7200]) + rng.randrange(20_000)), i, rng.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(rows, "log_id int, ts timestamp, n int, shut boolean").withColumn("_other", F.lit(0))
    got = {r.n: (r.interval_idx, r.pos_in_interval) for r in I.islands(df, ["log_id"], ["ts", "n"], F.col("shut"), 600).collect()}
    want = {}
    for log in (1, 2):
        idx = pos = 0
        for _, t, n, shut in sorted((r for r in rows if r[0] == log), key=lambda r: (r[1], r[2])):
            want[n] = (idx, pos)
            idx, pos = (idx + 1, 0) if shut else (idx, pos + 1)
    assert got == want
    gaps = I.idle_gap_tape(df.withColumn("what", F.lit("change")), ["log_id"], "ts", ["ts", "n"], "what", 30.0, 600)
    places = [r.position for r in gaps.where("log_id = 1").orderBy("position").collect()]
    assert places == list(range(len(places)))


def test_semantic_events_and_mismatches(spark):
    from tapeloom.functions import code as C
    from tapeloom.functions import sequences as S

    e = spark.createDataFrame([("change", None), ("keyhandled", '"Enter"'), ("keyhandled", '"a"'), ("tab_click", ""), ("focus", ""), (None, "")], "k string, p string")
    assert [r.x for r in e.select(S.is_semantic(F.col("k"), F.col("p"), keys=True, navigation=False).alias("x")).collect()] == [True, True, False, False, False, False]
    m = spark.createDataFrame([("1\n2", "", "5"), ("1", "5", "5"), ("1\n2", "1", ""), ("1", "1\n1", ""), ("1", "1\n2", ""), ("1\n2", "3\n2", ""), ("1\n2", "1\n3", ""), ("1\n2\n3", "1\n9\n3", "")], "e string, a string, g string")
    got = [r.x for r in m.select(C.mismatch_signature(F.col("e"), F.col("a"), F.col("g")).alias("x")).collect()]
    assert got == ["empty_output", "unchanged_input_echo", "missing_output_lines", "repeated_output_value", "extra_output_lines", "wrong_first_output_line", "wrong_final_output_line", "other_output_mismatch"]


def test_peers_of_three(spark):
    rows = [("s", "a", "FF", 1), ("s", "b", "FF", 2), ("s", "c", "TF", 3), ("s", "a", None, 4)]
    df = spark.createDataFrame(rows, "scope string, student string, sig string, id int")
    assert P.peer_pairs(df, ["scope"], "sig", "student", "id").count() == 2
    assert P.peer_pairs(df, ["scope"], "sig", "student", "id", directed=False).count() == 1
    assert P.peer_pairs(df.limit(0), ["scope"], "sig", "student", "id").count() == 0


def test_discrimination_of_a_generic_model_is_chance(spark):
    pairs = spark.createDataFrame([("s", "g", a, b, 0.5, 0.5) for a in "abc" for b in "abc" if a != b], "scope string, grp string, a string, b string, own double, other double")
    d = P.discrimination(pairs, ["scope"], ["grp"], "a", "own", "other")
    assert d["summary"].first().auc == 0.5 and d["per_group"].first().mean_delta == 0


def test_views(spark):
    df = spark.sql("SELECT array(0.2D, 0.9D, 0.5D) AS s, array(0.6D, 0.1D, 0.3D) AS p")
    v = df.select(V.views(F.col("s"), F.col("p")).alias("v")).first().v
    assert (v.oracle, v.top_1, v.best_rank) == (0.9, 0.2, 3)
    assert v.expected == pytest.approx(0.36) and v.rank_weighted == pytest.approx(0.43)


def test_sign_test_and_flip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 0.0), ("c", 1.0)], "k string, d double")
    p = {r.k: r.p for r in N.sign_test(df, ["k"], "d").collect()}
    assert p["a"] == pytest.approx(1.0) and math.isnan(p["b"]) and p["c"] == pytest.approx(1.0)
    c = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, c double")
    assert N.sign_flip(c, ["k"]).first().p == 0.5


def test_wilcoxon_exact_and_ties(spark):
    df = spark.createDataFrame([("x", float(d)) for d in (1, 2, 3, 4, -5)] + [("z", 0.0)], "k string, d double")
    got = {r.k: r for r in N.wilcoxon(df, ["k"], "d").collect()}
    # W- = 5: P(W <= 5) over 32 sign patterns is 10 / 32
    assert got["x"].w_plus == 10 and got["x"].p == pytest.approx(2 * 10 / 32) and "z" not in got
    assert N.wilcoxon_p(0, 0, 0) == 1.0


def test_t_distribution():
    assert N.student_t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert N.student_t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    r = df.agg(N.quantile("x", 0.025).alias("a"), N.quantile("x", 0.9, "floor_index").alias("b"), N.quantile("x", 0.5, "nearest").alias("c")).first()
    assert r.a == pytest.approx(1.1) and r.b == 4 and r.c == 3


def test_proper_scores(spark):
    h = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, None, 1.0)], "id int, label string, p double")
    t = spark.createDataFrame([(1, "b"), (2, "x")], "id int, truth string")
    m = {r.id: r for r in V.categorical_metric(V.distribution(h, ["id"], F.col("label")), t, ["id"]).collect()}
    assert m[1].top_label == "b" and m[1].truth_rank == 2 and m[1].top1_match and m[1].mrr == 0.5 and m[1].brier == pytest.approx(0.5)
    assert m[2].truth_rank is None and m[2].brier == pytest.approx(2.0) and m[2].log_loss == pytest.approx(-math.log(1e-12))


def test_registry_refuses_a_name_twice():
    r = V.MetricRegistry()
    r.register("m", lambda e: e, [])
    with pytest.raises(ValueError):
        r.register("m", lambda e: e, [])


def test_leave_one_out(spark):
    c = spark.createDataFrame([("a", "h", "x", 2), ("b", "h", "x", 1), ("b", "h", "y", 1)], "s string, h string, l string, n int")
    got = {(r.s, r.l): r.p for r in B.leave_one_out(c, "s", ["h"], "l").collect()}
    assert got == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 1.0, ("b", "y"): 0.0}


def test_conditions(spark):
    df = spark.sql("SELECT transform(sequence(0, 3), i -> named_struct('code', i, 'trace', i)) AS a")
    left = lambda c: [x.trace for x in df.select(O.visible(F.col("a"), c).alias("a")).first().a]
    assert left("full") == [0, 1, 2, 3] and left("no_trace") == [None] * 4 and left("dosage_25") == [None, None, None, 3] and left("dosage_75") == [None, 1, 2, 3]
    assert df.select(O.leak(F.col("a"), "no_trace").alias("r")).first().r == "trace_left_in"
    with pytest.raises(ValueError):
        O.visible(F.col("a"), "other")


def test_contracts(spark):
    df = spark.sql("SELECT array(0.5D, 0.3D, 0.2D) AS p, array(named_struct('action', 'edit', 'start', 2, 'end', 1), named_struct('action', 'submit', 'start', -1, 'end', -1)) AS s")
    r = df.select(K.probability_problem(F.col("p"), 3, 3, 1e-3).alias("p"), K.step_problem(F.col("s")).alias("s")).first()
    assert r.p is None and r.s == "bad_step"
    a = spark.createDataFrame([(1,), (None,)], "k int")
    assert K.key_differences(a, a, ["k"]).count() == 0 and K.key_differences(a, a.limit(0), ["k"]).count() == 2
    with pytest.raises(ValueError):
        K.require_none(K.duplicate_keys(a.union(a), ["k"]), "repeated")


def test_quotas():
    assert L.quotas(8, ["T1", "T2", "T3"]) == {"T1": 3, "T2": 3, "T3": 2}
    assert L.rebalanced({"T1": 3, "T2": 3, "T3": 2}, {"T1": 1, "T2": 10, "T3": 10}) == {"T1": 1, "T2": 4, "T3": 3}
    assert L.rebalanced({"T1": 2}, {}) == {"T1": 0}


def test_degenerate_tertiles(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (None,)], "x double")
    assert [r.tertile for r in L.tertiles(df, "x").collect()] == ["T1", "T1", None]
    assert L.tertiles(df.where("x IS NULL"), "x").first().tertile is None


def test_replay_and_removed_text(spark):
    change = lambda a, x, b, y, *t: f'{{"from":{{"line":{a},"ch":{x}}},"to":{{"line":{b},"ch":{y}}},"text":{list(t)}}}'.replace("'", '"')
    rows = [("change", change(0, 0, 0, 0, "ab", "cd")), ("saida_testar", ""), ("change", change(0, 1, 1, 1, "X")), ("change", change(9, 0, 9, 0, "!")), ("submit", ""), ("change", "broken"), ("submit", "")]
    df = spark.createDataFrame([(1, k, p, START + timedelta(seconds=n), n) for n, (k, p) in enumerate(rows)], "log_id bigint, kind string, payload string, ts timestamp, n int")
    got = R.replayed_blocks(df, ["n"]).orderBy("submit_index").collect()
    assert [b.code for b in got] == ["aXd", "aXd"]
    assert (got[0].n_changes, got[0].n_rejected, got[0].first_reason, got[0].chars_out) == (2, 1, "line_out_of_bounds", 3)
    assert got[1].n_rejected == 1 and got[1].first_reason == "malformed_change" and [s.action for s in got[1].steps] == ["submit"]
    assert R.replayed_blocks(df.limit(0), ["n"]).count() == 0


def test_bootstrap_plan_does_not_grow_with_the_clusters(spark):
    """i10_i13_paired_bootstrap"""
    from tapeloom.operators import inference as N

    sums = spark.range(5_000).select(F.col("id").alias("g"), F.col("id").cast("double").alias("sl"), F.lit(1).alias("nl"), F.lit(0.0).alias("sr"), F.lit(1).alias("nr"))
    boot = N.bootstrap_means(sums, ["g"], 3, 42)
    assert len(boot._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert boot.count() == 3


def test_texts_of_a_scope_are_compared_in_tiles(spark, monkeypatch):
    """d06_d07_threshold_sweep, g27_g45_scope_distances: all pairs once, over several tiles, with no join that makes them."""
    import random

    from tapeloom.functions.diff import distance
    from tapeloom.operators import peers as P

    monkeypatch.setattr(P, "FIRST", 4)
    monkeypatch.setattr(P, "SECOND", 8)
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("ab\n\u00e9\U0001f600") for _ in range(rng.choice([0, 1, 9, 70])))
    rows = [(k, rng.choice(["s", "t", None]), rng.choice(["x", "y", "z", "u", None]), rng.choice([text(), text(), None])) for k in range(90)]
    df = spark.createDataFrame(rows, "id bigint, scope string, actor string, code string")
    wanted = {(s, i, j): distance(x, y) / (len(x) + len(y)) if x or y else 0.0 for i, s, a, x in rows for j, q, b, y in rows if i < j and s and s == q and a and b and a != b and x is not None and y is not None}
    far = P.text_distances(df, ["scope"], "actor", "id", "code")
    got = far.collect()
    assert "Join" not in far._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) == len(wanted) and {(r.scope, r.a, r.b): r.distance for r in got} == wanted
    sweep = {r.tau: (r.n_pairs, r.n_rows) for r in P.threshold_sweep(far, "distance", (0.0, 0.3, 1.0)).collect()}
    assert sweep == {t: (sum(d <= t for d in wanted.values()), len({k for p, d in wanted.items() if d <= t for k in p[1:]})) for t in (0.0, 0.3, 1.0)}


def _random_texts(rng, n):
    common, rare = ["the", "a", "loop", "n\u00e3o", "x1"], [f"w{k}" for k in range(3 * n)]
    text = lambda: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.choice([1, 4, 12])))
    rows = [(f"d{k}", rng.choice(["f", "n", None]), rng.choice([text(), text(), text(), "the loop", " . ", None])) for k in range(n)]
    return [*rows, ("one", "alone", "the loop")]


def _pairs_by_hand(spark, df, asked):
    from tapeloom.operators import prose as P

    w = {}
    for r in P.weights(df, ["doc"], "text").collect():
        w.setdefault(r.doc, {})[r.token] = r.w
    return {(q, d): sum(x * w[d][t] for t, x in w[q].items() if t in w[d]) for q in w for d in w if asked(q) and q != d and w[q].keys() & w[d].keys()}


def test_similarities_of_queries_come_from_tiles(spark, monkeypatch):
    """j55_similarity_to_queries: each pair once, over several tiles; words aren't joined with words."""
    import random

    from tapeloom.operators import prose as P

    monkeypatch.setattr(P, "TILE", 20)
    df = spark.createDataFrame(_random_texts(random.Random(3), 120), "doc string, c string, text string")
    lists = P.word_lists(df, [], "doc", "text")
    met = P.similarity_to(lists.where("doc LIKE '%1%'"), lists)
    wanted = _pairs_by_hand(spark, df, lambda q: "1" in q)
    got = met.collect()
    assert "token" not in met._jdf.queryExecution().optimizedPlan().toString() and "Aggregate [query" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) == len(wanted) and {(r["query"], r.doc): r.similarity for r in got} == pytest.approx(wanted, abs=1e-12)
    assert P.similarity_to(lists.where("false"), lists).count() == 0


def test_a_tile_of_many_queries_is_cut(spark, monkeypatch):
    """j55_similarity_to_queries, m62_similarity_deltas: some queries at a time, fewer where their words are many."""
    import numpy as np
    import pyarrow as pa
    from tapeloom.operators import prose as P

    rng = np.random.default_rng(4)
    words = [sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) for _ in range(40)]
    rows = pa.table({"doc": [f"d{k:02d}" for k in range(40)] * 2, "words": pa.array(words * 2, pa.list_(pa.int64())), "weights": pa.array([[1.0 + x for x in w] for w in words] * 2, pa.list_(pa.float64())), "query": [False] * 40 + [True] * 40})
    wanted = np.array([[0 if i == j else sum((1.0 + x) ** 2 for x in set(a) & set(b)) for j, b in enumerate(words)] for i, a in enumerate(words)])
    for width, table in ((256, 1 << 26), (7, 1 << 26), (256, 2_000)):
        monkeypatch.setattr(P, "WIDTH", width)
        monkeypatch.setattr(P, "TABLE", table)
        parts = list(P._similarities(rows))
        assert np.allclose(np.hstack([out for _, out in parts]), wanted)
        assert (len(parts) > 1) == ((width, table) != (256, 1 << 26))


def test_statistics_of_similarities_without_their_rows(spark, monkeypatch):
    """m62_similarity_deltas: exact median, mean and spread of each group; what is shuffled doesn't grow with the pairs."""
    import random

    import numpy as np
    from tapeloom.operators import prose as P

    monkeypatch.setattr(P, "TILE", 7)
    rows = _random_texts(random.Random(5), 150)
    df = spark.createDataFrame(rows, "doc string, c string, text string")
    lists = P.word_lists(df, ["c"], "doc", "text")
    kind = {d: c for d, c, _ in rows}
    pairs = _pairs_by_hand(spark, df, lambda q: "1" in q)
    got = {r.c: r for r in P.similarity_statistics(lists.where("doc LIKE '%1%'"), lists, ["c"]).collect()}
    assert set(got) == {"f", "n"}
    for c, r in got.items():
        s = np.array([v for (q, d), v in pairs.items() if kind[q] == kind[d] == c])
        assert r.n == len(s) and (r["mean"], r["median"], r["sd"]) == pytest.approx((s.mean(), np.median(s), s.std()), abs=1e-12)
    assert P.similarity_statistics(lists.where("false"), lists, ["c"]).count() == 0


def test_joined_texts_are_compared_as_one_by_one():
    """run_report: edit distances to some texts of many that stand in one long integer, empty and repeated ones too."""
    import random

    from tapeloom.functions.diff import distance
    from tapeloom.functions.distances import Joined

    rng = random.Random(6)
    text = lambda: "".join(rng.choice("ab\n\u00e9\U0001f600") for _ in range(rng.choice([0, 1, 3, 29, 30, 31, 70])))
    for _ in range(100):
        others, own = [text() for _ in range(rng.choice([1, 2, 9, 30]))], text()
        low = rng.randrange(len(others))
        high = rng.randint(low + 1, len(others))
        assert Joined(others).to(own, low, high) == [distance(own, t) for t in others[low:high]]


def test_run_report_measures_programs_once(spark, monkeypatch):
    """run_report: rows that share a program, null and empty ones, null scores; pairs hold no program."""
    import random

    from tapeloom.functions.diff import distance
    from tapeloom.operators import peers as P
    from tapeloom.operators import reports as R

    calls = []
    whole = P.text_distances
    monkeypatch.setattr(P, "text_distances", lambda *a: calls.append(whole(*a)) or calls[-1])
    monkeypatch.setattr(P, "FIRST", 4)
    monkeypatch.setattr(P, "SECOND", 8)
    rng = random.Random(7)
    texts = ["", *["".join(rng.choice("abc\n") for _ in range(rng.choice([5, 9, 40]))) for _ in range(14)]]
    rows = [(k, rng.choice("st"), rng.choice(["f", "n"]), rng.choice(["x", "y", "z", "u", None]), rng.choice([*texts, None]), rng.choice([[True], [False], None]), rng.choice([0.2, 0.5, None]), rng.choice([0.1, 0.5, 0.9])) for k in range(150)]
    df = spark.createDataFrame(rows, "row bigint, scope string, c string, actor string, code string, vector array<boolean>, own double, e double")
    score = 1 - F.abs(F.col("e_a") - F.col("e_b"))
    far = lambda x, y: distance(x, y) / (len(x) + len(y)) if x or y else 0.0
    met = [(a, b) for a in rows for b in rows if a[1:3] == b[1:3] and None not in (a[3], b[3], a[5], a[6]) and a[5] == b[5] and a[3] != b[3]]
    for within in (["scope"], None):
        got = {r.tau: r for r in R.run_report(df, ["scope", "c"], "actor", "row", score, (0.0, 0.3, 0.45), within=within).collect()}
        assert set(got) == {None, 0.0, 0.3, 0.45}
        for tau, r in got.items():
            near = [(a, b) for a, b in met if tau is None or None not in (a[4], b[4]) and far(a[4], b[4]) <= tau]
            delta = [a[6] - (1 - abs(a[7] - b[7])) for a, b in near]
            assert (r.n_pairs, r.n_scopes) == (len(near), len({a[1:3] for a, _ in near}))
            assert (r.mean_delta, r.auc) == pytest.approx((sum(delta) / len(near), sum((d > 0) + 0.5 * (d == 0) for d in delta) / len(near)))
    once = {(s, tuple(v), c) for _, s, _, _, c, v, _, _ in rows if c is not None and v is not None}
    assert calls[0].count() <= sum(1 for a in once for b in once if a < b and a[:2] == b[:2])


def _random_log(rng, n):
    import json

    for _ in range(n):
        if rng.random() < 0.25:
            yield rng.choice(["saida_testar", "submit"]), None
            continue
        a, x = rng.choice([rng.randint(0, 3), rng.randint(0, 90)]), rng.randint(0, 2)
        b, y = a + rng.choice([0, 0, 2]), x + rng.choice([0, 0, 2])
        text = rng.choice([[""], ["a"], ["b", ""], ["", ""], ["c\nd"] if rng.random() < 0.05 else ["e"], [f"w{rng.randint(0, 999)}" for _ in range(30)]])
        yield "change", json.dumps({"from": {"line": a, "ch": x}, "to": {"line": b, "ch": y}, "text": text})


def test_paths_from_touched_lines_are_those_of_whole_programs():
    """f02_replay_counts, k03_path_contract: with no program joined or compared as a whole."""
    import random

    from tapeloom.functions.diff import coarse_steps

    rng, joined = random.Random(3), 0
    for seed in ["", "", "a\nb", "\n".join(f"s{k}" for k in range(60))] * 20:
        logs = [R._Log(1, seed), R._Log(1, seed, programs=False), R._Log(1, seed, programs=False, paths=False)]
        anchors, edited = [], False
        for kind, payload in _random_log(rng, 150):
            done = logs[0].changes
            rows = [log.take(kind, payload, None) for log in logs]
            edited |= kind == "change" and logs[0].changes > done
            if kind != "change":
                anchors.append((kind, "\n".join(logs[0].lines), edited))
                edited = False
            if rows[0]:
                assert rows[0][12:] == coarse_steps(rows[0][2], anchors) and rows[1] == rows[0][:2] + rows[0][4:] and rows[2] == rows[1][:-2]
                anchors = []
                joined += logs[1].code != ""
    assert joined < 80 * 20


def test_rows_of_large_programs_are_handed_over_early():
    """f01_f05_replay: never more than a few large programs at once."""
    import json

    big = "x" * (R.FRAME_CHARS // 4)
    change = json.dumps({"from": {"line": 0, "ch": 0}, "to": {"line": 0, "ch": 0}, "text": [big]})
    rows = [(1, "change", change, None, "")] + [(1, "submit", None, None, "")] * 12
    names = [f.split()[0] for f in R._BLOCK.split(", ") if not f.startswith(("start int", "end int"))]
    frames = list(R._fold(names, True, True)([pd.DataFrame(rows, columns=["log_id", "kind", "payload", "ts", "seed"])]))
    assert sum(map(len, frames)) == 12 and max(map(len, frames)) <= 3
    assert [n for f in frames for n in f["submit_index"]] == list(range(12))


def test_parts_of_logs_give_the_rows_of_whole_logs():
    """f01_f05_replay: whatever the sizes of parts and packs."""
    import random

    rng, parts = random.Random(7), 0
    names = [f.split()[0] for f in R._BLOCK.split(", ") if not f.startswith(("start int", "end int"))]
    for most in [1, 500, 5_000, 10**9] * 3:
        rows = [(k, kind, payload, str(n), seed) for k, seed in enumerate(["", "a\nb", "\n".join(f"s{k}" for k in range(60))]) for n, (kind, payload) in enumerate(_random_log(rng, 150))]
        df = pd.DataFrame(rows, columns=["log_id", "kind", "payload", "ts", "seed"])
        packs = pd.concat(R._cut([f.split()[0] for f in R._PACK.split(", ")], most)([df[:200], df[200:]]))
        packs = packs.sort_values(["width", "log_id", "part", "place"], ascending=[False, True, True, True])
        want = pd.concat(R._fold(names, True, True)([df]))
        got = pd.concat(R._replayed_parts(names, True)([packs[:3], packs[3:]])).sort_values(["log_id", "submit_index"])
        assert want.astype(object).where(want.notna(), None).values.tolist() == got.astype(object).where(got.notna(), None).values.tolist()
        assert packs["chars"].sum() == (want["start_code"].str.len() + want["code"].str.len()).sum()
        parts += len(packs[["log_id", "part"]].drop_duplicates())
    assert parts > 300


def test_programs_of_a_long_log_are_spread_over_tasks(spark, monkeypatch):
    """f01_f05_replay: a task holds the programs of a part, however long a log gets."""
    import json

    monkeypatch.setattr(R, "PART_CHARS", 300_000)
    lines = [f"{k:04d}" * 50 for k in range(150)]
    change = lambda k: json.dumps({"from": {"line": k, "ch": 0}, "to": {"line": k, "ch": 0}, "text": [lines[k], ""]})
    rows = [(1, kind, change(k) if kind == "change" else None, START + timedelta(microseconds=k), 2 * k + (kind == "submit")) for k in range(150) for kind in ("change", "submit")]
    df = spark.createDataFrame(rows, "log_id bigint, kind string, payload string, ts timestamp, n int")
    got = R.replayed_blocks(df, ["n"]).withColumn("task", F.spark_partition_id()).orderBy("submit_index").collect()
    assert [(b.submit_index, b.code) for b in got] == [(k, "".join(f"{x}\n" for x in lines[: k + 1])) for k in range(150)]
    assert [b.submit_ts for b in got] == [r[3] for r in rows if r[1] == "submit"] and [b.start_code for b in got[1:]] == [b.code for b in got[:-1]]
    held = {}
    for b in got:
        held[b.task] = held.get(b.task, 0) + len(b.start_code) + len(b.code)
    assert sum(held.values()) > 4_000_000 and max(held.values()) < 2.5 * R.PART_CHARS


def test_monotone_alignments():
    assert R.monotonic_count([[0, 1], [1]]) == 1 and R.unique_alignment([[0, 1], [1]]) == [0, 1]
    assert R.monotonic_count([[0, 1], [2]]) == 2 and R.unique_alignment([[0, 1], [2]]) is None
    assert R.monotonic_count([[1], [0]]) == 0 and R.unique_alignment([[1], [0]]) is None and R.unique_alignment([[]]) is None


EXECUTION = """== SUBMITION (2024-03-04 08:00:10)
-- CODE:
print('-- hi')
-- GRADE:
50%
-- TEST CASE 1:
---- input:
1
---- correct output:
2
---- user output:
2 
-- TEST CASE 2:
---- input:
---- correct output:
3
---- user output:
4
== TEST (2024-03-04 08:00:05)
-- CODE:
x
== SUBMITION (2024-03-04 08:00:01)
-- CODE:
y
"""


def test_execution_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(EXECUTION)
    (tmp_path / "b.log").write_text("nothing")
    rows = execution_log.read_attempts(spark, str(tmp_path)).orderBy("log", "attempt").collect()
    assert [(r.attempt, r.code, r.reason) for r in rows] == [(0, "y", "no_grade"), (1, "print('-- hi')", None), (0, None, "no_sections")]
    assert [t.passed for t in rows[1].tests] == [True, False] and rows[1].grade == 50


def test_editor_log_files(spark, tmp_path):
    lines = ["2024-03-04 08:00:00.5#change#{\"a\":1}", "", "2024-03-04 08:00:01#saida_testar#", "out # 1", "out 2", "2024-03-04 08:00:02#change#{", "stray", "2024-03-04 08:00:03#keyHandled#\"Enter\""]
    (tmp_path / "e.log").write_text("\n".join(lines))
    events, rejects = editor_log.events(editor_log.read_lines(spark, str(tmp_path)))
    got = events.orderBy("own_line").collect()
    assert [(e.raw_type, e.output_lines, e.line_number) for e in got] == [("change", [], 1), ("saida_testar", ["out # 1", "out 2"], 5), ("keyHandled", [], 8)]
    assert sorted((r.line_no, r.reason) for r in rejects.collect()) == [(6, "malformed_change"), (7, "malformed_line")]
    assert events.where("raw_type = 'keyHandled'").select(editor_log.key_name(F.col("payload")).alias("k")).first().k == "Enter"


def test_listing_assessments_and_json(spark, tmp_path):
    for name in ("executions", "codemirror"):
        (tmp_path / "c1/users/s1" / name).mkdir(parents=True)
    (tmp_path / "c1/users/s1/executions/10_20.log").write_text("x")
    (tmp_path / "c1/users/s1/executions/10_21.log").write_text("x")
    (tmp_path / "c1/users/s1/codemirror/10_20.log").write_text("x")
    files = DOC.list_files(spark, str(tmp_path))
    pairs = DOC.log_pairs(DOC.log_files(files, "executions"), DOC.log_files(files, "codemirror"))
    assert {(r.exercise_id, r.reason) for r in pairs.collect()} == {("20", None), ("21", "codemirror_log_missing")}
    (tmp_path / "c1/assessments").mkdir()
    (tmp_path / "c1/assessments/10.data").write_text("---- assessment title: Lab 1\n---- exercise 1: 20\n---- exercise 2: 21\n")
    a = DOC.read_assessments(spark, str(tmp_path / "c1/assessments")).first()
    assert (a.class_id, a.assessment_id, a.title, a.exercises, a.reason) == ("c1", "10", "Lab 1", ["20", "21"], None)
    (tmp_path / "o.jsonl").write_text('{"custom_id": "a"}\n\n{"custom_id": "a"}\n')
    with pytest.raises(ValueError):
        DOC.read_contract(spark, str(tmp_path / "o.jsonl"), "custom_id string", ["custom_id"])
    DOC.write_bundles(spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().v == 1
    assert DOC.markdown_table(spark.createDataFrame([("a", 0.5)], "k string, v double")).splitlines()[-1] == "| a | 0.5 |"


def test_strict_pairs_and_expectations(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.1)], "k int, t string, v double")
    got = K.strict_pairs(a, a, ["k"], ["t"]).orderBy("k").collect()
    assert [(r.v, r.v_right) for r in got] == [(0.5, 0.5), (0.1, 0.1)]
    for bad in (a.limit(1), a.withColumn("t", F.lit("z")), a.union(a)):
        with pytest.raises(ValueError):
            K.strict_pairs(a, bad, ["k"], ["t"])
    e = {r.check_name: (r.n_violations, r.holds) for r in K.expectations({"none": a.limit(0), "two": a}).collect()}
    assert e == {"none": (0, True), "two": (2, False)}
    j = spark.createDataFrame([('{"a": 1}',), ("[",), (None,)], "j string")
    assert [r.m for r in j.select(K.missing_json_keys(F.col("j"), ["a", "b"]).alias("m")).collect()] == [["b"], ["a", "b"], ["a", "b"]]


def test_priority_and_examples(spark):
    f = spark.createDataFrame([("d/x.json",), ("d/results_1.jsonl",), ("d/results_2.jsonl",), ("e/x.json",), ("e/y.txt",)], "path string")
    assert {r.directory: r.path for r in DOC.by_priority(f, [r"results_.*\.jsonl$", r"\.json$"]).collect()} == {"d": "d/results_2.jsonl", "e": "e/x.json"}
    p, o = spark.createDataFrame([("a", 1), ("b", 2)], "custom_id string, hyps int"), spark.createDataFrame([("b", 3), ("c", 4)], "custom_id string, events int")
    assert {r.custom_id: r.reason for r in DOC.examples(p, o).collect()} == {"a": "no_observed_events", "b": None, "c": "no_prediction"}


def test_ranks_against_sorting(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([float(rng.randrange(30)), None, rng.random()])) for _ in range(500)]
    got = N.average_ranks(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", buckets=7).collect()
    for key in "ab":
        xs = [x for k, x in rows if k == key and x is not None]
        want = sorted((x, sum(y < x for y in xs) + (xs.count(x) + 1) / 2) for x in xs)
        assert sorted((r.x, r["rank"]) for r in got if r.k == key) == want


def test_texts_keep_their_letters(spark, tmp_path):
    from tapeloom.plans import cohorts, scalars

    at = datetime(2024, 3, 4)
    texts = ["O aluno n\u00e3o corrigiu; run\u00e9 \u00e9\u00a0outro", "\u0441\u0442\u0443\u0434\u0435\u043d\u0442 runs line 3", "caf\u00e9 cafe\u0301 caf\u00e8"]
    rows = [(f"c{i}", "full_trace", i, at, "e", f"s{i}", t) for i, t in enumerate(texts)]
    schema = "custom_id string, run_condition string, delivery_id bigint, received_ts timestamp, exercise_id string, student_id string, summary string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/summary_record.parquet")
    words = {r.custom_id: r for r in scalars.j56_j66_word_features(spark, str(tmp_path)).collect()}
    assert [words[f"c{i}"].n_words for i in range(3)] == [7, 4, 3] and words["c2"].ttr == 1
    assert words["c0"].opening == "o aluno n\u00e3o" and words["c1"].opening == "\u0441\u0442\u0443\u0434\u0435\u043d\u0442 runs line"
    rates = {r.family: r.hits for r in cohorts.g43_g39_term_rates(spark, str(tmp_path)).collect()}
    assert rates == {"line": 1, "run": 1}  # `run` with an accented letter behind it is another word
    code = spark.createDataFrame([("1", "c", "a", "e", "s", "x = '\u00e9'", "x = '\u00e8'", [True])],
        "candidate_id string, class_id string, assessment_id string, exercise_id string, student_id string, attempt_n_code string, attempt_n1_code string, attempt_n_pass_fail_vector array<boolean>")
    code.withColumn("custom_id", F.lit("k")).write.parquet(f"{tmp_path}/validated_candidate.parquet")
    from tapeloom.plans.inputs import programs

    assert programs(spark, str(tmp_path)).where("code_n = code_n1").count() == 0


def test_sign_flip_query_takes_every_cluster(spark):
    from itertools import product

    from tapeloom.plans import studies

    root = "/root/testdata/sf0.001"
    c = [r.c for r in N.contributions(N.contrast_clusters(*studies._conditions(spark, root), ["scope"], "top_1_score"), ["scope"]).collect()]
    assert len(c) == 14
    got = studies.i08_sign_flip(spark, root).first()
    hits = sum(abs(sum(s * x for s, x in zip(signs, c))) + 1e-12 >= abs(sum(c)) for signs in product((1, -1), repeat=len(c)))
    assert (got.n_assignments, got.exact) == (2**14, True) and got.p == pytest.approx(hits / 2**14)


def test_sign_flip_of_ten_clusters_is_exact(spark):
    from itertools import product

    c = [0.3, -0.1, 0.25, 0.05, -0.4, 0.15, 0.2, -0.05, 0.35, 0.1]
    got = N.sign_flip(spark.createDataFrame(list(enumerate(c)), "scope int, c double"), ["scope"]).first()
    hits = sum(abs(sum(s * x for s, x in zip(signs, c))) + 1e-12 >= abs(sum(c)) for signs in product((1, -1), repeat=10))
    assert (got.p, got.n_assignments, got.exact) == (pytest.approx(hits / 1024), 1024, True)



def test_headers_with_every_line_end(spark, tmp_path):
    from tapeloom.plans import programs

    texts = ["-- TEST CASE 1:\nok\n-- TEST CASE 2:\n", "-- TEST CASE 1:\r\nok\r\n-- TEST CASE 2:\r\n", "-- TEST CASE 1:\rok\r-- TEST CASE 2:\r", "x -- TEST CASE 1:\r\n"]
    rows = [(f"d{i}", "run_output", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id string, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_headers for r in programs.a03_test_case_headers(spark, str(tmp_path)).collect()}
    assert got == {"d0": 2, "d1": 2, "d2": 2}
