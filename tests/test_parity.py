"""Every core query against its SQL on the smallest tables; those without SQL by round trips and what must hold of them."""

import duckdb
import pytest

from tapeloom.functions import diff as D
from tapeloom.plans import catalogue
from tests.compare import connection, rows_of_spark, rows_of_sql

DATA = "/root/testdata/sf0.001"
NAMES = [(m, n) for m in catalogue.MODULES for n in m.QUERIES if n in m.ORACLE]
WITHOUT_SQL = {"j10_j16_hunks", "j33_j35_delta", "j27_scores", "j28_scores_v1", "m24_m25_truth_scores", "f01_f05_replay", "k03_path_contract"}


@pytest.fixture(scope="module")
def sql():
    return connection(DATA)


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, sql, module, name):
    assert rows_of_spark(module.QUERIES[name](spark, DATA)) == rows_of_sql(sql, module.ORACLE[name])


def run(spark, name):
    return next(m.QUERIES[name] for m in catalogue.MODULES if name in m.QUERIES)(spark, DATA).collect()


def test_queries_without_sql_are_those_below():
    assert {n for m in catalogue.MODULES for n in m.QUERIES if n not in m.ORACLE} == WITHOUT_SQL


@pytest.fixture(scope="module")
def programs():
    rows = duckdb.sql(f"SELECT candidate_id, attempt_n_code, attempt_n1_code FROM '{DATA}/validated_candidate.parquet' WHERE attempt_n_code IS NOT NULL AND attempt_n1_code IS NOT NULL").fetchall()
    return {k: (a, b) for k, a, b in rows}


def test_hunks_turn_one_program_into_the_other(spark, programs):
    """j10_j16_hunks"""
    found = {}
    for r in run(spark, "j10_j16_hunks"):
        found.setdefault(r.candidate_id, []).append(r)
    for k, (a, b) in programs.items():
        x, y = D.narrow(a), D.narrow(b)
        lines = x.split("\n") if x else []
        for h in sorted(found.get(k, []), key=lambda h: -h.k):
            assert "\n".join(lines[h.start : h.stop]) == h.removed
            lines[h.start : h.stop] = h.added.split("\n") if h.added or h.start < h.stop and h.removed == "" else []
        assert "\n".join(lines).replace("\n", "") == y.replace("\n", "")
        assert (k in found) == (x != y)


def test_lines_outside_the_changed_spans_stand_in_both_programs(spark, programs):
    """j33_j35_delta"""
    import json

    for r in run(spark, "j33_j35_delta"):
        a, b = programs[r.candidate_id]
        old, new = a.split("\n"), b.split("\n")
        changed = {k for s in json.loads(r.spans) for k in range(s["start"], s["end"] + 1)}
        rest = iter(old)
        assert all(any(line == x for x in rest) for k, line in enumerate(new) if k not in changed)
        assert (not changed) == (a == b) and r.delta.startswith("changed_")
        assert r.region is None or r.region.endswith("_region") or r.region in ("line_out_of_bounds", "does_not_parse")


@pytest.mark.parametrize("name", ["j27_scores", "j28_scores_v1"])
def test_scores_by_hand(spark, programs, name):
    """j27_scores, j28_scores_v1: the plain functions on the same hypotheses, and the views by their definition."""
    version = "v2" if name == "j27_scores" else "v1"
    got = {}
    for r in run(spark, name):
        got.setdefault(r.candidate_id, {})[r.metric] = r
    assert set(got) == set(programs)
    step = lambda n: [{"action": "edit", "start": n, "end": n + 1}, {"action": "submit", "start": None, "end": None}]
    for k, (a, b) in programs.items():
        hyps = [(0.5, b, step(k % 7)), (0.3, a.replace("print", "write"), step(k % 5)), (0.2, a + "\npass", step(0))]
        scores = [D.scores(a, code, b, steps, step(k % 7), version) for _, code, steps in hyps]
        for metric, r in got[k].items():
            s = [x[metric] for x in scores]
            if None in s:
                continue
            assert r.oracle == pytest.approx(max(s)) and r.top_1 == pytest.approx(s[0]) and r.expected == pytest.approx(sum(p * x for (p, _, _), x in zip(hyps, s)))
            assert r.rank_weighted == pytest.approx(0.5 * s[0] + 0.3 * s[1] + 0.2 * s[2]) and s[r.best_rank - 1] == max(s)


def test_the_truth_is_always_right(spark, programs):
    """m24_m25_truth_scores"""
    rows = run(spark, "m24_m25_truth_scores")
    assert {r.candidate_id for r in rows} == set(programs) and all(r.oracle == r.top_1 == 1 and r.expected == pytest.approx(1) for r in rows)


def test_blocks_follow_one_another(spark, sql):
    """f01_f05_replay, k03_path_contract"""
    blocks = {}
    for r in run(spark, "f01_f05_replay"):
        blocks.setdefault(r.log_id, []).append(r)
    for of in blocks.values():
        of.sort(key=lambda r: r.submit_index)
        assert [r.submit_index for r in of] == list(range(len(of)))
        for a, b in zip(of, of[1:]):
            assert b.start_code == a.code
        for r in of:
            assert len(r.code) == len(r.start_code) + r.chars_in - r.chars_out
    paths = run(spark, "k03_path_contract")
    assert len(paths) == sum(map(len, blocks.values())) and all((r.problem is None) == (r.steps_reason is None) for r in paths)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
