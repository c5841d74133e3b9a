import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.operators.quotient import QuotientTable, delivered_once, delivery_copies, permute, unpermute, words_of
from tapeloom.operators.sessions import sessions, student_sessions

START = datetime(2024, 3, 4, 8)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=60))
def test_permutation_loses_nothing(keys):
    words = words_of(keys, 6)
    assert (unpermute(permute(words)) == words).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "bb", "ccc", "d" * 15, "e", ""]), st.integers(0, 3)), max_size=80), st.integers(1, 7))
def test_table_against_dict(rows, step):
    table, best, lost = QuotientTable(3, bits=2), {}, []
    copies = [(k, t, i) for i, (k, t) in enumerate(rows)]
    for lo in range(0, len(copies), step):
        part = copies[lo : lo + step]
        words = permute(words_of([k.encode() for k, _, _ in part], 3))
        lost += table.insert(words, np.array([t for _, t, _ in part]), np.array([i for _, _, i in part])).tolist()
    for k, t, i in copies:
        best[k] = min(best.get(k, (9, 9**9)), (t, i))
    assert sorted(table.best()[2].tolist()) == sorted(i for _, i in best.values())
    assert sorted(lost) == sorted({i for _, _, i in copies} - {i for _, i in best.values()})


DELIVERY = "delivery_id bigint, custom_id string, run_condition string, received_ts timestamp, ident string"


def test_copies_with_nulls_ties_and_a_hot_message(spark):
    t = lambda k: START + timedelta(seconds=k)
    rows = [(1, " a:1 ", "full", t(5), "x"), (2, "a:1", "full", t(5), "x"), (3, "a:1\t", "none", None, "x"), (4, None, "full", t(1), "x"),
            (5, "a:1", None, t(1), "x"), (6, "a:1", None, None, "x"), (7, "b" * 500, "full", None, "x"), (8, "b" * 500, "full", t(9), "x")]
    rows += [(100 + k, "hot", "full", t(1000 - k % 7), "x") for k in range(3000)]
    df = spark.createDataFrame(rows, DELIVERY).repartition(5)
    kept = {r.delivery_id for r in delivery_copies(df).where("is_kept").collect()}
    assert kept == {1, 3, 5, 8, 106}
    once = delivered_once(df)
    assert {r.delivery_id for r in once.collect()} == kept | {4}
    assert once.columns == df.columns


def test_no_deliveries(spark):
    df = spark.createDataFrame([], DELIVERY)
    assert delivery_copies(df).count() == 0 and delivered_once(df).count() == 0


def brute(events, gap):
    out, by = [], {}
    for e, t, i in events:
        if e is not None and t is not None:
            by.setdefault(e, []).append((t, i))
    for e, rows in by.items():
        rows.sort()
        run = [rows[0]]
        for a in rows[1:]:
            if a[0] - run[-1][0] >= gap:
                out.append((e, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(a)
        out.append((e, run[0][1], run[-1][1], len(run)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_sessions_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        e = rng.choice(["u", "u", "u", "v", "w", None])
        t = None if rng.random() < 0.03 else START + timedelta(seconds=rng.choice([rng.randrange(200_000), 1800 * rng.randrange(60), 3600 * rng.randrange(30)]))
        rows.append((e, t, i))
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "student_id string, event_ts timestamp, event_id bigint, b string, session int")
    got = sorted(tuple(r) for r in sessions(df).select("student_id", "first_event_id", "last_event_id", "n_events").collect())
    assert got == brute(rows, timedelta(minutes=30))


def test_session_types_repeated_events_and_logs_without_student(spark):
    t = lambda k: START + timedelta(minutes=k)
    trace = spark.createDataFrame(
        [(1, 7, t(0), " Change "), (1, 7, t(0), "change"), (2, 7, t(31), "submit"), (3, 7, t(60), None), (4, 8, t(0), "x"), (5, 9, t(1), "run"), (6, 7, None, "x")],
        "event_id bigint, log_id bigint, event_ts timestamp, raw_type string")
    logs = spark.createDataFrame([(7, None), (7, " s1\t"), (7, "s1"), (8, " "), (9, "s1")], "log_id bigint, student_id string")
    got = {r.first_event_id: r.asDict() for r in student_sessions(trace, logs, by_kind=True).collect()}
    assert set(got) == {1, 2}
    assert got[1]["last_event_id"] == 5 and got[1]["events_by_kind"] == {"change": 1, "run": 1}
    assert got[2]["n_events"] == 2 and got[2]["events_by_kind"] == {"submit": 1, "unknown": 1} and got[2]["duration_seconds"] == 29 * 60
    assert student_sessions(trace.limit(0), logs).count() == 0
    assert student_sessions(trace, logs.where(F.lit(False))).count() == 0


def test_interval_stream_of_a_log_longer_than_a_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    from tapeloom.streaming import tapes

    kinds = (["change"] * 3 + ["saida_testar", "submit"]) * 6
    rows = [(1, i, k, datetime(2024, 3, 4) + timedelta(seconds=i), i) for i, k in enumerate(kinds)]
    rows = [rows[i * 7 % len(rows)] for i in range(len(rows))]  # out of order
    schema = "log_id bigint, event_id bigint, kind string, ts timestamp, line_number bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
        got = tapes.run_available(tapes.interval_stream(stream), "intervals").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.interval_idx, r.n_events, r.n_changes, r.n_runs) for r in got) == [(i, 5, 3, 1) for i in range(6)]


def test_a_null_key_is_no_text(spark):
    from pyspark.sql import functions as F

    from tapeloom.operators.quotient import message_copies

    rows = [(1, "a", None, START), (2, "a", "\x00", START), (3, "a", "-", START), (4, "a", None, START), (5, "a", "", START)]
    df = spark.createDataFrame(rows, "i bigint, k string, c string, t timestamp")
    got = {r.i: r.is_kept for r in message_copies(df, [F.col("k"), F.col("c")], "t", "i").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}
