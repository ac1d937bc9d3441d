"""Hypothesis properties of the operators that replace windows and joins."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quizlens.operators import rank as RK
from quizlens.operators import rollup as RU
from quizlens.operators import score as SC
from quizlens.plans import reports as RP

T0 = dt.datetime(2024, 1, 1)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 30)), min_size=1, max_size=80),
       st.integers(1, 9))
def test_positions_match_sorting(spark, rows, parts):
    data = [(i, s, T0 + dt.timedelta(seconds=t)) for i, (s, t) in enumerate(rows, start=1)]
    df = spark.createDataFrame(data, "answer_id bigint, session_id bigint, answered_at timestamp_ntz")
    got = {r.answer_id: (r.ordinal, r.is_last) for r in RK.question_positions(df.repartition(parts)).collect()}
    want = {}
    for s in {d[1] for d in data}:
        seq = sorted((d for d in data if d[1] == s), key=lambda d: (d[2], d[0]))
        for k, d in enumerate(seq, start=1):
            want[d[0]] = (k, k == len(seq))
    assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4), st.integers(0, 20)), min_size=1, max_size=60))
def test_dedupe_keeps_first_per_session_question(spark, rows):
    data = [(i, s, 1, q, "x", float(i), T0 + dt.timedelta(minutes=t), "hr")
            for i, (s, q, t) in enumerate(rows, start=1)]
    df = spark.createDataFrame(data, "answer_id bigint, session_id bigint, user_id bigint, question_id bigint, "
                                     "user_answer string, score double, answered_at timestamp_ntz, category string")
    got = sorted(r.answer_id for r in RU.dedupe_submissions(df.repartition(3)).collect())
    first = {}
    for d in data:
        k = (d[1], d[3])
        if k not in first or (d[6], d[0]) < (first[k][6], first[k][0]):
            first[k] = d
    assert got == sorted(d[0] for d in first.values())


words = st.sampled_from(["data", "spark", "join", "Join", "the", "key", "rows", "x1", "don't", "ünï"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.lists(words, max_size=8), st.lists(words, max_size=8)), min_size=1, max_size=20))
def test_text_cosine_symmetric_and_bounded(spark, pairs):
    data = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(data, "k bigint, a string, b string")
    ab = {r.k: r.score for r in SC.text_cosine(df, ["k"], "a", "b").collect()}
    ba = {r.k: r.score for r in SC.text_cosine(df, ["k"], "b", "a").collect()}
    assert ab == ba and all(0.0 <= v <= 100.0 for v in ab.values()) and len(ab) == len(data)


@pytest.mark.parametrize("seed,which", [(1, "oldest"), (2, "latest")])
def test_dashboard_state_plus_batches_equals_all(spark, seed, which):
    """Days merged one after another, in two orders, against one computation over all sessions."""
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, 4]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(400)),
             rnd.choice([None, 0.0, 47.5, 88.25, 100.0]), rnd.choice(["hr", "ml", None]), 10) for i in range(160)]
    schema = "id bigint, user_id bigint, interview_date timestamp_ntz, overall_score double, category string, total_questions int"
    users = spark.createDataFrame([(u, f"U{u}") for u in range(1, 6)], "id bigint, name string")
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(RP.dashboard(spark.createDataFrame(rows, schema), users, trend_which=which))
    parts = [rows[:50], rows[50:51], rows[51:120], rows[120:]]
    for order in (parts, parts[::-1]):
        states = [RP.dashboard_state(spark.createDataFrame(p, schema)) for p in order]
        state = states[0]
        for s in states[1:]:
            state = RP.merge_dashboard_state(state, s)
        assert key(RP.dashboard_from_state(state, users, trend_which=which)) == want
    with pytest.raises(ValueError):
        RP.dashboard_from_state(states[0], users, trend_k=30)
