"""A key holding more than a third of all rows: results against brute force,
and the plan shapes that keep the hot key off a single task."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from quizlens.operators import rank as RK
from quizlens.plans.reports import dashboard

T0 = dt.datetime(2024, 1, 1)
CATS = ["hr", "python", "sql", "ml", "ds"]


def _fixture(spark):
    rnd = random.Random(11)
    rows, i = [], 0
    for u, n in [(1, 1500)] + [(u, rnd.randint(0, 40)) for u in range(2, 60)]:
        for _ in range(n):
            i += 1
            rows.append((i, u, T0 + dt.timedelta(minutes=rnd.randint(0, 200000)),
                         rnd.choice(CATS), round(rnd.uniform(0, 100), 1), 10))
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, interview_date timestamp_ntz, "
                                     "category string, overall_score double, total_questions int")
    users = spark.createDataFrame([(u, f"user{u}") for u in range(1, 62)], "id bigint, name string")
    return rows, df.repartition(8), users


def _half_up(x):
    return float(Decimal(str(x)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def test_dashboard_with_hot_user_equals_brute_force(spark):
    rows, sessions, users = _fixture(spark)
    assert sum(1 for r in rows if r[1] == 1) * 3 > len(rows)
    got = {r.user_id: r for r in dashboard(sessions, users).collect()}
    assert len(got) == 61
    for u in range(1, 62):
        mine = [r for r in rows if r[1] == u]
        g = got[u]
        if not mine:
            assert (g.total_interviews, g.avg_score, g.best_score, g.recent_scores) == (0, 0.0, 0.0, [])
            continue
        scores = [r[4] for r in mine]
        assert g.total_interviews == len(mine)
        exact = Fraction(sum(Decimal(str(s)) for s in scores)) / len(scores)
        assert g.avg_score == round(float(exact), 1)  # the exact mean, Python-rounded
        assert g.best_score == round(max(scores), 1)
        cats = {}
        for r in mine:
            cats.setdefault(r[3], []).append(Decimal(str(r[4])))
        avgs = {c: _half_up(sum(v) / len(v)) for c, v in cats.items()}
        order = sorted(avgs, key=lambda c: (-avgs[c], c))
        assert g.cat_names == order and g.cat_avgs == [avgs[c] for c in order]
        newest = sorted(mine, key=lambda r: (r[2], r[0]), reverse=True)[:10]
        assert g.recent_scores == [r[4] for r in newest]
        oldest = sorted(mine, key=lambda r: (r[2], r[0]))[:20]
        assert g.chart_scores == [round(r[4], 1) for r in oldest]
        assert g.chart_labels == [r[2].strftime("%b %d") for r in oldest]


def test_top_k_limited_before_and_after_shuffle(spark):
    _, sessions, _ = _fixture(spark)
    plan = RK.latest_sessions(sessions, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_positions_of_hot_session_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(a, 1 if a % 3 else rnd.randint(2, 40), T0 + dt.timedelta(seconds=rnd.randint(0, 10 ** 6)))
            for a in range(1, 3001)]
    df = spark.createDataFrame(rows, "answer_id bigint, session_id bigint, answered_at timestamp_ntz")
    got = {r.answer_id: (r.ordinal, r.is_last, r.n_in_session) for r in
           RK.question_positions(df.repartition(8)).collect()}
    want = {}
    for s in {r[1] for r in rows}:
        seq = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(seq, start=1):
            want[r[0]] = (i, i == len(seq), len(seq))
    assert got == want
