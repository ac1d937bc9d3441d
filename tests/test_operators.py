"""Operators on own rows: folds, chunking, upserts, dedupe, ranking, keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quizlens.operators import quality as Q
from quizlens.operators import rank as RK
from quizlens.operators import rollup as RU
from quizlens.operators import score as SC
from quizlens.sources import io as IO

T0 = dt.datetime(2024, 1, 1)


def _sessions(spark, rows):
    return spark.createDataFrame(
        [(i, u, T0 + dt.timedelta(hours=h), c, s, 10) for i, u, h, c, s in rows],
        "id bigint, user_id bigint, interview_date timestamp_ntz, category string, "
        "overall_score double, total_questions int")


def _py_fold(xs):
    s = xs[0]
    for x in xs[1:]:
        s = round((s + x) / 2, 1)
    return s


def test_fold_fixture(spark):
    s = _sessions(spark, [(1, 1, 0, "hr", 50.0), (2, 1, 1, "hr", 80.0), (3, 1, 2, "hr", 90.0)])
    r = RU.smoothed_scores(s, ["user_id", "category"], "interview_date", "id", "overall_score").first()
    assert r.smoothed_score == 77.5 and r.n == 3 and r.mean_score == 73.3


def test_fold_single_row_is_that_row(spark):
    s = _sessions(spark, [(1, 1, 0, "hr", 12.34)])
    assert RU.smoothed_scores(s, ["user_id"], "interview_date", "id", "overall_score").first().smoothed_score == 12.34


def test_chunked_fold_equals_python_for_hot_key(spark):
    rnd = random.Random(7)
    rows = []
    i = 0
    for u, n in [(1, 400), (2, 37), (3, 1), (4, 2)]:       # user 1 is the hot key
        for _ in range(n):
            i += 1
            rows.append((i, u, rnd.randint(0, 2000), "hr", round(rnd.uniform(-100, 100), 1)))
    s = _sessions(spark, rows)
    expect = {}
    for u in {r[1] for r in rows}:
        seq = sorted((r[2], r[0], r[4]) for r in rows if r[1] == u)
        expect[u] = _py_fold([x for _, _, x in seq])
    for chunk in (1_000_000, 50, 7, 1):
        got = {r.user_id: r.smoothed_score for r in RU.smoothed_scores(
            s, ["user_id"], "interview_date", "id", "overall_score", chunk_rows=chunk).collect()}
        assert got == expect, chunk


def test_upsert_continues_from_state(spark):
    rows = [(i, 1 + i % 3, i, "hr" if i % 2 else "sql", float((i * 37) % 100)) for i in range(1, 60)]
    s = _sessions(spark, rows)
    keys = ["user_id", "category"]
    early = s.where(F.col("id") < 30)
    late = s.where(F.col("id") >= 30)
    state = RU.smoothed_scores(early, keys, "interview_date", "id", "overall_score", out="average_score")
    up = {(r.user_id, r.category): r.average_score for r in
          RU.upsert_performance(state, late, keys, "interview_date", "id", "overall_score",
                                chunk_rows=3).collect()}
    full = {(r.user_id, r.category): r.smoothed_score for r in
            RU.smoothed_scores(s, keys, "interview_date", "id", "overall_score").collect()}
    assert up == full
    # keys only in the state keep their value
    only_old = state.where(F.col("category") == "hr").limit(1)
    again = RU.upsert_performance(only_old, s.limit(0), keys, "interview_date", "id", "overall_score")
    assert again.collect()[0].average_score == only_old.collect()[0].average_score


def test_user_without_sessions(spark):
    s = _sessions(spark, [(1, 1, 0, "hr", 50.0)])
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    got = {r.user_id: (r.total_interviews, r.avg_score, r.best_score)
           for r in RU.user_totals(s, users).collect()}
    assert got == {1: (1, 50.0, 50.0), 2: (0, 0.0, 0.0)}


def test_equal_dates_higher_id_first(spark):
    s = _sessions(spark, [(1, 1, 5, "hr", 10.0), (2, 1, 5, "hr", 20.0), (3, 1, 1, "hr", 30.0)])
    rows = RK.latest_sessions(s, 2).orderBy("rn").collect()
    assert [r.id for r in rows] == [2, 1]
    assert [r.id for r in RK.user_latest(s, 1, 2).collect()] == [2, 1]


def test_trend_oldest_and_latest(spark):
    s = _sessions(spark, [(i, 1, i, "hr", float(i)) for i in range(1, 26)])
    old = RK.trend_series(s, 20, "oldest").first()
    new = RK.trend_series(s, 20, "latest").first()
    assert old.chart_scores == [float(i) for i in range(1, 21)]
    assert new.chart_scores == [float(i) for i in range(6, 26)]
    assert old.chart_labels[0] == "Jan 01"


def _answers(spark, rows):
    return spark.createDataFrame(
        [(a, s, 1, q, txt, sc, T0 + dt.timedelta(minutes=m), "hr") for a, s, q, txt, sc, m in rows],
        "answer_id bigint, session_id bigint, user_id bigint, question_id bigint, user_answer string, "
        "score double, answered_at timestamp_ntz, category string")


def test_repeated_submission_counted_once_and_skip_switch(spark):
    a = _answers(spark, [(1, 9, 1, "x", 80.0, 0), (2, 9, 1, "x again", 0.0, 5),
                         (3, 9, 2, "", 40.0, 1), (4, 9, 3, "y", 60.0, 2)])
    d = RU.dedupe_submissions(a)
    assert sorted(r.answer_id for r in d.collect()) == [1, 3, 4]
    ex = RU.session_scores(d, "exclude").first()
    zero = RU.session_scores(d, "zero").first()
    assert (ex.session_score, ex.answered, ex.strengths, ex.weak_areas) == (70.0, 2, 1, 1)
    assert (zero.session_score, zero.answered) == (round((80 + 0 + 60) / 3, 1), 3)


def test_session_with_no_answers_scores_zero(spark):
    a = _answers(spark, [(1, 9, 1, "", 50.0, 0)])
    assert RU.session_scores(a).first().session_score == 0.0


def test_positions(spark):
    a = _answers(spark, [(1, 9, 1, "a", 1.0, 0), (2, 9, 2, "b", 1.0, 1), (3, 9, 3, "c", 1.0, 2)])
    rows = RK.question_positions(a).orderBy("ordinal").collect()
    assert [(r.ordinal, r.is_last, r.progress_pct) for r in rows] == [(1, False, 0), (2, False, 33), (3, True, 67)]


def test_insert_if_absent_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "id bigint, email string")
    batch = spark.createDataFrame([(10, "b@x"), (11, "c@x"), (12, "c@x")], "id bigint, email string")
    once = Q.insert_if_absent(target, batch, ["email"], ["id"])
    twice = Q.insert_if_absent(once, batch, ["email"], ["id"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted((r.id, r.email) for r in once.collect()) == [(1, "a@x"), (2, "b@x"), (11, "c@x")]


def test_audit_finds_planted_faults(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,)], "k bigint")
    child = spark.createDataFrame([(1,), (3,), (None,)], "fk bigint")
    res = {r.check_name: r.bad_rows for r in Q.audit([
        ("dup", Q.duplicate_rows(parent, ["k"])),
        ("orphan", Q.orphan_rows(child, "fk", parent, "k")),
    ]).collect()}
    assert res == {"dup": 2, "orphan": 1}


def test_registration_checks(spark):
    reg = spark.createDataFrame([(1, "Ann", "A@x "), (2, "", "b@x"), (3, "Cy", "a@x")],
                                "reg_id bigint, first_name string, email string")
    taken = spark.createDataFrame([("b@x",)], "email string")
    got = {r.reg_id: r.errors for r in Q.registration_checks(reg, taken).collect()}
    assert got == {1: [], 2: ["missing first name", "email already registered"],
                   3: ["duplicate email in batch"]}


def test_assign_ids_continue_over_partitions(spark):
    existing = spark.createDataFrame([(5,), (9,)], "id bigint")
    new = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"))
    got = IO.assign_ids(new, existing, "id", ["k"], out_col="new_id").orderBy("k").collect()
    assert [r.new_id for r in got] == list(range(10, 1010))
    empty = spark.createDataFrame([], "id bigint")
    assert IO.assign_ids(new.limit(3), empty, "id", ["k"], out_col="n").agg(F.min("n")).first()[0] == 1


def test_text_cosine_and_answer_scores(spark):
    pairs = spark.createDataFrame([(1, "Data is good", "good data"), (2, "", "x"), (3, "a b", "c d")],
                                  "k bigint, a string, b string")
    got = {r.k: r.score for r in SC.text_cosine(pairs, ["k"], "a", "b").collect()}
    assert got[2] == 0.0 and got[3] == 0.0 and 0 < got[1] <= 100.0
    bank = spark.createDataFrame([(7, "good data here")], "id bigint, ideal_answer string")
    ans = spark.createDataFrame([(1, 7, "good data here"), (2, 7, ""), (3, 8, "anything")],
                                "answer_id bigint, question_id bigint, user_answer string")
    s = {r.answer_id: r.score for r in SC.score_answers(ans, bank).collect()}
    assert s == {1: 100.0, 2: 0.0, 3: 0.0}


def test_strengths_plus_weak_is_answered(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    rows = E.queries()["a8_session_counts"](spark, SF_SMALL).collect()
    assert rows and all(r.strengths + r.weak_areas == r.answered for r in rows)


def test_stop_words_as_table_equal_list(spark):
    from quizlens.functions import text as TX
    from quizlens.operators.lemmas import remove_stop_words_table
    df = spark.createDataFrame([(1, ["the", "data", "is", "the", "data"]), (2, []), (3, ["a"])],
                               "k bigint, t array<string>")
    table = spark.createDataFrame([(w,) for w in TX.STOP_WORDS], "token string")
    got = {r.k: r.f for r in remove_stop_words_table(df, "k", "t", "f", table).collect()}
    want = {r.k: r.f for r in df.select("k", TX.remove_stop_words("t").alias("f")).collect()}
    assert got == want == {1: ["data", "data"], 2: [], 3: []}


def test_chunked_fold_with_a_burst_of_equal_timestamps(spark):
    rnd = random.Random(3)
    rows = [(i, 1, 0, "hr", round(rnd.uniform(0, 100), 1)) for i in range(1, 301)]  # one instant
    rows += [(1000 + i, 2, i, "hr", float(i)) for i in range(5)]
    s = _sessions(spark, rows)
    expect = {1: _py_fold([r[4] for r in sorted(rows[:300])]), 2: _py_fold([0.0, 1.0, 2.0, 3.0, 4.0])}
    got = {r.user_id: r.smoothed_score for r in RU.smoothed_scores(
        s, ["user_id"], "interview_date", "id", "overall_score", chunk_rows=20).collect()}
    assert got == expect


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 50),
                          st.integers(-1000, 1000).map(lambda v: v / 10)), min_size=20, max_size=120),
       st.integers(1, 15))
def test_sliced_fold_property(spark, rows, chunk):
    data = [(i, u, h, "hr", x) for i, (u, h, x) in enumerate(rows, start=1)]
    s = _sessions(spark, data)
    expect = {u: _py_fold([x for _, _, x in sorted((h, i, x) for i, uu, h, _, x in data if uu == u)])
              for u in {d[1] for d in data}}
    got = {r.user_id: r.smoothed_score for r in RU.smoothed_scores(
        s, ["user_id"], "interview_date", "id", "overall_score", chunk_rows=chunk).collect()}
    assert got == expect


def test_dashboard_switches(spark):
    from quizlens.plans.reports import dashboard
    rows = [(i, 1, i, "hr", 0.0 if i % 2 else 90.0) for i in range(1, 26)]
    s = _sessions(spark, rows)
    users = spark.createDataFrame([(1, "Ann")], "id bigint, name string")
    all_ = dashboard(s, users).first()
    done = dashboard(s, users, count_abandoned=False).first()
    latest = dashboard(s, users, trend_which="latest").first()
    assert (all_.total_interviews, all_.avg_score) == (25, round(12 * 90.0 / 25, 1))
    assert (done.total_interviews, done.avg_score, done.best_score) == (12, 90.0, 90.0)
    assert len(all_.chart_scores) == 20 and all_.chart_scores[0] == 0.0
    assert latest.chart_scores[-1] == 0.0 and latest.chart_labels[0] == "Jan 01"
    assert all_.recent_scores[0] == 0.0 and all_.recent_bands[:2] == ["red", "green"]


def test_ids_of_a_wide_table_are_dense_and_unique(spark):
    """Payload columns, many rows, several scan partitions, odd bounds."""
    new = spark.range(0, 120_000, 1, 11).select(
        ((F.col("id") * 7919) % 120_000).alias("k"), F.repeat(F.lit("p"), 40).alias("payload"),
        F.concat(F.lit("n"), (F.col("id") % 97).cast("string")).alias("name"))
    existing = spark.createDataFrame([(5,)], "id bigint")
    for order in (["k"], ["name", "k"]):
        got = IO.assign_ids(new, existing, "id", order, out_col="n")
        assert got.columns == ["k", "payload", "name", "n"]
        r = got.agg(F.count("n").alias("c"), F.countDistinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("z")).first()
        assert tuple(r) == (120_000, 120_000, 6, 120_005)
        rows = got.orderBy("n").select(*order).limit(500).collect()
        assert [tuple(x) for x in rows] == sorted(tuple(x) for x in rows)


def test_ids_by_every_kind_of_column(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, -1.5, 0.0, 2.5]), T0 + dt.timedelta(hours=rnd.randrange(50)),
             rnd.choice(["", "a", "ab", "é", "zzzzzzzzz1", "zzzzzzzzz2", None]), rnd.random() < .5) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, x double, t timestamp_ntz, s string, b boolean").repartition(5)
    for col in ("x", "t", "s", "b"):
        want = [r.i for r in df.orderBy(col, "i").collect()]
        assert [r.i for r in IO.global_rank(df, [col, "i"], ranges=8).orderBy("_grank").collect()] == want


def test_positions_of_long_sessions_with_payload(spark):
    n = 100_000
    a = spark.range(0, n, 1, 9).select(
        F.col("id").alias("answer_id"), F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id") % 500).cast("bigint").alias("session_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % n).cast("timestamp_ntz").alias("answered_at"),
        F.repeat(F.lit("p"), 30).alias("payload"))
    got = RK.question_positions(a)
    per = got.groupBy("session_id").agg(
        F.max("ordinal").alias("top"), F.countDistinct("ordinal").alias("d"), F.count("ordinal").alias("c"),
        F.count_if("is_last").alias("last"), F.max("n_in_session").alias("n"))
    assert per.where("top != c OR d != c OR last != 1 OR n != c").count() == 0 and "payload" in got.columns


def test_null_scores_change_nothing_and_null_keys_stay(spark):
    xs = [None, 12.34, None, 80.0, None, 3.3]
    rows = [(i, u, i, "hr", x) for u in (1, None) for i, x in enumerate(xs, start=1)]
    rows += [(i, 2, i, "hr", None) for i in range(1, 5)]
    for chunk in (1_000_000, 3, 2, 1):
        got = {r.user_id: (r.smoothed_score, r.n, r.mean_score) for r in RU.smoothed_scores(
            _sessions(spark, rows), ["user_id"], "interview_date", "id", "overall_score", chunk_rows=chunk).collect()}
        want = _py_fold([12.34, 80.0, 3.3])
        assert got == {1: (want, 6, 31.9), None: (want, 6, 31.9), 2: (None, 4, None)}, chunk


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-10 ** 9, 10 ** 9).map(lambda v: v / 4)), min_size=5, max_size=200),
       st.integers(1, 40))
def test_sliced_fold_of_wide_ranges_and_nulls(spark, xs, chunk):
    rows = [(i, 1, i, "hr", x) for i, x in enumerate(xs, start=1)]
    scored = [x for x in xs if x is not None]
    want = _py_fold(scored) if scored else None
    for c in (chunk, len(xs) + 1, 70):
        got = RU.smoothed_scores(_sessions(spark, rows), ["user_id"], "interview_date", "id", "overall_score", chunk_rows=c).first()
        assert (got.smoothed_score, got.n) == (want, len(xs))


def test_answers_without_a_question_are_each_kept(spark):
    a = _answers(spark, [(i, 9, None, "x", 10.0 * i, i) for i in range(1, 6)] + [(6, 9, 1, "y", 1.0, 0), (7, 9, 1, "y", 1.0, 1)])
    assert sorted(r.answer_id for r in RU.dedupe_submissions(a).collect()) == [1, 2, 3, 4, 5, 6]


def test_lemmas_by_table_and_suffix_rules(spark):
    from quizlens.plans.reports import clean_question_set
    qs = spark.createDataFrame([("a", "Skills and classes help companies"), ("b", "one skill, a class, this company helps children"),
                                ("c", None)], "question string, ideal_answer string")
    got = {r.question: r.final_text for r in clean_question_set(qs).collect()}
    assert got == {"a": "skill class help company", "b": "one skill class company help child", "c": ""}


@pytest.mark.parametrize("spread", [1, 3, 10 ** 12])
def test_audit_counts_equal_plain_counts(spark, spread):
    """Dense ids by bitmaps, sparse ones by joins: negative, repeated, missing
    and null ids."""
    from collections import Counter
    from quizlens.operators import quality as Q
    rnd = random.Random(spread)
    ids = [rnd.randrange(-70_000, 70_000) * spread for _ in range(3000)]
    child = [rnd.choice(ids) if rnd.random() < .98 else rnd.randrange(80_000) * spread for _ in range(9000)] + [None] * 5
    parent = [None if i % 500 == 0 else x for i, x in enumerate(ids)]
    p, c = (spark.createDataFrame([(x,) for x in xs], "k bigint").repartition(4) for xs in (parent, child))
    n = Counter(parent)
    assert Q.duplicate_rows(p, ["k"]).first()[0] == sum(v for v in n.values() if v > 1)
    assert Q.orphan_rows(c, "k", p, "k").first()[0] == sum(x is not None and x not in n for x in child)
    assert Q.orphan_rows(p, "k", p, "k").first()[0] == 0 == Q.orphan_rows(c.limit(0), "k", p, "k").first()[0]
    assert Q.duplicate_rows(p.where("k IS NOT NULL").distinct(), ["k"]).first()[0] == 0


def test_a_session_without_question_ids_is_reported_whole(spark):
    from quizlens.plans import reports as RP
    n = 200_000
    a = spark.range(0, n, 1, 8).select(
        F.col("id").alias("answer_id"), F.lit(1).cast("bigint").alias("session_id"), F.lit(5).cast("bigint").alias("user_id"),
        F.lit(None).cast("bigint").alias("question_id"), F.lit("said").alias("user_answer"), (F.col("id") % 101).cast("double").alias("score"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % n).cast("timestamp_ntz").alias("answered_at"), F.lit("hr").alias("category"))
    bank = spark.createDataFrame([(1, "Q")], "id bigint, question_text string")
    r = RP.session_report(a, bank).selectExpr(
        "total_questions", "category", "size(breakdown_scores) AS n", "breakdown_ordinals[199999] AS last",
        "slice(breakdown_scores, 1, 3) AS head").first()
    first = sorted(range(n), key=lambda i: (i * 7919) % n)[:3]
    assert (r.total_questions, r.category, r.n, r["last"], r.head) == (n, "hr", n, n, [float(i % 101) for i in first])


def test_hashed_vectors_count_each_token_in_one_expression(spark):
    """One pass over the tokens, not one per place; null lists and tokens count nothing."""
    import hashlib
    from quizlens.operators import score as SC
    lists = [["a", "b", "a"], [], None, ["x", None, "\u00e9"], ["a"]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, t array<string>").repartition(2)
    out = SC.hashed_term_vectors(df, "t", dim=8)
    want = {}
    for k, ts in enumerate(lists):
        want[k] = [0.0] * 8
        for w in ts or []:
            if w is not None:
                want[k][int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1.0
    assert {r.k: r.embedding for r in out.collect()} == want
    assert "array_remove" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_bank_is_cut_to_the_questions_of_a_batch(spark, monkeypatch):
    from quizlens.operators import score as SC
    bank = spark.createDataFrame([(i, f"word{i} and some more of it") for i in range(200)], "id int, ideal_answer string")
    answers = spark.createDataFrame([(1, 3, "word3 and more"), (2, 999, "word3")], "answer_id int, question_id int, user_answer string")
    counts, norms = SC.bank_term_counts(bank, mark=False)
    want = sorted(map(tuple, SC.score_answers(answers, bank).collect()))
    monkeypatch.setattr(SC, "BROADCAST_MAX_BYTES", 1000)
    own, own_norms = SC.bank_for(answers, counts, norms)
    assert {r.question_id for r in own.collect()} == {r.question_id for r in own_norms.collect()} == {3}
    assert sorted(map(tuple, SC.score_against_counts(answers, own, own_norms).collect())) == want


def test_cleaning_shuffles_no_token_lists(spark):
    import re
    from quizlens.plans import reports as RP
    qs = spark.createDataFrame([(1, "Wolves and a wolf, the children"), (2, None), (3, "")], "id int, ideal_answer string")
    out = RP.clean_question_set(qs)
    assert out.columns == ["id", "ideal_answer", "clean_answer", "tokens", "filtered_tokens", "lemmatized", "final_text"]
    rows = {r.id: r for r in out.collect()}
    assert rows[1].final_text == "wolf wolf child" and rows[2].final_text == rows[3].final_text == ""
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter"):].splitlines()[1]
    assert re.search(r"Project \[_row#\d+L?, id#\d+L?, ideal_answer#\d+\]$", left)
