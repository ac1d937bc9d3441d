"""The README's end-to-end flow on own tables: write, read, score, update
sessions, report, dashboard, upsert and store the smoothed score."""

import datetime as dt

from quizlens.operators import rollup, score
from quizlens.plans import reports
from quizlens.session import scratch_path
from quizlens.sources import io


def test_readme_flow(spark):
    base = scratch_path(spark, "usage")
    T = dt.datetime(2024, 1, 1)
    io.write_table(spark.createDataFrame([(1, "hr", "Tell me about yourself", "I am a data engineer who builds pipelines", "be brief", "medium"),
                                          (2, "sql", "What is a join", "A join combines rows of two tables by a key", "keys", "medium")],
                   "id bigint, category string, question_text string, ideal_answer string, hint string, difficulty string"), f"{base}/questions", "questions")
    io.write_table(spark.createDataFrame([(1, 10, 5, 1, "I build data pipelines as an engineer", 0.0, T),
                                          (2, 10, 5, 2, "", 0.0, T + dt.timedelta(minutes=1)),
                                          (3, 11, 5, 2, "a join combines rows by key", 0.0, T + dt.timedelta(days=1))],
                   "answer_id bigint, session_id bigint, user_id bigint, question_id bigint, user_answer string, score double, answered_at timestamp_ntz"), f"{base}/user_answers", "user_answers")
    io.write_table(spark.createDataFrame([(10, 5, T, 0.0, "hr", 10), (11, 5, T + dt.timedelta(days=1), 0.0, "sql", 10)],
                   "id bigint, user_id bigint, interview_date timestamp_ntz, overall_score double, category string, total_questions int"), f"{base}/interview_session", "interview_session")
    io.write_table(spark.createDataFrame([(5, "Ann", "ann@x", T), (6, "Bo", "bo@x", T)], "id bigint, name string, email string, created_at timestamp_ntz"), f"{base}/users", "users")
    io.write_table(spark.createDataFrame([(1, 5, "hr", 40.0)], "performance_id bigint, user_id bigint, category string, average_score double"), f"{base}/performance", "performance")

    questions = io.read_table(spark, f"{base}/questions", "questions")
    answers = io.read_table(spark, f"{base}/user_answers", "user_answers")
    sessions = io.read_table(spark, f"{base}/interview_session", "interview_session")
    users = io.read_table(spark, f"{base}/users", "users")
    scored = answers.drop("score").join(score.score_answers(answers, questions).select("answer_id", "score"), "answer_id")
    closed = rollup.session_scores(rollup.dedupe_submissions(scored))
    sessions = rollup.update_session_scores(sessions, closed)
    report = reports.session_report(scored.join(
        sessions.select(sessions.id.alias("session_id"), "category"), "session_id"), questions)
    dashboard = reports.dashboard(sessions, users)
    batch = sessions.join(closed.select(closed.session_id.alias("id")), "id", "left_semi")
    rollup.upsert_stored_performance(spark, f"{base}/performance", batch)
    rep = {r.session_id: (r.score, r.grade, r.breakdown_status) for r in report.collect()}
    assert rep == {10: (53.5, "Needs Practice", ["Answered", "Skipped"]), 11: (82.5, "Excellent", ["Answered"])}
    dash = {r.user_id: (r.total_interviews, r.cat_names) for r in dashboard.collect()}
    assert dash == {5: (2, ["sql", "hr"]), 6: (0, [])}
    stored = {(r.user_id, r.category): (r.performance_id, r.average_score)
              for r in io.read_table(spark, f"{base}/performance", "performance").collect()}
    # (40 + 53.5) / 2 = 46.75 -> half even
    assert stored == {(5, "hr"): (1, 46.8), (5, "sql"): (2, 82.5)}
