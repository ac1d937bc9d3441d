"""Fixed schemas of the six tables and the two inputs of the cleaning job.
Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, I = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()
TS = T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


ACCOUNTS = _st(("id", L, False), ("first_name", S, True), ("last_name", S, True),
               ("email", S, False), ("created_at", TS, True))
USERS = _st(("id", L, False), ("name", S, True), ("email", S, False), ("created_at", TS, True))
QUESTIONS = _st(("id", L, False), ("category", S, True), ("question_text", S, True),
                ("ideal_answer", S, True), ("hint", S, True), ("difficulty", S, True))
SESSIONS = _st(("id", L, False), ("user_id", L, True), ("interview_date", TS, True),
               ("overall_score", D, True), ("category", S, True), ("total_questions", I, True))
PERFORMANCE = _st(("performance_id", L, False), ("user_id", L, True), ("category", S, True),
                  ("average_score", D, True))
ANSWERS = _st(("answer_id", L, False), ("session_id", L, True), ("user_id", L, True),
              ("question_id", L, True), ("user_answer", S, True), ("score", D, True),
              ("answered_at", TS, True))

QUESTION_SET = _st(("question", S, True), ("ideal_answer", S, True))
SEED_ITEM = T.StructType([T.StructField("question", S), T.StructField("ideal", S),
                          T.StructField("hint", S)])
SEED_BANK = T.StructType([T.StructField("bank", T.MapType(S, T.ArrayType(SEED_ITEM)))])
VECTORS = _st(("key", L, False), ("embedding", T.ArrayType(T.FloatType()), True))

TABLES = {
    "accounts": ACCOUNTS, "users": USERS, "questions": QUESTIONS,
    "interview_session": SESSIONS, "performance": PERFORMANCE, "user_answers": ANSWERS,
}

# Column defaults applied when rows are appended without them.
DEFAULTS = {
    "interview_session": {"overall_score": 0.0, "total_questions": 10},
    "user_answers": {"score": 0.0},
    "questions": {"difficulty": "medium"},
}
