"""The driver's test tables read as this library's tables.

Each function reads one parquet table of a scale-factor folder and renames,
casts or derives columns so it has the shape of one of our tables. All
derivations are per-row expressions (or an equi-join of turns), so the
work grows with the tables and nothing is sampled or cut.

| ours | from | rule |
| --- | --- | --- |
| sessions | events | id=event_id, category=event_type, overall_score=value, whole |
| answers | events | session = (user_id, day of ts), question_id = props.k, score = least(value, 100), answer text blank for type ``error`` (empty, or tabs and line breaks) |
| users / accounts | customer | id=c_custkey, emails built from c_name (accounts with case, blanks, tabs and line breaks) |
| questions | documents | id=doc_id, category=lang, question = first line, ideal = text, hint = source |
| text pairs | conversations | a user turn and the assistant turn right after it |
| vectors | embeddings | question = label; the smallest vec_id of a label is the ideal |
| question set | benchmark | question = first line of text, ideal_answer = text |
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "\n \t\u00a0"        # white space that is not blanks only
SESSION_DAY_FACTOR = 100_000  # session id = user_id * 100000 + days since 1970


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def score_of(value) -> F.Column:
    """A stand-in value as a per-cent score (capped at 100)."""
    return F.least(F.col(value), F.lit(100.0))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from events: one session per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("interview_date"),
        F.col("event_type").alias("category"),
        F.col("value").alias("overall_score"),
        F.lit(10).alias("total_questions"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers from events, sessions being (user, day)."""
    return answers_of(table(spark, sf_dir, "events"))


def answers_of(events: DataFrame) -> DataFrame:
    """Answers from event rows (a table or a stream)."""
    return events.select(
        F.col("event_id").alias("answer_id"),
        (F.col("user_id") * SESSION_DAY_FACTOR + F.unix_date(F.to_date("ts"))).alias("session_id"),
        "user_id",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("question_id"),
        F.when(F.col("event_type") != "error", F.col("props"))
        .when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit(BLANK)).alias("user_answer"),
        score_of("value").alias("score"),
        F.col("ts").alias("answered_at"),
        F.col("event_type").alias("category"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from customers, with normalised e-mails."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("name"),
        F.concat(F.lower("c_name"), F.lit("@mail.test")).alias("email"),
        "c_nationkey", "c_mktsegment", "c_acctbal",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts have their own id sequence and un-normalised emails."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_custkey") + 1_000_000).alias("id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.lit(BLANK)),
                 F.upper("c_name"), F.lit("@Mail.Test \r\n")).alias("email"),
        "c_custkey",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question bank from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("category"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("question_text"),
        F.col("text").alias("ideal_answer"),
        F.col("source").alias("hint"),
        F.lit("medium").alias("difficulty"),
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, user_text, ideal_text): a user turn and the assistant
    turn right after it (turn + 1). An equi-join on (conversation, turn), so
    a long conversation is spread by its turns, not gathered in one task."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ideal_text"))
    return u.join(a, ["conv_id", "turn"])


def turn_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as answers to the turn after them, and every assistant turn
    as bank; keys are (conv_id, turn)."""
    c = table(spark, sf_dir, "conversations")
    answers = c.where(F.col("role") == "user").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("question_turn"), F.col("text").alias("user_answer"))
    bank = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("ideal_answer"))
    return answers, bank


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON question set from benchmark items."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"),
                    F.col("text").alias("ideal_answer"), "item_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer and ideal vectors from embeddings (label = question)."""
    return table(spark, sf_dir, "embeddings")
