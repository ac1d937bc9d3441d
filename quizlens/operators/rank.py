"""Per-user ``ORDER BY ... LIMIT n`` as windows.

``row_number() <= k`` directly over the window lets Spark plan a window group
limit: every map task keeps only the top k rows per key before the shuffle,
so a user with a third of all sessions still sends k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.functions import labels
from quizlens.functions.rounding import py_round1
from quizlens.session import small_side, written
from quizlens.sources.io import RANGE_ROWS, ranged


def latest_sessions(sessions: DataFrame, k: int = 10, user: str = "user_id",
                    ts: str = "interview_date", key: str = "id") -> DataFrame:
    """The k newest sessions of each user (ties: higher id first)."""
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col(key).desc())
    return sessions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def first_sessions(sessions: DataFrame, k: int = 20, user: str = "user_id",
                   ts: str = "interview_date", key: str = "id") -> DataFrame:
    """The k oldest sessions of each user (ties: lower id first)."""
    w = Window.partitionBy(user).orderBy(F.col(ts).asc(), F.col(key).asc())
    return sessions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def trend_series(sessions: DataFrame, k: int = 20, which: str = "oldest", user: str = "user_id",
                 ts: str = "interview_date", key: str = "id",
                 score: str = "overall_score") -> DataFrame:
    """Per user, two arrays in time order: date labels 'Mon dd' and
    Python-rounded scores of the first (``which='oldest'``, as the source
    does) or last (``'latest'``) k sessions. A null score stays null."""
    if which == "oldest":
        top = first_sessions(sessions, k, user, ts, key)
    elif which == "latest":
        top = latest_sessions(sessions, k, user, ts, key)
    else:
        raise ValueError("which must be 'oldest' or 'latest'")
    pts = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(key).alias("i"),
                                               labels.short_date(ts).alias("label"),
                                               py_round1(score).alias("score"))))
    return (top.groupBy(user).agg(pts.alias("_p"))
            .select(user, F.col("_p.label").alias("chart_labels"),
                    F.col("_p.score").alias("chart_scores")))


def first_questions(questions: DataFrame, k: int = 10, category: str = "category",
                    key: str = "id") -> DataFrame:
    """The first k questions of each category by id."""
    w = Window.partitionBy(category).orderBy(key)
    return questions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def grouped_positions(df: DataFrame, group: str, order_cols: list[str], bucket: Column,
                      out: str = "ordinal", bucket_rows: int = RANGE_ROWS) -> DataFrame:
    """1-based position of each row inside its group, the group size and a
    last-row flag, with all other columns kept.

    ``bucket`` must never fall where the order rises (say, the hour of the
    first order column). Rows are counted per (group, bucket); a prefix sum
    over a group's buckets gives each bucket's start, and rows are numbered
    inside (group, bucket) only, so a group with a third of all rows is spread
    over its buckets. A bucket of more than ``bucket_rows`` rows is cut into
    sorted ranges of about that many, which are buckets of their own. A null
    group is one group."""
    keyed = df.withColumn("_g", F.struct(F.col(group).alias("k"))).withColumn("_b", F.struct(bucket.alias("k")))
    per = lambda rows: rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(per(keyed), "buckets")
    hot = counts.where(F.col("_n") > bucket_rows).select("_g", "_b")
    if not hot.isEmpty():
        hot = small_side(hot)
        cut = ranged(keyed.join(hot, ["_g", "_b"], "left_semi"), ["_g", "_b", *order_cols], bucket_rows).drop("_pos")
        whole = keyed.join(hot, ["_g", "_b"], "left_anti").withColumn(
            "_range", F.lit(None).cast(cut.schema["_range"].dataType))
        keyed = whole.unionByName(cut).withColumn("_b", F.struct("_b", "_range")).drop("_range")
        counts = written(per(keyed), "buckets")
    of_group = Window.partitionBy("_g")
    before = of_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # a struct that holds a null key still equals itself, so null groups join
    starts = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(of_group).alias("n_in_group"))
    inside = Window.partitionBy("_g", "_b").orderBy(*order_cols)
    return (keyed.join(starts, ["_g", "_b"])
            .withColumn(out, F.col("_start") + F.row_number().over(inside))
            .withColumn("is_last", F.col(out) == F.col("n_in_group"))
            .drop("_g", "_b", "_start"))


def question_positions(answers: DataFrame, session: str = "session_id",
                       ts: str = "answered_at", key: str = "answer_id",
                       bucket_rows: int = RANGE_ROWS) -> DataFrame:
    """W4 + W5 + P14: 1-based ordinal of each answer in its session, the
    last-question flag, and the progress shown before it (index / n)."""
    p = grouped_positions(answers, session, [ts, key], F.date_trunc("hour", F.col(ts)), bucket_rows=bucket_rows)
    return (p.withColumnRenamed("n_in_group", "n_in_session")
            .withColumn("progress_pct", labels.progress_pct(F.col("ordinal") - 1, F.col("n_in_session"))))


def user_latest(sessions: DataFrame, user_id: int, k: int = 10, user: str = "user_id",
                ts: str = "interview_date", key: str = "id") -> DataFrame:
    """One user's k newest sessions: a pushed-down filter and a top-k
    (TakeOrderedAndProject), no window."""
    return (sessions.where(F.col(user) == F.lit(user_id))
            .orderBy(F.col(ts).desc(), F.col(key).desc()).limit(k))
