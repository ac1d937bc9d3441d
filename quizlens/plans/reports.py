"""Reports for all users or sessions in one job (the flagship queries).

The source answers one user per request with four queries; here each report
is one plan whose shuffles are keyed by the report's own key only. Arrays in
the output are bounded (10 recent, 20 trend points, the answers of a session,
the categories of a user).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlens.functions import labels as LB
from quizlens.functions import text as TX
from quizlens.functions.rounding import UNITS, py_round1
from quizlens.operators import lemmas as LM
from quizlens.operators import rank, rollup
from quizlens.operators.score import join_bank
from quizlens.session import spread, written


# --- R2 -------------------------------------------------------------------------

def dashboard(sessions: DataFrame, users: DataFrame, recent_k: int = 10, trend_k: int = 20,
              trend_which: str = "oldest", count_abandoned: bool = True,
              per_session: int = LB.QUESTIONS_PER_SESSION) -> DataFrame:
    """R2: one row per user: totals, average, best, categories tried, the
    category list (best first), trend arrays and the recent sessions.

    Plan: one partial aggregate per (user, category) feeds both the totals
    and the category list; the recent and trend lists are window group
    limits (top-k per map task before the shuffle). Every branch ends
    partitioned by user, so joining them adds no exchange. Users without a
    session get 0, 0.0, 0.0 and empty lists.

    ``count_abandoned=False`` leaves sessions still at score 0.0 out (they
    were opened and never finished).
    """
    if not count_abandoned:
        sessions = sessions.where(F.col("overall_score") != 0.0)
    return _dashboard(rollup.category_parts(sessions), sessions, sessions, users, recent_k, trend_k, trend_which, per_session)


class DashboardState(NamedTuple):
    """What the dashboard needs of all sessions so far: ``parts``, a row per
    (user, category) with counts, exact sum and best, and ``edges``, each
    user's first and last ``k`` sessions (marked in ``edge``). Both are plain
    tables of a size that does not grow with a user's history."""
    parts: DataFrame
    edges: DataFrame
    k: int


def dashboard_state(sessions: DataFrame, k: int = 20, count_abandoned: bool = True) -> DashboardState:
    """The state of a table of sessions, by a partial aggregate and two window
    group limits."""
    if not count_abandoned:
        sessions = sessions.where(F.col("overall_score") != 0.0)
    return DashboardState(rollup.category_parts(sessions), _edges(sessions, sessions, k), k)


def _edges(firsts: DataFrame, lasts: DataFrame, k: int) -> DataFrame:
    first, last = rank.first_sessions(firsts, k).drop("rn"), rank.latest_sessions(lasts, k).drop("rn")
    return first.withColumn("edge", F.lit("first")).unionByName(last.withColumn("edge", F.lit("last")))


def merge_dashboard_state(state: DashboardState, batch: DashboardState) -> DashboardState:
    """The state of the sessions of both, which share no session: sums of sums
    and the edges of the edges, so history is not read again. In any order of
    batches the same."""
    if state.k != batch.k:
        raise ValueError("states of different k")
    parts = state.parts.unionByName(batch.parts).groupBy("user_id", "category").agg(
        F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.sum("unit_sum").alias("unit_sum"),
        F.max("best").alias("best"))
    both = state.edges.unionByName(batch.edges)
    side = lambda edge: both.where(F.col("edge") == edge).drop("edge")
    return DashboardState(parts, _edges(side("first"), side("last"), state.k), state.k)


def dashboard_from_state(state: DashboardState, users: DataFrame, recent_k: int = 10, trend_k: int = 20,
                         trend_which: str = "oldest", per_session: int = LB.QUESTIONS_PER_SESSION) -> DataFrame:
    """R2 from the state: what ``dashboard`` gives for all its sessions."""
    if max(recent_k, trend_k) > state.k:
        raise ValueError(f"the state keeps {state.k} sessions")
    side = lambda edge: state.edges.where(F.col("edge") == edge).drop("edge")
    trend_rows = side("first" if trend_which == "oldest" else "last")
    return _dashboard(state.parts, trend_rows, side("last"), users, recent_k, trend_k, trend_which, per_session)


def _dashboard(parts: DataFrame, trend_rows: DataFrame, recent_rows: DataFrame, users: DataFrame, recent_k: int,
               trend_k: int, trend_which: str, per_session: int) -> DataFrame:
    s, n = F.col("unit_sum"), F.col("n_scored")
    cat_avg = F.when(n > 0, F.signum(s) * F.floor((F.abs(s) + n * 500) / (n * 1000)) / 10.0)
    parts = parts.withColumn("avg", cat_avg)
    w = Window.partitionBy("user_id").orderBy(F.col("avg").desc_nulls_first(), F.col("category"))
    ranked = parts.withColumn("rank", F.row_number().over(w))
    cats = F.sort_array(F.collect_list(F.struct("rank", "category", "avg",
                                                LB.band3("avg").alias("band"))))
    per_user = ranked.groupBy("user_id").agg(
        F.sum("n").alias("total_interviews"),
        py_round1(F.sum("unit_sum") / (F.sum("n_scored") * float(UNITS))).alias("avg_score"),
        py_round1(F.max("best")).alias("best_score"),
        F.count(F.lit(1)).alias("categories_tried"),
        cats.alias("_c"),
    ).select("user_id", "total_interviews", "avg_score", "best_score", "categories_tried",
             F.col("_c.category").alias("cat_names"), F.col("_c.avg").alias("cat_avgs"),
             F.col("_c.band").alias("cat_bands"))

    trend = rank.trend_series(trend_rows, trend_k, trend_which)

    rec = rank.latest_sessions(recent_rows, recent_k)
    items = F.sort_array(F.collect_list(F.struct(
        "rn", LB.category_title("category").alias("title"),
        LB.long_date("interview_date").alias("date"),
        F.col("overall_score").alias("score"), LB.band4("overall_score").alias("band"),
        LB.completion("total_questions", F.lit(per_session)).alias("questions"))))
    recent = rec.groupBy("user_id").agg(items.alias("_r")).select(
        "user_id", F.col("_r.title").alias("recent_titles"), F.col("_r.date").alias("recent_dates"),
        F.col("_r.score").alias("recent_scores"), F.col("_r.band").alias("recent_bands"),
        F.col("_r.questions").alias("recent_questions"))

    u = users.select(F.col("id").alias("user_id"), LB.display_name("name").alias("display_name"),
                     LB.initial("name").alias("initial"))
    out = u.join(per_user, "user_id", "left").join(trend, "user_id", "left") \
           .join(recent, "user_id", "left")
    empty_s = F.array().cast("array<string>")
    empty_d = F.array().cast("array<double>")
    return out.select(
        "user_id", "display_name", "initial",
        F.coalesce("total_interviews", F.lit(0)).cast("bigint").alias("total_interviews"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        F.coalesce("categories_tried", F.lit(0)).cast("bigint").alias("categories_tried"),
        F.coalesce("cat_names", empty_s).alias("cat_names"),
        F.coalesce("cat_avgs", empty_d).alias("cat_avgs"),
        F.coalesce("cat_bands", empty_s).alias("cat_bands"),
        F.coalesce("chart_labels", empty_s).alias("chart_labels"),
        F.coalesce("chart_scores", empty_d).alias("chart_scores"),
        F.coalesce("recent_titles", empty_s).alias("recent_titles"),
        F.coalesce("recent_dates", empty_s).alias("recent_dates"),
        F.coalesce("recent_scores", empty_d).alias("recent_scores"),
        F.coalesce("recent_bands", empty_s).alias("recent_bands"),
        F.coalesce("recent_questions", empty_s).alias("recent_questions"),
    )


# --- R1 -------------------------------------------------------------------------

def session_report(answers: DataFrame, bank: DataFrame, skipped: str = "exclude") -> DataFrame:
    """One row per session: score, grade, badge, label, answers counted,
    strengths and weak areas (question previews and scores), and the ordered
    breakdown: ordinal, question, score, answer preview, status and band of
    every answer.

    Three shuffles: the dedupe by (session, question), whose group limit keeps
    one row per key and task before it; sums and sorted breakdowns by (session,
    hour), since answers without a question make a session as long as they
    like; and the report by session, which puts its hours one after another.
    The bank's question texts are joined by a broadcast checked in bytes.
    """
    a = rollup.dedupe_submissions(answers)
    a = join_bank(a, bank.select("id", "question_text"), on="question_id", bank_key="id")
    blank = TX.is_blank("user_answer")
    if skipped == "exclude":
        counted = F.when(~blank, F.col("score"))
    elif skipped == "zero":
        counted = F.when(blank, F.lit(0.0)).otherwise(F.col("score"))
    else:
        raise ValueError("skipped must be 'exclude' or 'zero'")
    a = a.withColumn("_s", counted)
    item = F.struct(
        "answered_at", "answer_id", F.col("_s").alias("score"),
        F.coalesce("question_text", F.lit("")).alias("question"),
        LB.preview(F.col("user_answer"), LB.ANSWER_PREVIEW).alias("a"),
        LB.answer_status("user_answer").alias("status"),
        LB.band4(F.coalesce(F.col("_s"), F.lit(0.0))).alias("band"), "category")
    hours = a.groupBy("session_id", F.date_trunc("hour", "answered_at").alias("_hour")).agg(
        F.min("user_id").alias("user_id"),
        F.sum(F.round(F.col("_s") * float(UNITS)).cast("bigint")).alias("_units"), F.count("_s").alias("_scored"),
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(item)).alias("_items"))
    g = hours.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.coalesce(py_round1(F.sum("_units") / (F.sum("_scored") * float(UNITS))), F.lit(0.0)).alias("score"),
        F.sum("_scored").alias("answered"), F.sum("_n").alias("total_questions"),
        F.flatten(F.sort_array(F.collect_list(F.struct("_hour", "_items")))["_items"]).alias("_items")) \
        .withColumn("category", F.col("_items")[0]["category"])
    counted_items = F.filter("_items", lambda x: x["score"].isNotNull())
    strong = F.filter(counted_items, lambda x: LB.is_strength(x["score"]))
    weak = F.filter(counted_items, lambda x: ~LB.is_strength(x["score"]))
    previews = lambda items: F.transform(items, lambda x: LB.preview(x["question"], LB.QUESTION_PREVIEW))
    return g.select(
        "session_id", "user_id", "category", "score",
        LB.grade("score").alias("grade"), LB.grade_class("score").alias("grade_class"),
        LB.badge("score").alias("badge"), LB.category_label("category").alias("label"),
        "answered", "total_questions",
        F.size(strong).alias("n_strengths"), F.size(weak).alias("n_weak"),
        previews(strong).alias("strength_questions"), strong["score"].alias("strength_scores"),
        previews(weak).alias("weak_questions"), weak["score"].alias("weak_scores"),
        F.transform("_items", lambda x, i: i + 1).alias("breakdown_ordinals"),
        F.col("_items.question").alias("breakdown_questions"),
        F.col("_items.score").alias("breakdown_scores"),
        F.col("_items.status").alias("breakdown_status"),
        F.col("_items.band").alias("breakdown_bands"),
        F.col("_items.a").alias("breakdown_answers"),
    )


# --- R3 -------------------------------------------------------------------------

def irregular_lemmas(spark: SparkSession) -> DataFrame:
    """The fixed irregular nouns as a lemma table."""
    return spark.createDataFrame(sorted(TX.IRREGULAR_NOUNS.items()), "token string, lemma string")


def clean_question_set(qs: DataFrame, text_col: str = "ideal_answer",
                       stop_words: list[str] | None = None, lemmas: DataFrame | None = None,
                       lexicon: DataFrame | str | None = "corpus") -> DataFrame:
    """The whole cleaning notebook: clean, tokens, filtered tokens, lemmas
    (T4: the lemma table, then the noun suffix rules checked against a
    lexicon, by default the tokens of the set itself), final text.

    The rows and their filtered tokens are one narrow native stage, written
    once under a row number, which the dictionary reads back. Only the rows as
    given are joined to their lemmas; what follows from a row's text alone is
    taken from it again after the join, so that no text crosses the network
    or is written in several forms."""
    def cleaned(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("clean_answer", TX.clean_text(text_col))
                .withColumn("tokens", TX.tokenize("clean_answer"))
                .withColumn("filtered_tokens", TX.remove_stop_words("tokens", stop_words)))

    rows = cleaned(spread(qs)).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows.select(*qs.columns, "filtered_tokens", "_row"), "cleaned")
    table = irregular_lemmas(qs.sparkSession) if lemmas is None else lemmas
    found = LM.lemmatize_rows(rows, "_row", "filtered_tokens", "lemmatized", lemmas=table, lexicon=lexicon,
                              is_written=True, carried=qs.columns, again=cleaned)
    return found.withColumn("final_text", TX.join_tokens("lemmatized")).drop("_row")


# --- R4 -------------------------------------------------------------------------

def session_rows(answers: DataFrame, skipped: str = "exclude") -> DataFrame:
    """Answers -> one row per closed session: user, category of its first
    answer, start time, score (A4) and counts (A8)."""
    a = rollup.dedupe_submissions(answers)
    blank = TX.is_blank("user_answer")
    s = F.when(~blank, F.col("score")) if skipped == "exclude" else \
        F.when(blank, F.lit(0.0)).otherwise(F.col("score"))
    a = a.withColumn("_s", s)
    return a.groupBy("session_id").agg(
        F.first("user_id").alias("user_id"),
        F.min_by("category", F.struct("answered_at", "answer_id")).alias("category"),
        F.min("answered_at").alias("interview_date"),
        F.coalesce(py_round1(F.sum(F.round(F.col("_s") * float(UNITS)).cast("bigint"))
                             / (F.count("_s") * float(UNITS))), F.lit(0.0)).alias("overall_score"),
        F.count("_s").alias("answered"),
        F.count_if(F.col("_s") >= LB.STRENGTH_CUT).alias("strengths"),
        F.count_if(F.col("_s") < LB.STRENGTH_CUT).alias("weak_areas"))


def close_sessions(answers: DataFrame, state: DataFrame | None = None,
                   skipped: str = "exclude", chunk_rows: int = rollup.CHUNK_ROWS) -> DataFrame:
    """Submissions -> sessions -> performance in one batch: dedupe,
    session scores, then the smoothed per-(user, category) score continued
    from ``state`` (user_id, category, average_score) when given."""
    # Session rows are two shuffles deep and read twice (key statistics and
    # the fold): written once to the shared scratch folder.
    sess = written(session_rows(answers, skipped), "sessions")
    keys = ["user_id", "category"]
    if state is None:
        res = rollup.smoothed_scores(sess, keys, "interview_date", "session_id", "overall_score",
                                     chunk_rows=chunk_rows, out="average_score")
        return res.select(*keys, "average_score", F.col("n").alias("sessions"), "mean_score")
    return rollup.upsert_performance(state, sess, keys, "interview_date", "session_id",
                                     "overall_score", chunk_rows=chunk_rows)
