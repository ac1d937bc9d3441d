"""Roll-ups: user totals, category means, session scores, the smoothed
per-category score, and the score updates (upsert) built on them.

Every aggregate here is decomposable (count, integer sums, max) except the
smoothed score, whose fold ``s = round1((s + x) / 2)`` is order dependent and
not associative. That one is computed in bounded chunks (see
``smoothed_scores``) so a key holding a third of all rows is still split over
many tasks and never collected into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlens.functions import labels
from quizlens.functions.text import is_blank
from quizlens.functions.rounding import exact_mean, py_round1, sql_round1_mean, units
from quizlens.session import small_side, written
from quizlens.sources import io
from quizlens.sources.io import assign_ids

# Rows of one key folded in one task. A key with more rows is cut into
# ordered range slices of about this many rows.
CHUNK_ROWS = 1_000_000
# Scores of a slice that are kept as they are before its map begins: 64
# halvings bring any two states within a step of the 0.1 grid.
PREFIX = 64


# --- A1, A2, A3 ----------------------------------------------------------------

def category_parts(sessions: DataFrame, user: str = "user_id", category: str = "category",
                   score: str = "overall_score") -> DataFrame:
    """Per (user, category): count, exact unit sum, max. Partially aggregated
    on the map side, so hot users cost nothing extra."""
    return sessions.groupBy(user, category).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(score).alias("n_scored"),
        F.sum(units(score)).alias("unit_sum"),
        F.max(score).alias("best"),
    )


def user_totals(sessions: DataFrame, users: DataFrame | None = None, user: str = "user_id",
                score: str = "overall_score", users_key: str = "id") -> DataFrame:
    """A1: sessions, average and best per user, Python-rounded; 0 when the
    user has none (needs ``users`` to list those)."""
    t = sessions.groupBy(user).agg(
        F.count(F.lit(1)).alias("total_interviews"),
        py_round1(exact_mean(score)).alias("avg_score"),
        py_round1(F.max(score)).alias("best_score"),
    )
    if users is None:
        return t.select(user, "total_interviews",
                        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
                        F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
    u = users.select(F.col(users_key).alias(user))
    return u.join(t, user, "left").select(
        user,
        F.coalesce("total_interviews", F.lit(0)).cast("bigint").alias("total_interviews"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
    )


def category_averages(sessions: DataFrame, user: str = "user_id", category: str = "category",
                      score: str = "overall_score") -> DataFrame:
    """A2 + W7: per (user, category) the SQL-rounded mean, and the rank of the
    category for its user (best first, null means first as in the source
    database, then by name)."""
    avg = sessions.groupBy(user, category).agg(sql_round1_mean(score).alias("avg"))
    w = Window.partitionBy(user).orderBy(F.col("avg").desc_nulls_first(), F.col(category))
    return avg.withColumn("rank", F.row_number().over(w))


def categories_tried(sessions: DataFrame, user: str = "user_id",
                     category: str = "category") -> DataFrame:
    """A3: distinct categories per user."""
    return (sessions.select(user, category).distinct()
            .groupBy(user).agg(F.count(F.lit(1)).alias("categories_tried")))


# --- A4, A8, dedupe --------------------------------------------------------------

def dedupe_submissions(answers: DataFrame, session: str = "session_id",
                       question: str = "question_id", ts: str = "answered_at",
                       key: str = "answer_id") -> DataFrame:
    """Keep the first submission (by time, then id) of each (session,
    question); answers without a question id are each kept. ``row_number() =
    1`` plans a window group limit, so a flood of re-posts of one key
    collapses on the map side instead of in one task."""
    own = F.when(F.col(question).isNull(), F.col(key))
    w = Window.partitionBy(session, question, own).orderBy(ts, key)
    return answers.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def session_scores(answers: DataFrame, skipped: str = "exclude", session: str = "session_id",
                   score: str = "score", answer: str = "user_answer") -> DataFrame:
    """A4 + A8: per session the Python-rounded mean of its answer scores (0.0
    when nothing counts), the number answered, strengths (>= 70) and weak
    areas (< 70).

    ``skipped='exclude'`` leaves blank answers out of the mean (a skip adds no
    answer); ``'zero'`` counts them with score 0.
    """
    blank = is_blank(answer)
    if skipped == "exclude":
        s = F.when(~blank, F.col(score))
    elif skipped == "zero":
        s = F.when(blank, F.lit(0.0)).otherwise(F.col(score))
    else:
        raise ValueError("skipped must be 'exclude' or 'zero'")
    a = answers.withColumn("_s", s)
    return a.groupBy(session).agg(
        F.coalesce(py_round1(exact_mean("_s")), F.lit(0.0)).alias("session_score"),
        F.count("_s").alias("answered"),
        F.count_if(F.col("_s") >= labels.STRENGTH_CUT).alias("strengths"),
        F.count_if(F.col("_s") < labels.STRENGTH_CUT).alias("weak_areas"),
    )


# --- A7 -------------------------------------------------------------------------

def _step(s: Column, x: Column) -> Column:
    return py_round1((s + x) / 2.0)


def fold(items: Column) -> Column:
    """Fold a sorted array<struct<..., x>> from its first element."""
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))),
                       items[0]["x"], lambda s, r: _step(s, r["x"]))


def _transfer(items: Column, lo: Column, hi: Column) -> Column:
    """The slice as a function of the incoming state, for slices that do not
    start a key: its first PREFIX scores as they are, then a map of
    breakpoints for the rest.

    Every step is monotone and halves distances, so after PREFIX rows the
    states that started anywhere in [lo, hi] (which allows for rounding) lie between the folds of lo and
    hi, a few points of the 0.1 grid apart whatever the range of scores. The
    rest of the slice maps those points; the map is kept as array<struct<lo,
    out>> (out for every state >= lo) with equal neighbours merged."""
    head, rest = F.slice(items, 1, PREFIX), F.slice(items, PREFIX + 1, F.greatest(F.size(items) - PREFIX, F.lit(1)))
    through = lambda s: F.aggregate(head, s, lambda t, r: _step(t, r["x"]))
    points = F.sequence(F.rint(through(lo) * 10.0).cast("bigint"), F.rint(through(hi) * 10.0).cast("bigint"))
    init = F.transform(points, lambda k: F.struct((k / 10.0).alias("lo"), (k / 10.0).alias("out"),
                                                  F.lit(True).alias("keep")))

    def step(acc, r):
        moved = F.transform(acc, lambda b, i: F.struct(
            b["lo"].alias("lo"),
            _step(b["out"], r["x"]).alias("out"),
            ((i == 0) | (_step(F.get(acc, i - 1)["out"], r["x"]) != _step(b["out"], r["x"])))
            .alias("keep")))
        return F.filter(moved, lambda b: b["keep"])

    table = F.when(F.size(items) > PREFIX, F.aggregate(rest, init, step))
    return F.struct(F.transform(head, lambda r: r["x"]).alias("head"), table.alias("map"))


def _apply(g: Column, s: Column) -> Column:
    """The state after a slice, from the state before it."""
    t = F.aggregate(g["head"], s, lambda acc, x: _step(acc, x))
    # the first entry also holds every state below it
    hit = F.element_at(g["map"], F.greatest(F.size(F.filter(g["map"], lambda b: b["lo"] <= t + 0.05)), F.lit(1)))
    return F.when(g["map"].isNull(), t).otherwise(hit["out"])


def _slice_hot_keys(r: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """Add ``_chunk`` (slice of a hot key, in order; 0 for other keys),
    ``_hot`` and the key's range of scores (``_lo``, ``_hi``).

    Hot keys (more than ``chunk_rows`` rows; at most total/chunk_rows of
    them) are found by one partial aggregate and written once. Their rows
    alone are range-partitioned on (key, time, id) into ceil(hot rows /
    chunk_rows) partitions: each partition is a contiguous run of a key's
    order whatever the time distribution (bursts of equal timestamps
    included), and the partition index orders the slices.
    """
    stats = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    hot = written(stats.where(F.col("_n") > chunk_rows), "hot-keys")
    hot_rows_total = hot.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    none = F.lit(None).cast("double")
    if hot_rows_total == 0:
        return r.select("*", F.lit(0).alias("_chunk"), F.lit(False).alias("_hot"), none.alias("_lo"), none.alias("_hi"))
    hb = small_side(hot.select(*keys, "_lo", "_hi"), is_written=True).select(
        *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_lo", "_hi")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    cold = r.join(hb, cond, "left_anti").select(
        "*", F.lit(0).alias("_chunk"), F.lit(False).alias("_hot"), none.alias("_lo"), none.alias("_hi"))
    n_parts = max(2, -(-hot_rows_total // chunk_rows))
    hot_r = (r.join(hb, cond).select(*r.columns, "_lo", "_hi")
             .repartitionByRange(n_parts, *[F.col(k) for k in keys], F.col("_ts"), F.col("_id"))
             .withColumn("_chunk", F.spark_partition_id()).withColumn("_hot", F.lit(True)))
    return cold.unionByName(hot_r)


def smoothed_scores(rows: DataFrame, keys: list[str], ts: str, tiebreak: str, score: str,
                    chunk_rows: int = CHUNK_ROWS, out: str = "smoothed_score",
                    stands_for: str | None = None) -> DataFrame:
    """Per key, the first score, then ``py_round1((old + new) / 2)`` for
    every further score in (ts, tiebreak) order. Also returns n and the true
    mean beside it. A row without a score counts in n and changes nothing
    else; a key without any score has null for both. ``stands_for`` names a
    column with the number of rows a row stands for in n (a stored state).

    One plan for every size: a partial aggregate gives per-key counts and
    score range; keys with more than ``chunk_rows`` rows are cut into ordered
    slices of about that many; rows are grouped by (key, slice) and each slice
    is folded natively. The first slice of a key yields its value, later
    slices a function of the state before them; these are applied in slice
    order in one last small group-by.
    """
    r = rows.select(*keys, F.col(ts).alias("_ts"), F.col(tiebreak).alias("_id"),
                    F.col(score).cast("double").alias("x"),
                    (F.col(stands_for) if stands_for else F.lit(1)).cast("bigint").alias("_w"))
    r = _slice_hot_keys(r, keys, chunk_rows)
    scored = F.when(F.col("x").isNotNull(), F.struct("_ts", "_id", "x"))
    chunks = (r.groupBy(*keys, "_chunk", "_hot", "_lo", "_hi")
              .agg(F.sort_array(F.collect_list(scored)).alias("_items"), F.sum("_w").alias("_cn"),
                   F.sum(units("x")).alias("_us_sum"), F.count("x").alias("_xn"))
              .select(*keys, "_chunk", "_cn", "_us_sum", "_xn",
                      F.when(F.size("_items") > 0, fold(F.col("_items"))).alias("_final"),
                      F.when(F.col("_hot") & (F.size("_items") > 0),
                             _transfer(F.col("_items"), F.col("_lo") - 0.1, F.col("_hi") + 0.1)).alias("_g")))

    # The first slice that holds a score gives its value directly; each later
    # one is applied to the state before it.
    parts = F.sort_array(F.collect_list(F.when(F.col("_xn") > 0, F.struct("_chunk", "_final", "_g"))))
    comp = chunks.groupBy(*keys).agg(
        parts.alias("_parts"), F.sum("_cn").alias("n"),
        F.sum("_us_sum").alias("_usum"), F.sum("_xn").alias("_xn"))
    value = F.aggregate(F.slice(F.col("_parts"), 2, F.greatest(F.size("_parts") - 1, F.lit(0))),
                        F.get(F.col("_parts"), F.lit(0))["_final"],
                        lambda s, p: _apply(p["_g"], s))
    return comp.select(*keys, value.alias(out), "n",
                       py_round1(F.col("_usum") / (F.col("_xn") * 10000.0)).alias("mean_score"))


def upsert_performance(state: DataFrame | None, sessions: DataFrame, keys: list[str],
                       ts: str, tiebreak: str, score: str, out: str = "average_score",
                       chunk_rows: int = CHUNK_ROWS, id_col: str | None = None, serial=None) -> DataFrame:
    """Apply new session scores to the stored smoothed score.

    A stored value acts as the first element of the key's sequence (it sorts
    before every new row), so keys only in the state keep it, keys only in the
    batch start from their first score, and keys in both continue from the
    state: the full-outer-join-and-coalesce of an upsert, done by the fold.
    With ``id_col``, stored rows keep their id and new keys get serial ids
    above the largest, in the order of the keys; where ``state`` is only a
    part of the stored rows, ``serial(wanted)`` sets that many ids aside and
    gives the one before them.
    """
    new = sessions.select(*keys, F.col(ts).alias("_t"), F.col(tiebreak).cast("bigint").alias("_i"),
                          F.col(score).alias("_x"))
    if state is not None:
        old = state.select(*keys, F.lit(None).cast(new.schema["_t"].dataType).alias("_t"),
                           F.lit(None).cast("bigint").alias("_i"), F.col(out).alias("_x"))
        new = old.unionByName(new)
    res = smoothed_scores(new, keys, "_t", "_i", "_x", chunk_rows=chunk_rows, out=out).select(*keys, out)
    if id_col is None:
        return res
    if state is None:
        res = written(res, "performance")
        return assign_ids(res, serial(res.count()) if serial else 0, id_col, keys)
    # written once: the ids read it several times
    known = state.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], id_col)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    joined = written(res.join(known, cond, "left").select(*keys, out, id_col), "performance")
    fresh = joined.where(F.col(id_col).isNull()).drop(id_col)
    fresh = assign_ids(fresh, serial(fresh.count()) if serial else joined, id_col, keys)
    return joined.where(F.col(id_col).isNotNull()).unionByName(fresh)


def upsert_stored_performance(spark: SparkSession, path: str, sessions: DataFrame,
                              keys: tuple[str, str] = ("user_id", "category"), ts: str = "interview_date",
                              tiebreak: str = "id", score: str = "overall_score",
                              buckets: int | None = None) -> None:
    """J4 on the stored table: of all (category, user bucket) folders only
    those that the batch touches are read and written again, all by one job
    that publishes its files when it commits. Nothing stored yet is an empty
    table; one stored without buckets is refused. One writer at a time."""
    new_ids = lambda wanted: io.reserve_ids(spark, path, "performance_id", wanted)
    order = (ts, tiebreak, score)
    if io.stored_buckets(spark, path) is None:
        if io.has_data(spark, path):
            raise ValueError(f"{path} is stored without user buckets; store it with write_table first")
        first = upsert_performance(None, sessions, list(keys), *order, id_col="performance_id", serial=new_ids)
        io.write_table(first, path, "performance", mode="append", buckets=buckets)
        return
    batch = written(sessions.select(*dict.fromkeys([*keys, *order])), "batch")
    stored = io.read_touched(spark, path, batch)
    io.write_touched_partitions(
        upsert_performance(stored, batch, list(keys), *order, id_col="performance_id", serial=new_ids), batch, path)


# --- J5 -------------------------------------------------------------------------

def update_session_scores(sessions: DataFrame, new_scores: DataFrame, id_col: str = "id",
                          score: str = "overall_score", new_score: str = "session_score",
                          new_id: str = "session_id") -> DataFrame:
    """UPDATE ... SET score = new WHERE id = ...: a left join on the id and
    a coalesce; sessions without a new score keep theirs."""
    n = new_scores.select(F.col(new_id).alias(id_col), F.col(new_score).alias("_new"))
    return (sessions.join(n, id_col, "left")
            .withColumn(score, F.coalesce("_new", F.col(score))).drop("_new"))
