"""

Every query reads the driver's test tables through the stand-in mapping of
``quizlens.sources.standins`` and runs over whole tables. Each key of
``queries()`` of the library proper has an ``oracle_sql()`` entry with the same
column names. The training-data operators are added where they are installed;
those that SQL cannot express have none.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quizlens.functions import labels as LB  # noqa: E402
from quizlens.functions import text as TX  # noqa: E402
from quizlens.operators import lemmas as LM  # noqa: E402
from quizlens.operators import quality as Q  # noqa: E402
from quizlens.operators import rank as RK  # noqa: E402
from quizlens.operators import rollup as RU  # noqa: E402
from quizlens.operators import score as SC  # noqa: E402
from quizlens.plans import reports as RP  # noqa: E402
from quizlens.session import ensure_checkpoint_dir, scratch_path, spread  # noqa: E402
from quizlens.sources import io as IO  # noqa: E402
from quizlens.sources import standins as S  # noqa: E402
from quizlens.streaming import stream as ST  # noqa: E402

SPLIT_TS = "2024-01-16 00:00:00"   # stand-in: rows before it are "already stored"
ONE_USER = 7                        # P2 / W6: the single-user forms


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the dashboard for every user (R2) on sf0.001."""
    return q_r2_dashboard(spark, "/root/testdata/sf0.001")


# --- sources and sinks -----------------------------------------------------------

def q_io1_read_question_set(spark, sf):
    """IO1: the benchmark items written as a JSON question set and read back under the fixed
    two-column schema."""
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "question_set")
    IO.write_question_set(S.question_set(spark, sf), path)
    return IO.read_question_set(spark, path, multi_line=False)


def q_io2_load_bank(spark, sf):
    """The documents folded into seed-bank rows (map: category -> up to 10
    items, like the seed's 10 questions per category) and unfolded again.
    Groups are blocks of 10 consecutive doc ids, so no group grows with the
    table."""
    d = S.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("block"), "lang", "doc_id",
        F.struct(F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"),
                 F.col("text").alias("ideal"), F.col("source").alias("hint")).alias("item"))
    per_cat = d.groupBy("block", "lang").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "item"))).alias("_items"))
    nested = per_cat.groupBy("block").agg(F.map_from_entries(F.collect_list(
        F.struct("lang", F.col("_items.item")))).alias("bank"))
    return IO.load_bank(nested, existing=None)


def q_io3_table_round_trip(spark, sf):
    """IO3: all sessions written month-partitioned under the fixed schema and read back."""
    path = scratch_path(spark, "interview_session")
    IO.write_table(S.sessions(spark, sf), path, "interview_session")
    return IO.read_table(spark, path, "interview_session")


def q_io4_clean_csv_round_trip(spark, sf):
    """IO4: the cleaned question set written as CSV (arrays as JSON) and read back."""
    cleaned = RP.clean_question_set(S.question_set(spark, sf).select("question", "ideal_answer"))
    path = scratch_path(spark, "clean_csv")
    IO.write_clean_csv(cleaned, path)
    return IO.read_clean_csv(spark, path, cleaned.columns)


def q_io5_assign_ids(spark, sf):
    """IO5: customers of one segment play the stored table; every other customer gets a serial
    id above its maximum, in the order of name and key, with all its columns."""
    c = S.table(spark, sf, "customer")
    existing = c.where(F.col("c_mktsegment") == "BUILDING")
    new = c.where(F.col("c_mktsegment") != "BUILDING")
    return IO.assign_ids(new, existing, "c_custkey", ["c_name", "c_custkey"], out_col="new_id")


def q_io6_append_rows(spark, sf):
    """IO6: sessions before the split are stored, some with a null score or size; the later ones
    are given their defaults and appended to the stored table, which is then read back."""
    s = S.sessions(spark, sf)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    old = s.where(F.col("interview_date") < cut) \
           .withColumn("overall_score", F.when(F.col("id") % 5 != 0, F.col("overall_score"))) \
           .withColumn("total_questions", F.when(F.col("id") % 7 != 0, F.col("total_questions")))
    new = s.where(F.col("interview_date") >= cut).drop("overall_score", "total_questions")
    path = scratch_path(spark, "interview_session")
    IO.write_table(old, path, "interview_session")
    IO.write_table(old, path, "interview_session", mode="ignore")
    IO.write_table(IO.append_rows(old.limit(0), new, "interview_session"), path, "interview_session", mode="append")
    return IO.read_table(spark, path, "interview_session")


# --- projection, filter, labels -----------------------------------------------------

def q_p1_project(spark, sf):
    return S.question_set(spark, sf).select("question", "ideal_answer")


def q_p2_user_filter(spark, sf):
    """The equality filter by user is the operator under test (pushed into the scan), not a
    cut of the data."""
    return S.sessions(spark, sf).where(F.col("user_id") == ONE_USER)


def q_p3_strengths(spark, sf):
    a = S.answers(spark, sf)
    return a.where(LB.is_strength("score")).select("answer_id", "session_id", "score")


def q_p4_category_key(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", LB.category_key("lang").alias("category"))


def q_p5_category_label(spark, sf):
    return S.sessions(spark, sf).select("id", LB.category_label("category").alias("label"))


def q_p6_grade(spark, sf):
    return S.sessions(spark, sf).select("id", LB.grade("overall_score").alias("grade"),
                                        LB.grade_class("overall_score").alias("grade_class"))


def q_p7_badge(spark, sf):
    return S.sessions(spark, sf).select("id", LB.badge("overall_score").alias("badge"))


def q_p8_band4(spark, sf):
    return S.sessions(spark, sf).select("id", LB.band4("overall_score").alias("band"))


def q_p9_band3(spark, sf):
    return S.sessions(spark, sf).select("id", LB.band3("overall_score").alias("band"))


def q_p10_titles(spark, sf):
    return S.sessions(spark, sf).select("id", F.upper("category").alias("code"),
                                        LB.category_title("category").alias("title"))


def q_p11_date_labels(spark, sf):
    return S.sessions(spark, sf).select("id", LB.short_date("interview_date").alias("short_date"),
                                        LB.long_date("interview_date").alias("long_date"))


def q_p12_previews(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", LB.preview("text", LB.QUESTION_PREVIEW).alias("q_preview"),
                    LB.preview("text", LB.ANSWER_PREVIEW).alias("a_preview"))


def q_p13_answer_status(spark, sf):
    return S.answers(spark, sf).select("answer_id", LB.answer_status("user_answer").alias("status"))


def q_p14_progress(spark, sf):
    a = S.answers(spark, sf)
    return RK.question_positions(a).select(
        *a.columns, "progress_pct",
        LB.completion("ordinal", F.lit(LB.QUESTIONS_PER_SESSION)).alias("completion"))


def q_p15_display_name(spark, sf):
    u = S.users(spark, sf)
    return u.select("id", LB.display_name("name").alias("display_name"),
                    LB.initial("name").alias("initial"))


# --- text -------------------------------------------------------------------------

def _docs_clean(spark, sf):
    d = spread(S.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", TX.clean_text("text").alias("clean_answer"))


def q_t1_clean_text(spark, sf):
    return _docs_clean(spark, sf)


def q_t2_tokens(spark, sf):
    return _docs_clean(spark, sf).select("doc_id", TX.tokenize("clean_answer").alias("tokens"))


def q_t3_stop_words(spark, sf):
    return _docs_clean(spark, sf).select(
        "doc_id", TX.remove_stop_words(TX.tokenize("clean_answer")).alias("filtered_tokens"))


def q_t4_lemmas(spark, sf):
    """Lemma table (the fixed irregular nouns) plus suffix rules accepted when
    the corpus itself holds the form (a lexicon Spark derives from the
    documents)."""
    toks = _docs_clean(spark, sf).select(
        "doc_id", TX.remove_stop_words(TX.tokenize("clean_answer")).alias("filtered_tokens"))
    return LM.lemmatize_rows(toks, "doc_id", "filtered_tokens", "lemmatized",
                             lemmas=RP.irregular_lemmas(spark), lexicon="corpus")


def q_t5_final_text(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", F.col("text").alias("ideal_answer"))
    return RP.clean_question_set(d).select("doc_id", "final_text")


def q_t6_normalise(spark, sf):
    a = S.accounts(spark, sf)
    return a.select("id", TX.normalise_email("email").alias("email"),
                    TX.normalise_name("first_name").alias("first_name"))


def _registrations(spark, sf):
    c = S.table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("reg_id"),
        F.when(F.col("c_acctbal") < 0, F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit(S.BLANK))).otherwise(
            F.split_part("c_name", F.lit("#"), F.lit(1))).alias("first_name"),
        F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"),
                 F.lit("@Mail.test\n")).alias("email"),
        "c_nationkey")


def q_t7_registration_checks(spark, sf):
    """Every customer as a registration; e-mails built from segment and nation collide on
    purpose; customers of nations 0-2 play the existing accounts."""
    reg = _registrations(spark, sf)
    existing = reg.where(F.col("c_nationkey") < 3).select("email")
    return Q.registration_checks(reg, existing)


def q_t8_strip_answer(spark, sf):
    """Every turn, some with white space of several kinds around them and some of nothing else."""
    c = S.table(spark, sf, "conversations")
    said = F.coalesce("text", F.lit(""))
    c = c.withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(S.BLANK), said, F.lit("\r\n")))
                     .when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 0), F.lit(S.BLANK)).otherwise(said))
    stripped = TX.strip_answer("text")
    return c.select("conv_id", "turn", stripped.alias("answer"), (stripped == "").alias("is_blank"))


# --- joins ------------------------------------------------------------------------

def q_j1_answer_question(spark, sf):
    a = S.answers(spark, sf).select("answer_id", "question_id")
    # only what the report shows crosses the join (not the whole ideal text)
    bank = S.questions(spark, sf).select(
        "id", LB.preview("question_text", LB.QUESTION_PREVIEW).alias("question_preview"),
        F.length("ideal_answer").alias("ideal_chars"))
    return SC.join_bank(a, bank).select("answer_id", "question_id", "question_preview", "ideal_chars")


def q_j2_link_accounts(spark, sf):
    """Every account linked to its user by normalised e-mail; the users of one segment have
    another address, so unmatched accounts show."""
    users = S.users(spark, sf).withColumn("email", F.when(
        F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("old-"), F.col("email"))).otherwise(F.col("email")))
    return Q.link_accounts(S.accounts(spark, sf), users)


def _j3_parts(spark, sf):
    c = S.table(spark, sf, "customer")
    email = F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("@mail.test"))
    target = c.where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), email.alias("email"))
    top = IO.max_id(c, "c_custkey").first()[0]
    batch = c.select((F.col("c_custkey") + top).alias("id"), F.col("c_name").alias("name"),
                     email.alias("email"))
    return target, batch


def q_j3_insert_if_absent(spark, sf):
    """One segment is the target; all customers are inserted if their e-mail is absent,
    first by id within the batch."""
    target, batch = _j3_parts(spark, sf)
    return Q.insert_if_absent(target, batch, ["email"], ["id"])


def q_j4_upsert_performance(spark, sf):
    """The smoothed scores of sessions before the split are stored, in folders of category and
    user bucket; later sessions are applied, the touched folders rewritten, and the table read back
    (equal to folding all in order; ids kept and continued). One event type plays the null category."""
    s = S.sessions(spark, sf).withColumn("category", F.when(F.col("category") != "error", F.col("category")))
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    path = scratch_path(spark, "performance")
    RU.upsert_stored_performance(spark, path, s.where(F.col("interview_date") < cut), buckets=4)
    RU.upsert_stored_performance(spark, path, s.where(F.col("interview_date") >= cut))
    return IO.read_table(spark, path, "performance").select("user_id", "category", "average_score", "performance_id")


def q_j5_update_session_scores(spark, sf):
    """Every session starts at 0.0; sessions get the mean of the answers that count, sessions
    with none keep 0.0."""
    a = RU.dedupe_submissions(S.answers(spark, sf))
    sessions = a.groupBy("session_id").agg(F.lit(0.0).alias("overall_score")) \
                .withColumnRenamed("session_id", "id")
    return RU.update_session_scores(sessions, RU.session_scores(a)).select(
        F.col("id").alias("session_id"), "overall_score")


def q_j6_audit(spark, sf):
    t = lambda n: S.table(spark, sf, n)
    return Q.audit([
        ("orders_pk", Q.duplicate_rows(t("orders"), ["o_orderkey"])),
        ("lineitem_pk", Q.duplicate_rows(t("lineitem"), ["l_orderkey", "l_linenumber"])),
        ("lineitem_orders_fk", Q.orphan_rows(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")),
        ("orders_customer_fk", Q.orphan_rows(t("orders"), "o_custkey", t("customer"), "c_custkey")),
        ("sessions_users_fk", Q.orphan_rows(t("events"), "user_id", t("customer"), "c_custkey")),
        ("users_without_sessions", Q.orphan_rows(t("customer"), "c_custkey", t("events"), "user_id")),
        ("ideal_answer_len", Q.too_long(S.questions(spark, sf), "ideal_answer", 5000)),
        ("question_text_len", Q.too_long(S.questions(spark, sf), "question_text", 2000)),
    ])


# --- scoring ----------------------------------------------------------------------

def q_v1_vector_scores(spark, sf):
    v = S.vectors(spark, sf)
    ideals = SC.ideal_vectors_by_min_key(v, "label", "vec_id")
    # one size-checked broadcast join; the ideal itself is not an answer
    return SC.vector_scores(v, ideals, "label") \
             .where(F.col("vec_id") != F.col("ideal_key")).select("vec_id", "label", "score")


def q_v2_embed_texts(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    return SC.embed_texts(d, "text").select("doc_id", "embedding")


def q_v3_text_cosine(spark, sf):
    return SC.text_cosine(S.text_pairs(spark, sf), ["conv_id", "turn"], "user_text", "ideal_text")


def q_v4_score_answers(spark, sf):
    """V4: every user turn scored against the assistant turn right after it (its question is that
    turn; every assistant turn is in the bank). Turns without one score 0.0."""
    answers, bank = S.turn_answers(spark, sf)
    return SC.score_answers(answers, bank, ["conv_id", "turn"], ["conv_id", "question_turn"],
                            bank_key=["conv_id", "turn"]).select("conv_id", "turn", "score")


# --- aggregation --------------------------------------------------------------------

def q_a1_user_totals(spark, sf):
    return RU.user_totals(S.sessions(spark, sf), S.users(spark, sf))


def q_a2_category_avg(spark, sf):
    return RU.category_averages(S.sessions(spark, sf)).select("user_id", "category", "avg")


def q_a3_categories_tried(spark, sf):
    return RU.categories_tried(S.sessions(spark, sf))


def q_a4_session_scores(spark, sf):
    a = RU.dedupe_submissions(S.answers(spark, sf))
    return RU.session_scores(a).select("session_id", "session_score", "answered")


def q_a5_has_rows(spark, sf):
    return IO.is_empty_df(S.table(spark, sf, "documents"))


def q_a6_max_id(spark, sf):
    return IO.max_id(S.table(spark, sf, "customer"), "c_custkey")


def q_a7_smoothed_scores(spark, sf):
    return RU.smoothed_scores(S.sessions(spark, sf), ["user_id", "category"], "interview_date",
                              "id", "overall_score")


def q_a8_session_counts(spark, sf):
    a = RU.dedupe_submissions(S.answers(spark, sf))
    return RU.session_scores(a).select("session_id", "answered", "strengths", "weak_areas")


# --- windows ----------------------------------------------------------------------

def q_w1_latest_sessions(spark, sf):
    return RK.latest_sessions(S.sessions(spark, sf)).select("user_id", "id", "rn", "overall_score")


def q_w2_trend(spark, sf):
    return RK.trend_series(S.sessions(spark, sf))


def q_w3_first_questions(spark, sf):
    return RK.first_questions(S.questions(spark, sf)).select("id", "category", "rn")


def q_w4_ordinal(spark, sf):
    a = S.answers(spark, sf)
    return RK.question_positions(a).select(*a.columns, "ordinal")


def q_w5_last_flag(spark, sf):
    a = S.answers(spark, sf)
    return RK.question_positions(a).select(*a.columns, "is_last")


def q_w6_user_latest(spark, sf):
    """The single-user form of W1; the user filter and the top 10 are the operator under
    test."""
    return RK.user_latest(S.sessions(spark, sf), ONE_USER).select(
        "id", "interview_date", "overall_score")


def q_w7_category_rank(spark, sf):
    return RU.category_averages(S.sessions(spark, sf)).select("user_id", "category", "rank")


# --- streaming --------------------------------------------------------------------

def _landed(spark, sf, name, order):
    path = ST.land_out_of_order(spark, sf, name, order)
    return dict(parts_dir=path, max_files=ST.files_of_a_range(spark, path))


def q_st1_stream_scores(spark, sf):
    """ST1-ST4: the whole table arrives in several ranges, the newest first; a micro-batch takes as
    many files as a range has, so their number does not grow with the table."""
    return ST.stream_vector_scores(spark, sf, **_landed(spark, sf, "embeddings", "vec_id"))


def q_st1_stream_text_scores(spark, sf):
    return ST.stream_text_scores(spark, sf, **_landed(spark, sf, "conversations", "conv_id"))


def q_st2_stream_user_stats(spark, sf):
    return ST.stream_user_stats(spark, sf, **_landed(spark, sf, "events", "ts"))


def q_st3_stream_smoothed(spark, sf):
    return ST.stream_smoothed_scores(spark, sf, **_landed(spark, sf, "events", "ts"))


def q_st4_stream_dedupe(spark, sf):
    return ST.stream_dedupe(spark, sf, **_landed(spark, sf, "events", "ts")).select(
        "answer_id", "session_id", "question_id")


# --- reports ----------------------------------------------------------------------

def q_r1_session_report(spark, sf):
    return RP.session_report(S.answers(spark, sf), S.questions(spark, sf))


def q_r2_dashboard(spark, sf):
    return RP.dashboard(S.sessions(spark, sf), S.users(spark, sf))


def q_r3_clean_question_set(spark, sf):
    """The cleaning job over all documents as ideal answers."""
    d = S.questions(spark, sf).select("id", F.col("question_text").alias("question"), "ideal_answer")
    return RP.clean_question_set(d)


def q_r4_close_sessions(spark, sf):
    return RP.close_sessions(S.answers(spark, sf))


def _training_data():
    """The optional subpackage and pipeline: (queries, oracle SQL), both empty
    where the subpackage has been removed."""
    if importlib.util.find_spec("quizlens.llm") is None:
        return {}, {}
    from quizlens.llm import queries as L
    qs, sql = dict(L.QUERIES), dict(L.ORACLE)
    if importlib.util.find_spec("corpus_pipeline") is not None:
        import corpus_pipeline as P
        qs["pipeline"] = P.run
        if P.ORACLE_SQL:
            sql["pipeline"] = P.ORACLE_SQL
    return qs, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g = globals()
    own = {k[2:]: v for k, v in g.items() if k.startswith("q_") and callable(v)}
    return own | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    from quizlens.plans.oracle_queries import ORACLE
    return dict(ORACLE) | _training_data()[1]
