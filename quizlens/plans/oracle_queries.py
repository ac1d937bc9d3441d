"""DuckDB statements, one per registered query, with the same column names.
Only the driver's pre-registered views are read."""

from __future__ import annotations

from quizlens.plans.oracle import (ACCOUNTS, ANSWERS, DEDUPED, PAIRS, QUESTION_SET, QUESTIONS,
                                   SESSIONS, USERS, R, badge, band3, band4, blank, clean, exact_mean,
                                   final, grade, grade_class, label, lemma_ctes, lit, preview,
                                   sql_round1_mean, stop_filter, strip, tokens, units, with_)
from quizlens.sources.standins import BLANK
from quizlens.functions import text as TX

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def _clean_set(src: str, columns: str, lists: str = "{}") -> str:
    """The cleaning job over ``src``; ``lists`` formats the array columns."""
    ctes = with_(
        rows_=f"SELECT *, {stop_filter('tokens')} AS filtered_tokens FROM (SELECT *, {tokens('clean_answer')} AS tokens "
              f"FROM (SELECT row_number() OVER () AS k, {columns}, {clean('ideal_answer')} AS clean_answer FROM ({src})))",
        **lemma_ctes("rows_", "k"))
    arrays = ", ".join(f"{lists.format(c)} AS {c}" for c in ("tokens", "filtered_tokens", "lemmatized"))
    return (ctes.replace("rows_ AS (", "rows_ AS MATERIALIZED (") +
            f"SELECT {columns}, clean_answer, {arrays}, {final('lemmatized')} AS final_text "
            f"FROM rows_ JOIN lem ON rows_.k = lem.k")


def _smoothed(src: str, keys: str, ts: str, tb: str, x: str, out: str) -> str:
    return (f"SELECT {keys}, list_reduce(list({x} ORDER BY {ts}, {tb}) FILTER (WHERE {x} IS NOT NULL), "
            f"lambda acc, v: {R('(acc + v) / 2.0')}) AS {out}, count(*) AS n, "
            f"{R(exact_mean(x))} AS mean_score FROM ({src}) GROUP BY {keys}")


def _session_rows(skipped_excluded: bool = True) -> str:
    s = f"CASE WHEN NOT ({blank('user_answer')}) THEN score END"
    return (f"SELECT session_id, first(user_id) AS user_id, "
            f"arg_min(category, (answered_at, answer_id)) AS category, "
            f"min(answered_at) AS interview_date, "
            f"coalesce({R(exact_mean('_s'))}, 0.0) AS overall_score, count(_s) AS answered, "
            f"count(*) FILTER (WHERE _s >= 70) AS strengths, count(*) FILTER (WHERE _s < 70) AS weak_areas "
            f"FROM (SELECT *, {s} AS _s FROM deduped) GROUP BY session_id")


_TEXT_COS = ("CASE WHEN coalesce(na, 0) > 0 AND coalesce(nb, 0) > 0 THEN "
             "CAST(dot AS DOUBLE) / (sqrt(CAST(na AS DOUBLE)) * sqrt(CAST(nb AS DOUBLE))) ELSE 0.0 END")

_REG = (f"SELECT c_custkey AS reg_id, CASE WHEN c_acctbal >= 0 THEN split_part(c_name, '#', 1) "
        f"WHEN c_custkey % 2 = 0 THEN '' ELSE {lit(BLANK)} END AS first_name, "
        "' ' || chr(9) || c_mktsegment || CAST(c_nationkey AS VARCHAR) || '@Mail.test' || chr(10) AS email, "
        "c_nationkey FROM customer")

ORACLE: dict[str, str] = {}

# --- sources and sinks ---------------------------------------------------------
ORACLE["io1_read_question_set"] = f"SELECT question, ideal_answer FROM ({QUESTION_SET})"
ORACLE["io2_load_bank"] = ("SELECT lang AS category, split_part(text, chr(10), 1) AS question_text, "
                           "text AS ideal_answer, source AS hint, 'medium' AS difficulty FROM documents")
ORACLE["io3_table_round_trip"] = f"SELECT id, user_id, interview_date, overall_score, category, total_questions FROM ({SESSIONS})"
ORACLE["io4_clean_csv_round_trip"] = _clean_set(QUESTION_SET, "question, ideal_answer", "to_json({})::VARCHAR")
ORACLE["io5_assign_ids"] = (
    "WITH mx AS (SELECT coalesce(max(c_custkey), 0) AS m FROM customer WHERE c_mktsegment = 'BUILDING') "
    "SELECT customer.*, m + row_number() OVER (ORDER BY c_name, c_custkey) AS new_id "
    "FROM customer, mx WHERE c_mktsegment <> 'BUILDING'")
ORACLE["io6_append_rows"] = (
    with_(s=SESSIONS) +
    f"SELECT id, user_id, interview_date, category, CASE WHEN id % 5 <> 0 THEN overall_score END AS overall_score, "
    f"CASE WHEN id % 7 <> 0 THEN total_questions END AS total_questions FROM s "
    f"WHERE interview_date < {SPLIT} UNION ALL "
    f"SELECT id, user_id, interview_date, category, 0.0 AS overall_score, CAST(10 AS INTEGER) "
    f"FROM s WHERE interview_date >= {SPLIT}")

# --- projection, filter, labels ---------------------------------------------------
ORACLE["p1_project"] = f"SELECT question, ideal_answer FROM ({QUESTION_SET})"
ORACLE["p2_user_filter"] = f"SELECT * FROM ({SESSIONS}) WHERE user_id = 7"
ORACLE["p3_strengths"] = f"SELECT answer_id, session_id, score FROM ({ANSWERS}) WHERE score >= 70"
ORACLE["p4_category_key"] = "SELECT doc_id, coalesce(lower(lang), 'hr') AS category FROM documents"
ORACLE["p5_category_label"] = f"SELECT id, {label('category')} AS label FROM ({SESSIONS})"
ORACLE["p6_grade"] = (f"SELECT id, {grade('overall_score')} AS grade, "
                      f"{grade_class('overall_score')} AS grade_class FROM ({SESSIONS})")
ORACLE["p7_badge"] = f"SELECT id, {badge('overall_score')} AS badge FROM ({SESSIONS})"
ORACLE["p8_band4"] = f"SELECT id, {band4('overall_score')} AS band FROM ({SESSIONS})"
ORACLE["p9_band3"] = f"SELECT id, {band3('overall_score')} AS band FROM ({SESSIONS})"
ORACLE["p10_titles"] = f"SELECT id, upper(category) AS code, category || ' Interview' AS title FROM ({SESSIONS})"
ORACLE["p11_date_labels"] = (f"SELECT id, strftime(interview_date, '%b %d') AS short_date, "
                             f"strftime(interview_date, '%b %d, %Y') AS long_date FROM ({SESSIONS})")
ORACLE["p12_previews"] = (f"SELECT doc_id, {preview('text', 60)} AS q_preview, "
                          f"{preview('text', 80)} AS a_preview FROM documents")
ORACLE["p13_answer_status"] = (f"SELECT answer_id, CASE WHEN {blank('user_answer')} "
                               f"THEN 'Skipped' ELSE 'Answered' END AS status FROM ({ANSWERS})")
ORACLE["p14_progress"] = (
    f"SELECT * EXCLUDE (ordinal, n), CAST(round_even((ordinal - 1) / n * 100.0, 0) AS INTEGER) AS progress_pct, "
    f"CAST(ordinal AS VARCHAR) || '/10' AS completion FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY session_id ORDER BY answered_at, answer_id) AS ordinal, "
    f"count(*) OVER (PARTITION BY session_id) AS n FROM ({ANSWERS}))")
ORACLE["p15_display_name"] = (
    f"SELECT id, coalesce(nullif({strip('name')}, ''), 'Guest') AS display_name, "
    f"coalesce(upper(substring(nullif({strip('name')}, ''), 1, 1)), 'G') AS initial FROM ({USERS})")

# --- text -------------------------------------------------------------------------
_DC = f"SELECT doc_id, {clean('text')} AS clean_answer FROM documents"
ORACLE["t1_clean_text"] = _DC
ORACLE["t2_tokens"] = f"SELECT doc_id, {tokens('clean_answer')} AS tokens FROM ({_DC})"
ORACLE["t3_stop_words"] = f"SELECT doc_id, {stop_filter(tokens('clean_answer'))} AS filtered_tokens FROM ({_DC})"
_DOC_TOKENS = f"SELECT doc_id, {stop_filter(tokens('clean_answer'))} AS filtered_tokens FROM ({_DC})"
ORACLE["t4_lemmas"] = with_(toks=_DOC_TOKENS, **lemma_ctes("toks", "doc_id")) + "SELECT doc_id, lemmatized FROM lem"
ORACLE["t5_final_text"] = (with_(toks=_DOC_TOKENS, **lemma_ctes("toks", "doc_id")) +
                           f"SELECT doc_id, {final('lemmatized')} AS final_text FROM lem")
ORACLE["t6_normalise"] = f"SELECT id, lower({strip('email')}) AS email, {strip('first_name')} AS first_name FROM ({ACCOUNTS})"
ORACLE["t7_registration_checks"] = (
    with_(reg=f"SELECT *, lower({strip('email')}) AS _email, {strip('first_name')} AS _first FROM ({_REG})",
          ex=f"SELECT DISTINCT lower({strip('email')}) AS _email FROM reg WHERE c_nationkey < 3",
          fst="SELECT _email, min(reg_id) AS _fk FROM reg GROUP BY _email") +
    "SELECT reg_id, reg._email AS email, list_filter([CASE WHEN coalesce(_first, '') = '' THEN 'missing first name' END, "
    "CASE WHEN coalesce(reg._email, '') = '' THEN 'missing email' END, "
    "CASE WHEN ex._email IS NOT NULL THEN 'email already registered' END, "
    "CASE WHEN reg_id > fst._fk THEN 'duplicate email in batch' END], lambda e: e IS NOT NULL) AS errors "
    "FROM reg LEFT JOIN ex ON reg._email = ex._email LEFT JOIN fst ON reg._email = fst._email")
ORACLE["t8_strip_answer"] = (
    f"SELECT conv_id, turn, {strip('t')} AS answer, {strip('t')} = '' AS is_blank FROM (SELECT conv_id, turn, "
    f"CASE WHEN conv_id % 3 = 0 THEN {lit(BLANK)} || coalesce(text, '') || chr(13) || chr(10) "
    f"WHEN conv_id % 3 = 1 AND turn = 0 THEN {lit(BLANK)} ELSE coalesce(text, '') END AS t FROM conversations)")

# --- joins ------------------------------------------------------------------------
ORACLE["j1_answer_question"] = (
    with_(a=ANSWERS, q=QUESTIONS) +
    f"SELECT a.answer_id, a.question_id, {preview('q.question_text', 60)} AS question_preview, "
    f"CAST(length(q.ideal_answer) AS INTEGER) AS ideal_chars FROM a LEFT JOIN q ON a.question_id = q.id")
ORACLE["j2_link_accounts"] = (
    with_(a=ACCOUNTS, u=f"SELECT * REPLACE (CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'old-' || email ELSE email END "
                        f"AS email) FROM ({USERS})") +
    f"SELECT a.id AS account_id, u.id AS user_id, lower({strip('a.email')}) AS email FROM a "
    f"LEFT JOIN u ON lower({strip('a.email')}) = lower({strip('u.email')})")
ORACLE["j3_insert_if_absent"] = (
    with_(t="SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) "
            "|| '@mail.test' AS email FROM customer WHERE c_mktsegment = 'BUILDING'",
          b="SELECT c_custkey + (SELECT max(c_custkey) FROM customer) AS id, c_name AS name, lower(c_mktsegment) || "
            "CAST(c_nationkey AS VARCHAR) || '@mail.test' AS email FROM customer",
          bf="SELECT email, arg_min(id, id) AS id, arg_min(name, id) AS name FROM b GROUP BY email") +
    "SELECT id, name, email FROM t UNION ALL SELECT id, name, email FROM bf "
    "WHERE email NOT IN (SELECT email FROM t)")
ORACLE["j4_upsert_performance"] = (
    with_(sessions=f"SELECT * REPLACE (CASE WHEN category <> 'error' THEN category END AS category) FROM ({SESSIONS})",
          old=f"SELECT DISTINCT user_id, category FROM sessions WHERE interview_date < {SPLIT}",
          stored="SELECT *, row_number() OVER (ORDER BY user_id, category NULLS FIRST) AS performance_id FROM old",
          fresh="SELECT *, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY user_id, category NULLS FIRST) "
                "AS performance_id FROM (SELECT user_id, category FROM sessions EXCEPT SELECT user_id, category FROM old)",
          ids="SELECT * FROM stored UNION ALL SELECT * FROM fresh") +
    f"SELECT p.user_id, p.category, p.average_score, ids.performance_id FROM ("
    f"{_smoothed('sessions', 'user_id, category', 'interview_date', 'id', 'overall_score', 'average_score')}) p "
    f"JOIN ids ON p.user_id = ids.user_id AND p.category IS NOT DISTINCT FROM ids.category")
ORACLE["j5_update_session_scores"] = (
    with_(answers=ANSWERS, deduped=DEDUPED,
          new="SELECT session_id, coalesce(" + R(exact_mean("_s")) + ", 0.0) AS session_score FROM "
              f"(SELECT *, CASE WHEN NOT ({blank('user_answer')}) THEN score END AS _s FROM deduped) "
              "GROUP BY session_id") +
    "SELECT s.session_id, coalesce(new.session_score, 0.0) AS overall_score FROM "
    "(SELECT DISTINCT session_id FROM deduped) s LEFT JOIN new ON s.session_id = new.session_id")
ORACLE["j6_audit"] = (
    "SELECT 'orders_pk' AS check_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows FROM "
    "(SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1) "
    "UNION ALL SELECT 'lineitem_pk', CAST(coalesce(sum(n), 0) AS BIGINT) FROM "
    "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) "
    "UNION ALL SELECT 'lineitem_orders_fk', CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey IS NOT NULL AND "
    "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL) "
    "UNION ALL SELECT 'orders_customer_fk', CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey IS NOT NULL AND "
    "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL) "
    "UNION ALL SELECT 'sessions_users_fk', CAST(count(*) AS BIGINT) FROM events WHERE user_id IS NOT NULL AND "
    "user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL) "
    "UNION ALL SELECT 'users_without_sessions', CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey IS NOT NULL AND "
    "c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) "
    f"UNION ALL SELECT 'ideal_answer_len', CAST(count_if(length(ideal_answer) > 5000) AS BIGINT) FROM ({QUESTIONS}) "
    f"UNION ALL SELECT 'question_text_len', CAST(count_if(length(question_text) > 2000) AS BIGINT) FROM ({QUESTIONS})")

# --- scoring ----------------------------------------------------------------------
_VCOS = ("CASE WHEN len(a) > 0 AND len(b) > 0 AND na > 0 AND nb > 0 THEN dot / (sqrt(na) * sqrt(nb)) "
         "ELSE 0.0 END")
ORACLE["v1_vector_scores"] = (
    with_(ideal="SELECT label, min(vec_id) AS ideal_key, arg_min(embedding, vec_id) AS ie FROM embeddings GROUP BY label",
          pairs="SELECT e.vec_id, e.label, CAST(e.embedding AS DOUBLE[]) AS a, CAST(i.ie AS DOUBLE[]) AS b "
                "FROM embeddings e JOIN ideal i ON e.label = i.label WHERE e.vec_id <> i.ideal_key",
          sums="SELECT *, list_reduce(list_transform(list_zip(a, b), lambda p: p[1] * p[2]), lambda x, y: x + y, 0.0) AS dot, "
               "list_reduce(list_transform(a, lambda x: x * x), lambda x, y: x + y, 0.0) AS na, "
               "list_reduce(list_transform(b, lambda x: x * x), lambda x, y: x + y, 0.0) AS nb FROM pairs") +
    f"SELECT vec_id, label, {R(_VCOS + ' * 100.0')} AS score FROM sums")


def _tok_unnest(keys: str, text: str, src: str, ca: int, cb: int) -> str:
    return (f"SELECT {keys}, unnest({tokens(clean(text))}) AS token, {ca} AS ca, {cb} AS cb FROM {src}")


_PLACES = f"list_transform({tokens(clean('text'))}, lambda t: ('0x' || substr(md5(t), 1, 8))::UBIGINT % 64)"
ORACLE["v2_embed_texts"] = (
    f"SELECT doc_id, list_transform(range(64), lambda i: len(list_filter(places, lambda p: p = i))::DOUBLE) AS embedding "
    f"FROM (SELECT doc_id, {_PLACES} AS places FROM documents)")
ORACLE["v3_text_cosine"] = (
    with_(p=PAIRS,
          c="SELECT conv_id, turn, token, sum(ca) AS ca, sum(cb) AS cb FROM (" +
            _tok_unnest("conv_id, turn", "user_text", "p", 1, 0) + " UNION ALL " +
            _tok_unnest("conv_id, turn", "ideal_text", "p", 0, 1) + ") GROUP BY conv_id, turn, token",
          s="SELECT conv_id, turn, sum(ca * cb) AS dot, sum(ca * ca) AS na, sum(cb * cb) AS nb FROM c "
            "GROUP BY conv_id, turn") +
    f"SELECT p.conv_id, p.turn, {R(_TEXT_COS + ' * 100.0')} AS score FROM p "
    f"LEFT JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn")
ORACLE["v4_score_answers"] = (
    with_(p="SELECT u.conv_id, u.turn, u.text AS a, i.text AS b FROM conversations u LEFT JOIN conversations i "
            "ON i.conv_id = u.conv_id AND i.turn = u.turn + 1 AND i.role = 'assistant' WHERE u.role = 'user'",
          c="SELECT conv_id, turn, token, sum(ca) AS ca, sum(cb) AS cb FROM (" +
            _tok_unnest("conv_id, turn", "a", "p", 1, 0) + " UNION ALL " +
            _tok_unnest("conv_id, turn", "b", "p", 0, 1) + ") GROUP BY conv_id, turn, token",
          s="SELECT conv_id, turn, sum(ca * cb) AS dot, sum(ca * ca) AS na, sum(cb * cb) AS nb FROM c "
            "GROUP BY conv_id, turn") +
    f"SELECT p.conv_id, p.turn, {R(_TEXT_COS + ' * 100.0')} AS score FROM p "
    f"LEFT JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn")

# --- aggregation --------------------------------------------------------------------
ORACLE["a1_user_totals"] = (
    with_(s=SESSIONS, t=f"SELECT user_id, count(*) AS total_interviews, {R(exact_mean('overall_score'))} AS avg_score, "
                         f"{R('max(overall_score)')} AS best_score FROM s GROUP BY user_id") +
    f"SELECT u.id AS user_id, CAST(coalesce(t.total_interviews, 0) AS BIGINT) AS total_interviews, "
    f"coalesce(t.avg_score, 0.0) AS avg_score, coalesce(t.best_score, 0.0) AS best_score "
    f"FROM ({USERS}) u LEFT JOIN t ON u.id = t.user_id")
ORACLE["a2_category_avg"] = (f"SELECT user_id, category, {sql_round1_mean('overall_score')} AS avg "
                             f"FROM ({SESSIONS}) GROUP BY user_id, category")
ORACLE["a3_categories_tried"] = (f"SELECT user_id, count(DISTINCT category) AS categories_tried "
                                 f"FROM ({SESSIONS}) GROUP BY user_id")
ORACLE["a4_session_scores"] = (
    with_(answers=ANSWERS, deduped=DEDUPED) +
    "SELECT session_id, coalesce(" + R(exact_mean("_s")) + ", 0.0) AS session_score, count(_s) AS answered "
    f"FROM (SELECT *, CASE WHEN NOT ({blank('user_answer')}) THEN score END AS _s FROM deduped) "
    "GROUP BY session_id")
ORACLE["a5_has_rows"] = "SELECT count(*) > 0 AS has_rows FROM (SELECT 1 FROM documents LIMIT 1)"
ORACLE["a6_max_id"] = "SELECT CAST(coalesce(max(c_custkey), 0) AS BIGINT) AS max_id FROM customer"
ORACLE["a7_smoothed_scores"] = (
    with_(sessions=SESSIONS) +
    _smoothed("sessions", "user_id, category", "interview_date", "id", "overall_score", "smoothed_score"))
ORACLE["a8_session_counts"] = (
    with_(answers=ANSWERS, deduped=DEDUPED) +
    "SELECT session_id, count(_s) AS answered, count(*) FILTER (WHERE _s >= 70) AS strengths, "
    "count(*) FILTER (WHERE _s < 70) AS weak_areas "
    f"FROM (SELECT *, CASE WHEN NOT ({blank('user_answer')}) THEN score END AS _s FROM deduped) "
    "GROUP BY session_id")

# --- windows ----------------------------------------------------------------------
ORACLE["w1_latest_sessions"] = (
    f"SELECT user_id, id, CAST(rn AS INTEGER) AS rn, overall_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    f"ORDER BY interview_date DESC, id DESC) AS rn FROM ({SESSIONS})) WHERE rn <= 10")
ORACLE["w2_trend"] = (
    f"SELECT user_id, list(strftime(interview_date, '%b %d') ORDER BY interview_date, id) AS chart_labels, "
    f"list({R('overall_score')} ORDER BY interview_date, id) AS chart_scores FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interview_date, id) AS rn FROM ({SESSIONS})) "
    f"WHERE rn <= 20 GROUP BY user_id")
ORACLE["w3_first_questions"] = (
    f"SELECT id, category, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rn "
    f"FROM ({QUESTIONS})) WHERE rn <= 10")
ORACLE["w4_ordinal"] = (f"SELECT *, row_number() OVER (PARTITION BY session_id "
                        f"ORDER BY answered_at, answer_id) AS ordinal FROM ({ANSWERS})")
ORACLE["w5_last_flag"] = (f"SELECT *, lead(answer_id) OVER (PARTITION BY session_id "
                          f"ORDER BY answered_at, answer_id) IS NULL AS is_last FROM ({ANSWERS})")
ORACLE["w6_user_latest"] = (f"SELECT id, interview_date, overall_score FROM ({SESSIONS}) WHERE user_id = 7 "
                            f"ORDER BY interview_date DESC, id DESC LIMIT 10")
ORACLE["w7_category_rank"] = (
    f"SELECT user_id, category, CAST(row_number() OVER (PARTITION BY user_id ORDER BY avg DESC NULLS FIRST, "
    f"category) AS INTEGER) AS rank FROM (SELECT user_id, category, {sql_round1_mean('overall_score')} AS avg "
    f"FROM ({SESSIONS}) GROUP BY user_id, category)")

# --- streaming (same values as their batch forms) ---------------------------------
ORACLE["st1_stream_scores"] = ORACLE["v1_vector_scores"]
ORACLE["st1_stream_text_scores"] = ORACLE["v4_score_answers"]
ORACLE["st2_stream_user_stats"] = (
    f"SELECT user_id, count(*) AS total_interviews, {R(exact_mean('overall_score'))} AS avg_score, "
    f"{R('max(overall_score)')} AS best_score FROM ({SESSIONS}) GROUP BY user_id")
ORACLE["st3_stream_smoothed"] = (
    with_(sessions=SESSIONS) +
    f"SELECT user_id, category, smoothed_score, n FROM ("
    f"{_smoothed('sessions', 'user_id, category', 'interview_date', 'id', 'overall_score', 'smoothed_score')})")
ORACLE["st4_stream_dedupe"] = (with_(answers=ANSWERS, deduped=DEDUPED) +
                               "SELECT answer_id, session_id, question_id FROM deduped")

# --- reports ----------------------------------------------------------------------
_R2_PARTS = (f"SELECT user_id, category, count(*) AS n, count(overall_score) AS n_scored, "
             f"sum({units('overall_score')}) AS unit_sum, max(overall_score) AS best, "
             f"{sql_round1_mean('overall_score')} AS avg FROM s GROUP BY user_id, category")
ORACLE["r2_dashboard"] = (
    with_(s=SESSIONS, parts=_R2_PARTS,
          ranked="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY avg DESC NULLS FIRST, category) AS rnk FROM parts",
          pu="SELECT user_id, sum(n) AS total_interviews, "
             f"{R('CAST(sum(unit_sum) AS DOUBLE) / CAST(sum(n_scored) * 10000 AS DOUBLE)')} AS avg_score, "
             f"{R('max(best)')} AS best_score, count(*) AS categories_tried, "
             "list(category ORDER BY rnk) AS cat_names, list(avg ORDER BY rnk) AS cat_avgs, "
             f"list({band3('avg')} ORDER BY rnk) AS cat_bands FROM ranked GROUP BY user_id",
          tr=f"SELECT user_id, list(strftime(interview_date, '%b %d') ORDER BY interview_date, id) AS chart_labels, "
             f"list({R('overall_score')} ORDER BY interview_date, id) AS chart_scores FROM ("
             f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interview_date, id) AS rn FROM s) "
             f"WHERE rn <= 20 GROUP BY user_id",
          rc="SELECT user_id, list(category || ' Interview' ORDER BY rn) AS recent_titles, "
             "list(strftime(interview_date, '%b %d, %Y') ORDER BY rn) AS recent_dates, "
             "list(overall_score ORDER BY rn) AS recent_scores, "
             f"list({band4('overall_score')} ORDER BY rn) AS recent_bands, "
             "list(CAST(total_questions AS VARCHAR) || '/10' ORDER BY rn) AS recent_questions FROM ("
             "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interview_date DESC, id DESC) AS rn "
             "FROM s) WHERE rn <= 10 GROUP BY user_id",
          u=USERS) +
    f"SELECT u.id AS user_id, coalesce(nullif({strip('u.name')}, ''), 'Guest') AS display_name, "
    f"coalesce(upper(substring(nullif({strip('u.name')}, ''), 1, 1)), 'G') AS initial, "
    "CAST(coalesce(pu.total_interviews, 0) AS BIGINT) AS total_interviews, coalesce(pu.avg_score, 0.0) AS avg_score, "
    "coalesce(pu.best_score, 0.0) AS best_score, CAST(coalesce(pu.categories_tried, 0) AS BIGINT) AS categories_tried, "
    "coalesce(pu.cat_names, []::VARCHAR[]) AS cat_names, coalesce(pu.cat_avgs, []::DOUBLE[]) AS cat_avgs, "
    "coalesce(pu.cat_bands, []::VARCHAR[]) AS cat_bands, coalesce(tr.chart_labels, []::VARCHAR[]) AS chart_labels, "
    "coalesce(tr.chart_scores, []::DOUBLE[]) AS chart_scores, coalesce(rc.recent_titles, []::VARCHAR[]) AS recent_titles, "
    "coalesce(rc.recent_dates, []::VARCHAR[]) AS recent_dates, coalesce(rc.recent_scores, []::DOUBLE[]) AS recent_scores, "
    "coalesce(rc.recent_bands, []::VARCHAR[]) AS recent_bands, "
    "coalesce(rc.recent_questions, []::VARCHAR[]) AS recent_questions "
    "FROM u LEFT JOIN pu ON u.id = pu.user_id LEFT JOIN tr ON u.id = tr.user_id LEFT JOIN rc ON u.id = rc.user_id")

_QP = preview("coalesce(question_text, '')", 60)
_R1_ITEMS = (
    f"SELECT d.*, q.question_text, CASE WHEN NOT ({blank('d.user_answer')}) THEN d.score END AS _s "
    "FROM deduped d LEFT JOIN q ON d.question_id = q.id")
ORACLE["r1_session_report"] = (
    with_(answers=ANSWERS, deduped=DEDUPED, q=QUESTIONS, it=_R1_ITEMS,
          g="SELECT session_id, first(user_id) AS user_id, arg_min(category, (answered_at, answer_id)) AS category, "
            f"coalesce({R(exact_mean('_s'))}, 0.0) AS score, count(_s) AS answered, count(*) AS total_questions, "
            f"list({_QP} ORDER BY answered_at, answer_id) "
            "FILTER (WHERE _s >= 70) AS strength_questions, "
            "list(_s ORDER BY answered_at, answer_id) FILTER (WHERE _s >= 70) AS strength_scores, "
            f"list({_QP} ORDER BY answered_at, answer_id) "
            "FILTER (WHERE _s < 70) AS weak_questions, "
            "list(_s ORDER BY answered_at, answer_id) FILTER (WHERE _s < 70) AS weak_scores, "
            f"list(CASE WHEN {blank('user_answer')} THEN 'Skipped' ELSE 'Answered' END "
            "ORDER BY answered_at, answer_id) AS breakdown_status, "
            f"list({band4('coalesce(_s, 0.0)')} ORDER BY answered_at, answer_id) AS breakdown_bands, "
            f"list({preview('user_answer', 80)} ORDER BY answered_at, answer_id) AS breakdown_answers, "
            "list(coalesce(question_text, '') ORDER BY answered_at, answer_id) AS breakdown_questions, "
            "list(_s ORDER BY answered_at, answer_id) AS breakdown_scores "
            "FROM it GROUP BY session_id") +
    f"SELECT session_id, user_id, category, score, {grade('score')} AS grade, {grade_class('score')} AS grade_class, "
    f"{badge('score')} AS badge, {label('category')} AS label, answered, total_questions, "
    "CAST(len(coalesce(strength_questions, [])) AS INTEGER) AS n_strengths, "
    "CAST(len(coalesce(weak_questions, [])) AS INTEGER) AS n_weak, "
    "coalesce(strength_questions, []::VARCHAR[]) AS strength_questions, "
    "coalesce(strength_scores, []::DOUBLE[]) AS strength_scores, "
    "coalesce(weak_questions, []::VARCHAR[]) AS weak_questions, coalesce(weak_scores, []::DOUBLE[]) AS weak_scores, "
    "list_transform(range(1, total_questions + 1), lambda i: i::INTEGER) AS breakdown_ordinals, "
    "breakdown_questions, breakdown_scores, breakdown_status, breakdown_bands, breakdown_answers FROM g")
ORACLE["r3_clean_question_set"] = _clean_set(
    f"SELECT id, question_text AS question, ideal_answer FROM ({QUESTIONS})", "id, question, ideal_answer")
ORACLE["r4_close_sessions"] = (
    with_(answers=ANSWERS, deduped=DEDUPED, sess=_session_rows()) +
    "SELECT user_id, category, average_score, n AS sessions, mean_score FROM (" +
    _smoothed("sess", "user_id, category", "interview_date", "session_id", "overall_score", "average_score") + ")")
