"""DuckDB SQL text for the correctness oracle: the same rules as the Spark
expressions, written once more in SQL over the driver's test tables."""

from __future__ import annotations

from quizlens.functions import text as TX
from quizlens.functions.rounding import py_round1_sql
from quizlens.sources.standins import BLANK


def R(e: str) -> str:
    """py_round1 in DuckDB SQL."""
    return py_round1_sql(e, rint="round_even")


def units(e: str) -> str:
    return f"CAST(round(({e}) * 10000) AS BIGINT)"


def exact_mean(e: str) -> str:
    return f"(CAST(sum({units(e)}) AS DOUBLE) / CAST(count({e}) * 10000 AS DOUBLE))"


def sql_round1_mean(e: str) -> str:
    s, n = f"sum({units(e)})", f"count({e})"
    return (f"(CASE WHEN {n} > 0 THEN CAST(sign({s}) AS DOUBLE) * "
            f"floor(CAST(abs({s}) + {n} * 500 AS DOUBLE) / CAST({n} * 1000 AS DOUBLE)) / 10.0 END)")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, {lit(TX.STRIPPED)})"


def blank(e: str) -> str:
    return f"{strip(f'coalesce({e}, {lit(str())})')} = ''"


def clean(e: str) -> str:
    t = f"lower(coalesce({e}, ''))"
    t = f"regexp_replace({t}, {lit(TX.URL_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(TX.NON_WORD_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(TX.SPACE_RE)}, ' ', 'g')"
    return f"trim({t})"


def tokens(c: str) -> str:
    cases = " ".join(f"WHEN {lit(w)} THEN [{', '.join(lit(p) for p in parts)}]"
                     for w, parts in TX.CONTRACTIONS.items())
    return (f"flatten(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), "
            f"lambda w: CASE w {cases} ELSE [w] END))")


def stop_filter(t: str) -> str:
    words = ", ".join(lit(w) for w in TX.STOP_WORDS)
    return f"list_filter({t}, lambda w: w NOT IN ({words}))"


def lemma_ctes(rows: str, key: str) -> dict[str, str]:
    """CTEs from ``rows`` (``key``, filtered_tokens) to ``lem`` (``key``,
    lemmatized): the irregular nouns, then the suffix rules (with the token
    itself) whose form is a token of the rows, the shortest first."""
    rules = ", ".join(f"({i}, {lit(s)}, {lit(r)})" for i, (s, r) in enumerate(TX.NOUN_RULES, start=1))
    irregular = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in sorted(TX.IRREGULAR_NOUNS.items()))
    return {
        "pos": f"SELECT {key}, unnest(generate_series(1, len(filtered_tokens))) AS pos, "
               f"unnest(filtered_tokens) AS token FROM {rows}",
        "lex": "SELECT DISTINCT token FROM pos",
        "rules": f"SELECT * FROM (VALUES {rules}) AS r(idx, suf, rep)",
        "cands": "SELECT token, 0 AS idx, token AS form FROM lex UNION ALL "
                 "SELECT token, idx, left(token, length(token) - length(suf)) || rep AS form "
                 "FROM lex, rules WHERE suffix(token, suf) AND length(token) > length(suf)",
        "best": "SELECT token, arg_min(form, (length(form), idx)) AS rule_lemma FROM cands "
                "WHERE form IN (SELECT token FROM lex) GROUP BY token",
        "irr": f"SELECT * FROM (VALUES {irregular}) AS t(token, lemma)",
        "dict_": "SELECT d.token, coalesce(irr.lemma, best.rule_lemma, d.token) AS lemma FROM lex d "
                 "LEFT JOIN best ON d.token = best.token LEFT JOIN irr ON d.token = irr.token",
        "got": f"SELECT {key}, list(lemma ORDER BY pos) AS l FROM pos JOIN dict_ USING (token) GROUP BY {key}",
        "lem": f"SELECT {rows}.{key}, coalesce(l, []::VARCHAR[]) AS lemmatized FROM {rows} "
               f"LEFT JOIN got ON {rows}.{key} = got.{key}",
    }


def final(l: str) -> str:
    return f"array_to_string({l}, ' ')"


def grade(s: str) -> str:
    return f"CASE WHEN {s} >= 80 THEN 'Excellent' WHEN {s} >= 60 THEN 'Good' ELSE 'Needs Practice' END"


def grade_class(s: str) -> str:
    return f"CASE WHEN {s} >= 80 THEN 'grade-good' WHEN {s} >= 60 THEN 'grade-mid' ELSE 'grade-low' END"


def badge(s: str) -> str:
    return f"CASE WHEN {s} >= 80 THEN 'Above average' WHEN {s} >= 60 THEN 'Average' ELSE 'Keep practising' END"


def band4(s: str) -> str:
    return (f"CASE WHEN {s} >= 80 THEN 'green' WHEN {s} >= 60 THEN 'purple' "
            f"WHEN {s} >= 40 THEN 'amber' ELSE 'red' END")


def band3(s: str) -> str:
    return f"CASE WHEN {s} >= 80 THEN 'green' WHEN {s} >= 60 THEN 'purple' ELSE 'red' END"


def label(c: str) -> str:
    from quizlens.functions.labels import CATEGORY_LABELS
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CATEGORY_LABELS.items())
    return f"CASE {c} {cases} ELSE 'Interview' END"


def preview(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n}) || '…' ELSE {t} END"


# Stand-in tables as CTE bodies (see quizlens.sources.standins).
SESSIONS = ("SELECT event_id AS id, user_id, ts AS interview_date, event_type AS category, "
            "value AS overall_score, CAST(10 AS INTEGER) AS total_questions "
            "FROM events")
ANSWERS = ("SELECT event_id AS answer_id, "
           "user_id * 100000 + (CAST(ts AS DATE) - DATE '1970-01-01') AS session_id, user_id, "
           "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id, "
           f"CASE WHEN event_type <> 'error' THEN props WHEN event_id % 2 = 0 THEN '' ELSE {lit(BLANK)} END "
           "AS user_answer, "
           "least(value, 100.0::DOUBLE) AS score, ts AS answered_at, event_type AS category "
           "FROM events")
USERS = ("SELECT c_custkey AS id, split_part(c_name, '#', 1) AS name, "
         "lower(c_name) || '@mail.test' AS email, c_nationkey, c_mktsegment, c_acctbal FROM customer")
ACCOUNTS = ("SELECT c_custkey + 1000000 AS id, split_part(c_name, '#', 1) AS first_name, "
            f"c_mktsegment AS last_name, CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE {lit(BLANK)} END "
            "|| upper(c_name) || '@Mail.Test ' || chr(13) || chr(10) AS email, c_custkey "
            "FROM customer")
QUESTIONS = ("SELECT doc_id AS id, lang AS category, split_part(text, chr(10), 1) AS question_text, "
             "text AS ideal_answer, source AS hint, 'medium' AS difficulty FROM documents")
PAIRS = ("SELECT conv_id, turn, user_text, ideal_text FROM ("
         "SELECT conv_id, turn, role, text AS user_text, "
         "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, "
         "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ideal_text FROM conversations) "
         "WHERE role = 'user' AND next_role = 'assistant'")
QUESTION_SET = ("SELECT split_part(text, chr(10), 1) AS question, text AS ideal_answer, item_id "
                "FROM benchmark")
# Answers deduplicated: first submission per (session, question); each one
# without a question.
DEDUPED = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, question_id, "
           "CASE WHEN question_id IS NULL THEN answer_id END "
           "ORDER BY answered_at, answer_id) AS _rn FROM answers) WHERE _rn = 1")


def with_(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " "
