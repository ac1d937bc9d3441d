"""Sources/sinks on own files, and plan shapes (no Python in native paths,
broadcasts where expected, no cartesian products, top-k pushed down)."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL, core_queries
from quizlens.session import scratch_path
from quizlens.sources import io as IO


def test_read_json_array_question_set(spark):
    path = scratch_path(spark, "qs-json")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    with open(os.path.join(local, "set.json"), "w") as f:
        json.dump([{"question": "Q1", "ideal_answer": "A1", "extra": 1},
                   {"question": "Q2", "ideal_answer": None}], f, indent=2)
    rows = IO.read_question_set(spark, path).collect()
    assert [(r.question, r.ideal_answer) for r in rows] == [("Q1", "A1"), ("Q2", None)]
    assert IO.read_question_set(spark, path).columns == ["question", "ideal_answer"]


def test_malformed_records_go_to_a_side_table(spark):
    path = scratch_path(spark, "bad-json")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    with open(os.path.join(local, "set.json"), "w") as f:
        f.write('{"question": "Q1", "ideal_answer": "A1"}\n{"question": "Q2", "ideal\n{"question": null}\nnot json\n')
    good, bad = IO.read_question_set(spark, path, multi_line=False, with_bad=True)
    assert [tuple(r) for r in good.collect()] == [("Q1", "A1"), (None, None)]
    assert sorted(r.record for r in bad.collect()) == ["not json", '{"question": "Q2", "ideal'] and bad.first().file.endswith("set.json")
    path = scratch_path(spark, "bad-csv")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    with open(os.path.join(local, "set.csv"), "w") as f:
        f.write('question,ideal\nq1,"a\n1"\nq2\nq3,a3,more\n')
    good, bad = IO.read_clean_csv(spark, path, ["question", "ideal"], with_bad=True)
    assert [tuple(r) for r in good.collect()] == [("q1", "a\n1")] and bad.count() == 2


def test_clean_csv_round_trip_keeps_empty_and_newlines(spark):
    from quizlens.plans.reports import clean_question_set
    df = spark.createDataFrame([("q,1", "Line one\nline \"two\""), ("q2", "!!!")],
                               "question string, ideal_answer string")
    cleaned = clean_question_set(df)
    path = scratch_path(spark, "csv")
    IO.write_clean_csv(cleaned, path)
    back = {r.question: r for r in IO.read_clean_csv(spark, path, cleaned.columns).collect()}
    assert back["q,1"].ideal_answer == "Line one\nline \"two\""
    assert back["q,1"].tokens == '["line","one","line","two"]'
    assert back["q2"].final_text == "" and back["q2"].tokens == "[]"


def test_load_bank_only_into_empty_bank(spark):
    nested = spark.createDataFrame(
        [({"hr": [("Q", "I", "H")], "sql": [("Q2", "I2", "H2"), ("Q3", "I3", "H3")]},)],
        "bank map<string, array<struct<question:string, ideal:string, hint:string>>>")
    bank = IO.load_bank(nested)
    assert sorted((r.category, r.question_text, r.difficulty) for r in bank.collect()) == [
        ("hr", "Q", "medium"), ("sql", "Q2", "medium"), ("sql", "Q3", "medium")]
    assert IO.load_bank(nested, existing=bank) is bank
    assert IO.is_empty_df(bank).first().has_rows is True
    assert IO.is_empty_df(bank.limit(0)).first().has_rows is False


def test_append_rows_defaults(spark):
    schema = "id bigint, user_id bigint, interview_date timestamp_ntz, overall_score double, total_questions int"
    old = spark.createDataFrame([(1, 1, None, 50.0, 5), (2, 1, None, None, None)], schema)
    new = spark.createDataFrame([(3, 1)], "id bigint, user_id bigint")
    given = spark.createDataFrame([(4, 1, None)], "id bigint, user_id bigint, overall_score double")
    got = {r.id: r for r in IO.append_rows(IO.append_rows(old, new, "interview_session"), given,
                                           "interview_session").collect()}
    assert {i: (r.overall_score, r.total_questions) for i, r in got.items()} == {
        1: (50.0, 5), 2: (None, None), 3: (0.0, 10), 4: (None, 10)}
    assert got[1].interview_date is None and got[3].interview_date is not None


def test_write_modes(spark):
    rows = lambda *ids: spark.createDataFrame([(i, f"u{i}") for i in ids], "id bigint, name string") \
        .selectExpr("id", "name", "name || '@x' AS email", "cast(null AS timestamp_ntz) AS created_at")
    path = scratch_path(spark, "users")
    IO.write_table(rows(1), path, "users", mode="ignore")
    IO.write_table(rows(2), path, "users", mode="ignore")
    IO.write_table(rows(3), path, "users", mode="append")
    assert sorted(r.id for r in IO.read_table(spark, path, "users").collect()) == [1, 3]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CORE = sorted(core_queries())
NATIVE = ["t1_clean_text", "t2_tokens", "t3_stop_words", "t5_final_text", "r3_clean_question_set",
          "v1_vector_scores", "v3_text_cosine", "v4_score_answers", "a7_smoothed_scores",
          "r1_session_report", "r2_dashboard", "r4_close_sessions"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_native_plans(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, (name, node)


@pytest.mark.parametrize("name", CORE)
def test_no_cartesian_product(spark, name):
    if name.startswith("st"):
        pytest.skip("streaming queries run to completion when built")
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_bank_join_is_broadcast(spark):
    assert "BroadcastHashJoin" in _plan(E.queries()["j1_answer_question"](spark, SF_SMALL))


def test_wide_bank_is_not_broadcast(spark):
    """Bytes decide, not rows: a million short rows may be less than a
    thousand long ones."""
    from quizlens.session import BROADCAST_MAX_BYTES, small_side, table_bytes
    keys = spark.range(1_000_000).select("id", F.lit("x").alias("t"))
    wide = spark.range(1_000_000).select("id", F.repeat(F.lit("long text "), 500).alias("t"))
    assert table_bytes(keys) < BROADCAST_MAX_BYTES < 5_000_000_000 < table_bytes(wide)
    probe = spark.range(10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.range(1000).select("id", F.repeat(F.lit("long text "), 500).alias("t"))
        assert "BroadcastHashJoin" in _plan(probe.join(small_side(few), "id"))
        assert "BroadcastHashJoin" not in _plan(probe.join(small_side(few, max_bytes=1000), "id"))
        assert "BroadcastHashJoin" not in _plan(probe.join(small_side(wide, is_written=True), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_are_read_once(spark):
    plan = _plan(E.queries()["v3_text_cosine"](spark, SF_SMALL))
    assert plan.count("FileScan") == 2 and plan.count("Join ") == 1


def test_dedupe_plans_no_sort_aggregate(spark):
    for name in ("r1_session_report", "a4_session_scores"):
        assert "min_by" not in _plan(E.queries()[name](spark, SF_SMALL))


def test_positions_plan_has_no_global_sort(spark):
    plan = _plan(E.queries()["w4_ordinal"](spark, SF_SMALL))
    assert plan.count("FileScan") <= 2 and "rangepartitioning" not in plan


def test_top_k_pushed_before_shuffle(spark):
    plan = E.queries()["w1_latest_sessions"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    one = _plan(E.queries()["w6_user_latest"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in one


def test_filter_and_columns_pushed_to_scan(spark):
    df = E.queries()["p2_user_filter"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    a1 = _plan(E.queries()["a1_user_totals"](spark, SF_SMALL))
    assert "props" not in a1  # the JSON column is never read for totals


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_score" in df.columns


def test_sessions_partition_pruning(spark):
    from quizlens.sources import standins as S
    path = scratch_path(spark, "sessions-by-month")
    sess = S.sessions(spark, SF_SMALL)
    IO.write_table(sess, path, "interview_session")
    got = IO.read_sessions_between(spark, path, "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    plan = _plan(got)
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters" in plan
    want = sess.where("interview_date >= '2024-01-10' AND interview_date < '2024-01-12'") \
               .select(*got.columns)
    assert got.count() > 0 and sorted(got.collect()) == sorted(want.collect())


def _performance(spark, rows):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, u, t0 + dt.timedelta(hours=h), c, x) for i, u, h, c, x in rows],
        "id bigint, user_id bigint, interview_date timestamp_ntz, category string, overall_score double")


def test_upsert_rewrites_only_touched_partitions(spark):
    """Stored rows of untouched categories, of a null category and the ids
    stay; the documented flow, twice."""
    from quizlens.operators import rollup as RU
    keys, order = ["user_id", "category"], ("interview_date", "id", "overall_score")
    first = _performance(spark, [(1, 5, 0, "hr", 50.0), (2, 5, 1, "ml", 40.0), (3, 8, 2, "ds", 10.0), (4, 9, 3, None, 30.0)])
    path = scratch_path(spark, "performance")
    IO.write_table(RU.upsert_performance(None, first, keys, *order, id_col="performance_id"), path, "performance")
    before = {(r.user_id, r.category): (r.performance_id, r.average_score)
              for r in IO.read_table(spark, path, "performance").collect()}
    assert sorted(i for i, _ in before.values()) == [1, 2, 3, 4]
    for batch, changed in (([(5, 5, 4, "hr", 80.0), (6, 7, 5, "hr", 20.0)], {(5, "hr"): (before[5, "hr"][0], 65.0), (7, "hr"): (5, 20.0)}),
                           ([(7, 9, 6, None, 50.0)], {(9, None): (before[9, None][0], 40.0)})):
        rows = _performance(spark, batch)
        stored = IO.read_table(spark, path, "performance")
        IO.write_touched_partitions(
            RU.upsert_performance(stored, rows, keys, *order, id_col="performance_id"), rows, path)
        before |= changed
        got = {(r.user_id, r.category): (r.performance_id, r.average_score)
               for r in IO.read_table(spark, path, "performance").collect()}
        assert got == before


def test_touched_write_refuses_an_unpartitioned_target(spark):
    rows = _performance(spark, [(1, 5, 0, "hr", 50.0)])
    path = scratch_path(spark, "flat")
    rows.write.parquet(path)
    with pytest.raises(ValueError):
        IO.write_touched_partitions(rows, rows, path)


def _files(path):
    """{folder: {file: bytes}} of a stored table."""
    local = path[len("file:"):] if path.startswith("file:") else path
    out = {}
    for folder, _, names in os.walk(local):
        found = {n: os.path.getsize(os.path.join(folder, n)) for n in names if n.endswith(".parquet")}
        if found and "_serial" not in folder:
            out[os.path.relpath(folder, local)] = found
    return out


def test_files_follow_the_advisory_size(spark):
    """A month of one row is one file, whatever the number of tasks; a month
    of many rows is as many files as its size asks for."""
    path = scratch_path(spark, "clustered")
    rows = spark.range(0, 400_001, 1, 40).select(
        "id", (F.col("id") % 1000).alias("user_id"),
        F.when(F.col("id") == 7, F.lit("2024-02-01")).otherwise(F.lit("2024-01-15")).cast("timestamp_ntz").alias("interview_date"),
        F.rand(3).alias("overall_score"), F.lit("hr").alias("category"), F.lit(10).alias("total_questions"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        IO.write_table(rows, path, "interview_session")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = _files(path)
    assert len(files["month=2024-02"]) == 1
    assert 4 <= len(files["month=2024-01"]) <= 16
    assert IO.read_table(spark, path, "interview_session").count() == 400_001
    small = scratch_path(spark, "small")
    from quizlens.sources import standins as S
    IO.write_table(S.sessions(spark, SF_SMALL).repartition(40), small, "interview_session")
    assert all(len(f) == 1 for f in _files(small).values())


def test_upsert_leaves_untouched_buckets(spark):
    """A batch of ten users rewrites their folders only; ids go on above all
    stored ones without reading the others."""
    from quizlens.operators import rollup as RU
    path = scratch_path(spark, "buckets")
    first = _performance(spark, [(i, i % 200, i % 24, ["hr", "ml", None][i % 3], float(i % 90)) for i in range(600)])
    RU.upsert_stored_performance(spark, path, first, buckets=32)
    assert IO.stored_buckets(spark, path) == 32
    before, rows = _files(path), {tuple(r) for r in IO.read_table(spark, path, "performance").collect()}
    batch = _performance(spark, [(1000 + u, u, 30, "hr", 50.0) for u in range(5)] + [(2000 + u, 5000 + u, 31, None, 20.0) for u in range(5)])
    plan = _plan(IO.read_touched(spark, path, batch))
    assert "PartitionFilters: [" in plan and "of32" in plan
    RU.upsert_stored_performance(spark, path, batch)
    after = _files(path)
    changed = {f for f in after if after[f] != before.get(f)}
    assert 1 <= len(changed) <= 10 and all(after[f] == before[f] for f in before if f not in changed)
    got = {tuple(r) for r in IO.read_table(spark, path, "performance").collect()}
    new = {r for r in got - rows if r[1] >= 5000}
    assert sorted(r[0] for r in new) == [len(rows) + 1 + k for k in range(5)]
    want = RU.smoothed_scores(first.unionByName(batch), ["user_id", "category"], "interview_date", "id", "overall_score")
    assert {(r[1], r[2], r[3]) for r in got} == {(r.user_id, r.category, r.smoothed_score) for r in want.collect()}


def test_upsert_refuses_a_table_without_buckets(spark):
    from quizlens.operators import rollup as RU
    path = scratch_path(spark, "by-category")
    spark.createDataFrame([(1, 5, 40.0, "hr")], "performance_id bigint, user_id bigint, average_score double, category string") \
        .write.partitionBy("category").parquet(path)
    with pytest.raises(ValueError):
        RU.upsert_stored_performance(spark, path, _performance(spark, [(1, 5, 0, "hr", 50.0)]))


def test_lost_serial_falls_back_to_the_stored_ids(spark):
    path = scratch_path(spark, "serial")
    assert IO.reserve_ids(spark, path, "performance_id", 3) == 0
    assert IO.reserve_ids(spark, path, "performance_id", 2) == 3
    assert IO.reserve_ids(spark, path, "performance_id", 1) == 5
    other = scratch_path(spark, "serial")
    IO.write_table(spark.createDataFrame([(9, 1, "hr", 5.0)], "performance_id bigint, user_id bigint, category string, average_score double"),
                   other, "performance")
    assert IO.reserve_ids(spark, other, "performance_id", 1) == 9


def _range_sizes(spark, df, order, **kw):
    return [r["count"] for r in IO.ranged(df, order, **kw).groupBy("_range").count().collect()]


def test_ranges_are_even_for_texts_that_begin_alike_and_hot_values(spark):
    """Customers by name, a hot first value and nulls: no range has twice the
    mean, and ids are those of a plain sort."""
    from quizlens.sources import standins as S
    c = S.table(spark, "/root/testdata/sf0.1", "customer").select("c_name", "c_custkey")
    sizes = _range_sizes(spark, c, ["c_name", "c_custkey"], rows_per_range=500)
    assert len(sizes) == -(-c.count() // 500) and max(sizes) < 2 * 500
    hot = spark.range(0, 30_000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("user"), F.col("id") % 97)).alias("name"), "id")
    sizes = _range_sizes(spark, hot, ["name", "id"], rows_per_range=1000)
    assert len(sizes) == 30 and max(sizes) < 2000
    got = IO.global_rank(hot, ["name", "id"], rows_per_range=1000).orderBy("_grank")
    assert [(r.name, r.id, r._grank) for r in got.collect()] == [
        (r.name, r.id, k) for k, r in enumerate(hot.orderBy("name", "id").collect())]


def test_a_range_that_came_out_large_is_cut_again(spark):
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") * F.col("id")).alias("x"), "id")
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "1")
    try:
        sizes = _range_sizes(spark, df, ["x"], rows_per_range=400)
        ranks = IO.global_rank(df, ["x"], rows_per_range=400).where("_grank <> id").count()
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    assert max(sizes) <= 800 and sum(sizes) == 20_000 and ranks == 0
    # rows that agree in the whole order cannot be cut, and still get ranks
    same = spark.range(0, 5000, 1, 3).select(F.lit(1).alias("x"))
    got = sorted(r._grank for r in IO.global_rank(same, ["x"], rows_per_range=100).collect())
    assert got == list(range(5000))
    assert IO.global_rank(same.limit(0), ["x"]).count() == 0


def test_a_hot_hour_of_a_session_is_cut(spark):
    from quizlens.operators import rank as RK
    a = spark.range(0, 20_000, 1, 5).select(
        F.col("id").alias("answer_id"), F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id") % 50).cast("bigint").alias("session_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 3000).cast("timestamp_ntz").alias("answered_at"))
    got, want = (RK.question_positions(a, bucket_rows=n).collect() for n in (500, 10 ** 9))
    assert sorted(got) == sorted(want)
