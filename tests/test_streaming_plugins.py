"""State across micro-batches, and the model plug-in for vectors."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quizlens.operators import rollup as RU
from quizlens.operators import score as SC
from quizlens.session import scratch_path
from quizlens.sources import standins as S
from quizlens.streaming import stream as ST


def test_smoothed_state_across_batches_equals_batch_fold(spark):
    ev = S.table(spark, SF_SMALL, "events")
    parts = scratch_path(spark, "events-parts")
    # three files in time order -> three micro-batches (maxFilesPerTrigger=1)
    days = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01")]
    for i, (lo, hi) in enumerate(days):
        (ev.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
         .coalesce(1).write.parquet(f"{parts}/batch={i}"))
    got = {(r.user_id, r.category): (r.smoothed_score, r.n) for r in
           ST.stream_smoothed_scores(spark, SF_SMALL, parts_dir=f"{parts}/*").collect()}
    want = {(r.user_id, r.category): (r.smoothed_score, r.n) for r in RU.smoothed_scores(
        S.sessions(spark, SF_SMALL), ["user_id", "category"], "interview_date", "id",
        "overall_score").collect()}
    assert got == want


def test_every_job_equals_batch_when_files_arrive_newest_first(spark):
    ev = ST.land_out_of_order(spark, SF_SMALL, "events", "ts", parts=4)
    sessions, answers = S.sessions(spark, SF_SMALL), S.answers(spark, SF_SMALL)
    got = {(r.user_id, r.category): (r.smoothed_score, r.n) for r in
           ST.stream_smoothed_scores(spark, SF_SMALL, parts_dir=ev).collect()}
    want = {(r.user_id, r.category): (r.smoothed_score, r.n) for r in RU.smoothed_scores(
        sessions, ["user_id", "category"], "interview_date", "id", "overall_score").collect()}
    assert got == want
    first, late = ST.stream_dedupe(spark, SF_SMALL, parts_dir=ev, with_late=True)
    assert sorted(r.answer_id for r in first.collect()) == sorted(
        r.answer_id for r in RU.dedupe_submissions(answers).collect())
    # all but the newest file, and what is within a day of it, came late
    assert 0.6 * answers.count() < late.count() < 0.8 * answers.count()
    stats = {r.user_id: (r.total_interviews, r.avg_score, r.best_score) for r in
             ST.stream_user_stats(spark, SF_SMALL, parts_dir=ev).collect()}
    assert stats == {r.user_id: (r.total_interviews, r.avg_score, r.best_score) for r in RU.user_totals(sessions).collect()}


def _progress_of(spark, run):
    """Micro-batches of a job: (rows in, keys updated, bytes read from earlier output)."""
    from pyspark.sql.streaming import StreamingQueryListener
    seen = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, e): pass
        def onQueryIdle(self, e): pass
        def onQueryTerminated(self, e): pass
        def onQueryProgress(self, e):
            state = e.progress.stateOperators
            seen.append((e.progress.numInputRows, state[0].numRowsUpdated if state else 0))

    one = Listener()
    spark.streams.addListener(one)
    try:
        out = run()
        rows = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.streams.removeListener(one)
    return rows, seen


def _small_events(spark, batches, rows, users=20):
    """Files in time order, the same keys in each."""
    import os
    import time
    path = scratch_path(spark, "events-small")
    schema = S.table(spark, SF_SMALL, "events").schema
    for b in range(batches):
        df = spark.range(b * rows, (b + 1) * rows).select(
            F.col("id").alias("event_id"), (F.col("id") % users).alias("user_id"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
            F.lit("view").alias("event_type"), (F.col("id") * 37 % 101).cast("double").alias("value"),
            F.concat(F.lit('{"k": '), (F.col("id") % 5).cast("string"), F.lit("}")).alias("props"))
        df = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in schema.fields])
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    assert os.path.basename(path)
    return path


def test_a_batch_costs_the_same_whatever_came_before(spark):
    """Twenty batches of the same keys: the state touched per batch does not
    grow, the output is compacted, and the result is that of the batch form."""
    path = _small_events(spark, 20, 40)
    rows, seen = _progress_of(spark, lambda: ST.stream_smoothed_scores(spark, SF_SMALL, parts_dir=path))
    ev = spark.read.parquet(path)
    want = RU.smoothed_scores(ev.withColumnRenamed("event_type", "category"), ["user_id", "category"], "ts", "event_id", "value")
    assert rows == sorted(((r.user_id, r.category, r.smoothed_score, r.n) for r in want.collect()), key=repr)
    if len(seen) >= 19:
        assert seen[17] == seen[9]


def test_latest_reads_one_base_and_the_batches_after_it(spark):
    path = scratch_path(spark, "latest")
    t = ST.Latest(spark, path, "k bigint, v bigint", ["k"], every=4)
    for i in range(10):
        t.write(spark.createDataFrame([(i % 3, i), (100 + i, i)], "k bigint, v bigint"), i)
    t.write(spark.createDataFrame([(0, 90)], "k bigint, v bigint"), 9)      # a retried batch replaces its own
    want = {0: 90, 1: 7, 2: 8} | {100 + i: i for i in range(9)}
    assert {r.k: r.v for r in t.read().collect()} == want
    files = t.read().inputFiles()
    assert {f.split("/")[-2] for f in files} == {"all=7", "batch=8", "batch=9"}
    assert {r.k: r.v for r in t.read(3).collect()} == {0: 3, 1: 1, 2: 2, 100: 0, 101: 1, 102: 2, 103: 3}


def test_main_output_has_one_row_per_key_across_batches(spark):
    """Repeats of a (session, question) in later files, some of them older."""
    ev = ST.land_out_of_order(spark, SF_SMALL, "events", "event_id", parts=4)
    answers = S.answers(spark, SF_SMALL)
    first, late, main = ST.stream_dedupe(spark, SF_SMALL, delay="20 days", parts_dir=ev, with_main=True)
    keyed = main.where("question_id IS NOT NULL").groupBy("session_id", "question_id").count()
    assert keyed.where("count > 1").count() == 0
    assert main.groupBy("answer_id").count().where("count > 1").count() == 0
    want = sorted(r.answer_id for r in RU.dedupe_submissions(answers).collect())
    assert sorted(r.answer_id for r in first.collect()) == want
    assert main.count() + late.count() <= answers.count()


def test_a_range_of_many_files_is_one_micro_batch(spark):
    """Each range lands as a file per task; the jobs run as many micro-batches
    as there are ranges and keep the result of the batch form."""
    import __spark_entry__ as E
    d = scratch_path(spark, "many-files")
    spark.read.parquet(_small_events(spark, 1, 480)).repartition(6).write.parquet(f"{d}/events.parquet")
    landed = E._landed(spark, d, "events", "ts")
    assert len(spark.read.parquet(landed["parts_dir"]).inputFiles()) > 12
    answers, sessions = S.answers(spark, d), S.sessions(spark, d)
    rows, seen = _progress_of(spark, lambda: ST.stream_dedupe(spark, d, **landed).select("answer_id"))
    assert len(seen) <= 5
    assert rows == sorted(map(tuple, RU.dedupe_submissions(answers).select("answer_id").collect()), key=repr)
    rows, seen = _progress_of(spark, lambda: ST.stream_smoothed_scores(spark, d, **landed))
    assert len(seen) <= 5
    want = RU.smoothed_scores(sessions, ["user_id", "category"], "interview_date", "id", "overall_score")
    assert rows == sorted(((r.user_id, r.category, r.smoothed_score, r.n) for r in want.collect()), key=repr)


def _two_files(spark, first, second):
    """Event rows (event_id, user_id, ts, event_type, value, props) as two files."""
    import time
    path = scratch_path(spark, "events-two")
    schema = S.table(spark, SF_SMALL, "events").schema
    for rows in (first, second):
        df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, event_type string, value double, props string")
        df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                    for f in schema.fields]).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def test_first_submissions_by_place_over_batches(spark):
    """Of equal times the null id comes first, as in the batch form; an older
    one of a later batch comes late; repeats and ties go nowhere; answers
    without a question are each kept."""
    t, k = "2024-01-10 10:00:00", '{"k": 1}'
    path = _two_files(spark, [(5, 1, t, "view", 1.0, k), (None, 1, t, "view", 2.0, k), (7, 2, t, "view", 3.0, k),
                              (8, 2, t, "view", 4.0, None), (9, 2, t, "view", 5.0, None)],
                      [(6, 2, "2024-01-10 09:00:00", "view", 6.0, k), (7, 2, t, "view", 9.0, k), (4, 3, t, "view", 7.0, k),
                       (None, 1, t, "view", 8.0, k), (10, 2, t, "view", 5.0, None)])
    first, late, main = ST.stream_dedupe(spark, SF_SMALL, parts_dir=path, with_main=True)
    scores = lambda df: sorted(r.score for r in df.collect())
    assert scores(main) == [2.0, 3.0, 4.0, 5.0, 5.0, 7.0]
    assert scores(late) == [6.0]
    assert scores(first) == [2.0, 4.0, 5.0, 5.0, 6.0, 7.0]


def test_a_failed_read_is_not_an_empty_result(spark):
    import pytest
    missing = scratch_path(spark, "nothing")
    assert ST._batches(spark, missing, "a bigint").count() == 0
    broken = scratch_path(spark, "broken")
    spark.range(3).select(F.col("id").cast("string").alias("a")).write.parquet(f"{broken}/_batch=0")
    with pytest.raises(Exception):
        ST._batches(spark, broken, "a array<int>").collect()


def _make_model():
    """A stand-in sentence model: a fixed random projection of byte counts."""
    rng = np.random.default_rng(0)
    proj = rng.standard_normal((256, 8)).astype(np.float32)

    def predict(texts: np.ndarray) -> np.ndarray:
        counts = np.zeros((len(texts), 256), dtype=np.float32)
        for i, t in enumerate(texts):
            b = np.frombuffer(str(t).encode("utf-8"), dtype=np.uint8)
            counts[i] = np.bincount(b, minlength=256)
        return counts @ proj
    return predict


def test_model_plugin_embeds_whole_table(spark):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests/
    d = S.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    emb = SC.model_embedder(_make_model, dim=8, batch_size=32)
    out = SC.embed_texts(d, "text", embedder=emb)
    rows = out.collect()
    assert len(rows) == d.count() and all(len(r.embedding) == 8 for r in rows)


def test_the_model_sees_new_texts_only(spark, tmp_path):
    """A vector store: each distinct text is embedded once over two runs."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    log, store = str(tmp_path / "calls"), scratch_path(spark, "vectors")

    def make():
        model = _make_model()

        def predict(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return model(texts)
        return predict

    emb = SC.model_embedder(make, dim=8, batch_size=4)
    run = lambda texts: {r.text: r.embedding for r in SC.embed_with_store(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").repartition(3), "text", store, emb).collect()}
    first = run(["a", "bb", "a", "ccc", None, "a"])
    assert sorted(open(log).read().split()) == ["a", "bb", "ccc"] and first[None] is None and len(first["a"]) == 8
    second = run(["bb", "dddd", "a"])
    assert sorted(open(log).read().split()) == ["a", "bb", "ccc", "dddd"]
    assert second["a"] == first["a"] and second["bb"] == first["bb"] and run(["a"]) == {"a": first["a"]}
    want = SC.embed_texts(spark.createDataFrame([("dddd",)], "text string"), "text", embedder=emb).first().embedding
    assert second["dddd"] == want


def test_hashed_vectors_default(spark):
    d = spark.createDataFrame([(1, "Data data science"), (2, "")], "doc_id bigint, text string")
    rows = {r.doc_id: r.embedding for r in SC.embed_texts(d, "text", dim=16).collect()}
    assert sum(rows[1]) == 3.0 and sum(rows[2]) == 0.0 and len(rows[1]) == 16


def test_model_scoring_of_an_answer_table(spark):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    bank = spark.createDataFrame([(7, "Spark joins tables"), (8, "")], "id bigint, ideal_answer string")
    ans = spark.createDataFrame([(1, 7, "Spark joins tables"), (2, 7, "  "), (3, 8, "x"), (4, 9, "y")],
                                "answer_id bigint, question_id bigint, user_answer string")
    emb = SC.model_embedder(_make_model, dim=8, batch_size=4)
    got = {r.answer_id: r.score for r in SC.score_answers_by_model(ans, bank, emb).collect()}
    assert got == {1: 100.0, 2: 0.0, 3: 0.0, 4: 0.0}
    hashed = {r.answer_id: r.score for r in SC.score_answers_by_model(ans, bank).collect()}
    assert hashed == {1: 100.0, 2: 0.0, 3: 0.0, 4: 0.0}
