"""Structured Streaming forms of scoring and roll-ups.

Submissions arrive one at a time in the source application; at scale that is
a stream. Each job here reads a file stream, runs to the end of the data
available (``availableNow``) with its checkpoint in the shared folder, and
writes one folder per micro-batch, overwritten if the batch is retried, so
the output is exactly-once. Results are read back as the latest row per key.

Files may arrive in any order. What depends on order (the smoothed score, the
first submission) is kept in the keyed state of Spark's streaming aggregates (on
the RocksDB state store), so a micro-batch reads the state of its own keys and
nothing written before it; an older row that arrives late is put in its place.
Nothing is dropped behind a watermark, and no row passes through Python.

A job that changes a key again and again (ST2, ST3) writes the changed keys of
each micro-batch, and every COMPACT_EVERY batches one table of the latest rows,
so that reading the result does not grow with the age of the stream.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.functions.rounding import UNITS, py_round1, units
from quizlens.operators import rollup as RU
from quizlens.operators import score as SC
from quizlens.session import scratch_path
from quizlens.sources import standins as S

COMPACT_EVERY = 16
# RocksDB, whose micro-batches write what changed and not the whole store
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
FIRST = -(1 << 63)        # a null time or id comes before every other


def read_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1,
                parts_dir: str | None = None) -> DataFrame:
    """A file stream over one table of a folder of parquet tables, or over
    ``parts_dir`` holding the table's files (one micro-batch per file)."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if parts_dir is not None:
        return r.parquet(parts_dir)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def land_out_of_order(spark: SparkSession, sf_dir: str, name: str, order: str, parts: int = 4) -> str:
    """Stand-in for a landing folder: the whole table in ``parts`` ranges of a
    column, written one after another, the last range first."""
    t = S.table(spark, sf_dir, name)
    n = F.col(order) if t.schema[order].dataType.typeName() == "long" else F.unix_micros(F.col(order).cast("timestamp"))
    lo, hi = t.agg(F.min(n), F.max(n)).first()
    path = scratch_path(spark, f"{name}-landing")
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // parts))
    for k in reversed(range(parts)):
        part = F.floor((n - F.lit(lo or 0)) / F.lit(width)) == k
        rows = t.where(part if k else part | n.isNull())
        rows.write.mode("append").parquet(path)
    return path


def files_of_a_range(spark: SparkSession, path: str, parts: int = 4) -> int:
    """Files that one of ``parts`` ranges landed as: a micro-batch of so many
    is about one range, whatever number of tasks wrote it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(folder))
    return max(1, -(-files // parts))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all micro-batches written to ``path`` (with ``_batch``); an
    empty table where no batch has written. A failed read raises."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, _batch int")
    return spark.read.schema(f"{schema}, _batch int").parquet(path)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row per key over micro-batches (max_by the batch id)."""
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_batch")).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the complete folders ``<prefix>=<number>``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    done = [n for n in names if n.startswith(f"{prefix}=")
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


class Latest:
    """The latest row per key of a changing table: folders of micro-batches
    and, every ``every`` batches, one of all keys as they were then. Each is
    written with overwrite, so a retried batch replaces its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], every: int = COMPACT_EVERY):
        self.spark, self.path, self.schema, self.keys, self.every = spark, path, schema, keys, every

    def _folder(self, kind: str, number: int) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}={number}")
        return rows.withColumn("_batch", F.lit(number))

    def read(self, upto: int | None = None) -> DataFrame:
        """The rows as of batch ``upto`` (the last)."""
        within = [n for n in _numbers(self.spark, self.path, "batch") if upto is None or n <= upto]
        base = [n for n in _numbers(self.spark, self.path, "all") if upto is None or n < upto][-1:]
        parts = [self._folder("all", n) for n in base] + [self._folder("batch", n) for n in within if not base or n > base[0]]
        rows = parts[0] if parts else self.spark.createDataFrame([], f"{self.schema}, _batch int")
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return _latest(rows, self.keys)

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if (number + 1) % self.every == 0:
            self.read(number).write.mode("overwrite").parquet(f"{self.path}/all={number}")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store of a query is the one set when it starts."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _micros(col) -> F.Column:
    """A time as micro-seconds, in the same order; null first."""
    return F.coalesce(F.unix_micros(F.col(col).cast("timestamp")), F.lit(FIRST))


def _run(df: DataFrame, name: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a streaming query to the end of the available data."""
    q = (df.writeStream.foreachBatch(sink).outputMode(mode)
         .option("checkpointLocation", scratch_path(df.sparkSession, f"{name}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")


# --- ST1 --------------------------------------------------------------------------

def stream_vector_scores(spark: SparkSession, sf_dir: str,
                         parts_dir: str | None = None, max_files: int = 1) -> DataFrame:
    """ST1: score vectors as they arrive against a static bank of ideal
    vectors, written and measured once (stateless)."""
    ideals = SC.ideal_vectors_by_min_key(S.vectors(spark, sf_dir), "label", "vec_id")
    stream = read_stream(spark, sf_dir, "embeddings", max_files, parts_dir)
    scored = SC.vector_scores(stream, ideals, "label") \
               .where(F.col("vec_id") != F.col("ideal_key")).select("vec_id", "label", "score")
    out = scratch_path(spark, "st1-out")
    _run(scored, "st1", lambda batch, i: _write(batch, out, i))
    return _batches(spark, out, "vec_id bigint, label int, score double").drop("_batch")


def stream_text_scores(spark: SparkSession, sf_dir: str,
                       parts_dir: str | None = None, max_files: int = 1) -> DataFrame:
    """ST1 for text answers: user turns of ``conversations`` arrive as a
    stream and are scored against the assistant turn right after them by
    term-count cosine. The bank (every assistant turn) is counted and written
    once; each micro-batch is scored by the batch operator against the counts
    of its own questions."""
    _, bank = S.turn_answers(spark, sf_dir)
    question = ["conv_id", "question_turn"]
    counts, norms = SC.bank_term_counts(bank, question, ["conv_id", "turn"], mark=False)
    answers = read_stream(spark, sf_dir, "conversations", max_files, parts_dir) \
        .where(F.col("role") == "user").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("question_turn"), F.col("text").alias("user_answer"))
    out = scratch_path(spark, "st1-text-out")

    def sink(batch: DataFrame, batch_id: int) -> None:
        scored = SC.score_against_counts(batch, *SC.bank_for(batch, counts, norms, question), ["conv_id", "turn"], question)
        _write(scored.select("conv_id", "turn", "score"), out, batch_id)

    _run(answers, "st1-text", sink)
    return _batches(spark, out, "conv_id bigint, turn bigint, score double").drop("_batch")


# --- ST2 --------------------------------------------------------------------------

def stream_user_stats(spark: SparkSession, sf_dir: str,
                      parts_dir: str | None = None, max_files: int = 1) -> DataFrame:
    """ST2: running per-user totals, average and best (update mode)."""
    s = read_stream(spark, sf_dir, "events", max_files, parts_dir).select(
        "user_id", F.col("value").alias("overall_score"))
    agg = s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_interviews"),
        F.sum(units("overall_score")).alias("unit_sum"),
        F.count("overall_score").alias("n_scored"),
        F.max("overall_score").alias("best"))
    out = Latest(spark, scratch_path(spark, "st2-out"),
                 "user_id bigint, total_interviews bigint, unit_sum bigint, n_scored bigint, best double", ["user_id"])
    _run(agg, "st2", out.write, mode="update")
    return out.read().select(
        "user_id", "total_interviews",
        F.coalesce(py_round1(F.col("unit_sum") / (F.col("n_scored") * float(UNITS))),
                   F.lit(0.0)).alias("avg_score"),
        F.coalesce(py_round1("best"), F.lit(0.0)).alias("best_score"))


# --- ST3 --------------------------------------------------------------------------

def stream_smoothed_scores(spark: SparkSession, sf_dir: str,
                           parts_dir: str | None = None, max_files: int = 1) -> DataFrame:
    """ST3: the smoothed per-category score kept up to date, equal to the
    batch fold whatever the order of arrival. The state of a (user, category)
    is its scores with their places; a micro-batch adds to the states of its
    own keys and folds each in order, all in Spark's own aggregate."""
    s = read_stream(spark, sf_dir, "events", max_files, parts_dir).select(
        "user_id", F.col("event_type").alias("category"), _micros("ts").alias("at"),
        F.coalesce("event_id", F.lit(FIRST)).alias("id"), F.col("value").cast("double").alias("x"))
    scored = F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.struct("at", "id", "x"))
    kept = "user_id bigint, category string, smoothed_score double, n bigint"
    out = Latest(spark, scratch_path(spark, "st3-out"), kept, ["user_id", "category"])
    held = s.groupBy("user_id", "category").agg(F.collect_list(scored).alias("items"), F.count(F.lit(1)).alias("n"))
    scores = held.withColumn("items", F.sort_array("items")).select(
        "user_id", "category", F.when(F.size("items") > 0, RU.fold(F.col("items"))).alias("smoothed_score"), "n")
    with _rocksdb(spark):
        _run(scores, "st3", out.write, mode="update")
    return out.read()


# --- ST4 --------------------------------------------------------------------------

ANSWER = ("answer_id bigint, session_id bigint, user_id bigint, question_id bigint, user_answer string, "
          "score double, answered_at timestamp_ntz, category string")


def stream_dedupe(spark: SparkSession, sf_dir: str, delay: str = "1 day",
                  parts_dir: str | None = None, with_late: bool = False, with_main: bool = False,
                  max_files: int = 1):
    """ST4: the first submission of each (session, question); answers without
    a question are each kept.

    The state of a key is its earliest submission, the micro-batch that
    brought it and the first and last micro-batch of the key, each told by its
    time. Of a batch, the earliest is passed on if it is the key's first or
    earlier than all before; the rest are repeats. Answers without a question
    leave no state.

    A submission that is its key's first goes to the main output, which has
    one row per key over all batches. The side output has what came late: rows
    older than the newest time seen before their batch by more than ``delay``,
    and rows that are earlier than one already passed on. The result is the
    earliest of both and equals the batch form; ``with_late`` also returns the
    side output, ``with_main`` the main one too."""
    a = S.answers_of(read_stream(spark, sf_dir, "events", max_files, parts_dir))
    columns = [c.split()[0] for c in ANSWER.split(", ")]
    rest = [c for c in columns if c not in ("answered_at", "session_id", "question_id")]
    stream = a.select(*rest, "session_id", "question_id", _micros("answered_at").alias("at"),
                      F.coalesce("answer_id", F.lit(FIRST)).alias("id"),
                      F.unix_micros(F.current_timestamp()).alias("batch"))
    place = F.struct("at", "id", "batch", *rest)
    keyed = stream.where("question_id IS NOT NULL").groupBy("session_id", "question_id").agg(
        F.min(place).alias("own"), F.max("at").alias("newest"), F.min("batch").alias("began"), F.max("batch").alias("now"))
    free = stream.where("question_id IS NULL").select(
        "session_id", "question_id", place.alias("own"), F.col("at").alias("newest"),
        F.col("batch").alias("began"), F.col("batch").alias("now"))
    main, side, newest = (scratch_path(spark, f"st4-{x}") for x in ("out", "late", "newest"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the batch comes from the state store: once, for all uses
        passed = scratch_path(spark, "st4-batch")
        batch.write.parquet(passed)
        rows = spark.read.schema(batch.schema).parquet(passed)
        seen, before = None, [n for n in _numbers(spark, newest, "_batch") if n < batch_id]
        if before:
            seen = spark.read.schema("newest bigint").parquet(f"{newest}/_batch={before[-1]}").first()[0]
        now = [x for x in (seen, rows.agg(F.max("newest")).first()[0]) if x is not None]
        spark.createDataFrame([(max(now, default=None),)], "newest bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{newest}/_batch={batch_id}")
        kept = rows.where("own.batch = now").select("session_id", "question_id", "own.*", (F.col("began") == F.col("now")).alias("is_first"))
        kept = kept.withColumn("answered_at", F.when(
            F.col("at") != FIRST, F.timestamp_micros("at").cast("timestamp_ntz")))
        bound = F.lit(None) if seen is None else F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {delay}")
        late = ~F.col("is_first") | F.coalesce((F.col("at") != FIRST) & (F.timestamp_micros("at") < bound), F.lit(False))
        # a key has one row; of answers without a question, those of one id are one
        once = kept.where("question_id IS NOT NULL").unionByName(
            RU.dedupe_submissions(kept.where("question_id IS NULL")))
        _write(once.where(~late).select(*columns), main, batch_id)
        _write(once.where(late).select(*columns), side, batch_id)

    with _rocksdb(spark):
        _run(keyed.unionByName(free), "st4", sink, mode="update")
    on_time, late = (_batches(spark, x, ANSWER).drop("_batch") for x in (main, side))
    first = RU.dedupe_submissions(on_time.unionByName(late))
    return (first, late, on_time) if with_main else (first, late) if with_late else first
