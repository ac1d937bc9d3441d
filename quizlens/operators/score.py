"""Answer scoring: joining answers to the question bank, vector cosine, a
model-free term-count cosine, and text-to-vector as a table job.

Answers never meet ideals in a cross join: they always go through the
question id. The bank side is embedded (or counted) once per question, not
once per answer.
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.functions import text as TX
from quizlens.functions.rounding import py_round1
from quizlens.functions.vectors import similarity_score
from quizlens.session import BROADCAST_MAX_BYTES, small_side, spread, table_bytes, written


# --- J1 ---------------------------------------------------------------------------

def join_bank(answers: DataFrame, bank: DataFrame, on: str = "question_id",
              bank_key: str = "id", how: str = "left") -> DataFrame:
    """Bring question text and ideal answer to each answer. The bank is
    broadcast after its size is checked (it is 50 questions in practice);
    above the bound (in bytes) the join is a shuffle join."""
    b = bank.withColumnRenamed(bank_key, on) if bank_key != on else bank
    return answers.join(small_side(b), on, how)


# --- V1 ---------------------------------------------------------------------------

def vector_scores(answers: DataFrame, ideals: DataFrame, on: str, answer_vec: str = "embedding",
                  ideal_vec: str = "ideal_embedding") -> DataFrame:
    """V1: score = Python-rounded 100 x cosine of answer and ideal vectors;
    0.0 for a missing, empty or zero vector."""
    j = answers.join(small_side(ideals), on, "left")
    return j.withColumn("score", similarity_score(answer_vec, ideal_vec))


def ideal_vectors_by_min_key(vectors: DataFrame, group: str, key: str,
                             vec: str = "embedding") -> DataFrame:
    """Stand-in helper: the vector with the smallest key of each group is the
    group's ideal (min_by, partially aggregated)."""
    return vectors.groupBy(group).agg(
        F.min(key).alias("ideal_key"),
        F.min_by(vec, F.col(key)).alias("ideal_embedding"))


# --- V2 ---------------------------------------------------------------------------

def hashed_term_vectors(df: DataFrame, tokens_col: str, out: str = "embedding",
                        dim: int = 64) -> DataFrame:
    """V2 default: hashed term counts of a token array, as array<double>. A
    token's place is the number of its md5's first 8 hex digits modulo
    ``dim``, a rule any engine can repeat. Per row, no shuffle: on Arrow
    batches, of which each distinct token is hashed once and every token is
    counted once."""
    @F.arrow_udf("array<double>")
    def vectors(tokens: pa.Array) -> pa.Array:
        n = len(tokens)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        words = tokens.flatten().dictionary_encode()
        place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim if w is not None else 0
                          for w in words.dictionary.to_pylist()], dtype=np.int64)
        known = words.indices.is_valid().to_numpy(zero_copy_only=False)
        index = words.indices.fill_null(0).to_numpy(zero_copy_only=False)[known]
        counts = np.bincount(row[known] * dim + place[index], minlength=n * dim).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(counts))

    return df.withColumn(out, vectors(F.col(tokens_col)))


def model_embedder(make_predict_fn: Callable, dim: int, batch_size: int = 64):
    """V2 plug-in: a user's sentence model as an Arrow-batched pandas UDF.
    ``make_predict_fn`` is called once per Python worker and returns a
    function from a numpy array of strings to a (n, dim) float array."""
    from pyspark.ml.functions import predict_batch_udf
    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                             batch_size=batch_size)


def embed_texts(df: DataFrame, text_col: str, out: str = "embedding", dim: int = 64,
                embedder=None) -> DataFrame:
    """V2: text -> vector for a whole table. Default: clean, tokenise (native)
    and hash; with ``embedder`` (see ``model_embedder``) the model runs on
    Arrow batches."""
    if embedder is not None:
        return df.withColumn(out, embedder(F.col(text_col)))
    t = spread(df).withColumn("_tok", TX.tokenize(TX.clean_text(text_col)))
    return hashed_term_vectors(t, "_tok", out, dim).drop("_tok")


def embed_with_store(df: DataFrame, text_col: str, store: str, embedder, out: str = "embedding") -> DataFrame:
    """V2 with vectors kept by content: ``df`` plus its texts' vectors, of
    which the model computes only those that the store lacks.

    The store is a Parquet table (digest, vector) of distinct texts, read and
    appended to by digest (SHA-256). New texts are sorted by length over the
    tasks, so that a model batch holds texts of like length. A null text has a
    null vector. Two jobs that add the same text at a time store it twice;
    either vector is then used. A store belongs to one model."""
    spark = df.sparkSession
    digest = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    texts = df.where(F.col(text_col).isNotNull()).select(digest.alias("digest"), F.col(text_col).alias("_text")).distinct()
    schema = "digest binary, vector array<float>"
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder):
        texts = texts.join(spark.read.schema(schema).parquet(store).select("digest"), "digest", "left_anti")
    new = written(texts, "new-texts")
    if not new.isEmpty():
        tasks = max(1, spark.sparkContext.defaultParallelism)
        (new.repartitionByRange(tasks, F.length("_text"), "digest").sortWithinPartitions(F.length("_text"))
         .select("digest", embedder(F.col("_text")).cast("array<float>").alias("vector")).write.mode("append").parquet(store))
    vectors = spark.read.schema(schema).parquet(store) if fs.exists(folder) else spark.createDataFrame([], schema)
    vectors = vectors.dropDuplicates(["digest"]).select("digest", F.col("vector").alias(out))
    return df.withColumn("_digest", digest).join(
        vectors.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


# --- V3 ---------------------------------------------------------------------------

def _term_counts(df: DataFrame, keys: list[str], text_col: str, side: str) -> DataFrame:
    tok = spread(df).select(*keys, F.explode(TX.tokenize(TX.clean_text(text_col))).alias("token"))
    return tok.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias(side))


def _cosine_from_sums(dot_, na, nb):
    ok = (na > 0) & (nb > 0)
    return F.when(ok, dot_ / (F.sqrt(na.cast("double")) * F.sqrt(nb.cast("double")))).otherwise(0.0)


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def text_cosine(pairs: DataFrame, keys: list[str], a_col: str, b_col: str,
                out: str = "score") -> DataFrame:
    """V3: model-free similarity of two texts per row: cosine of their term
    counts (clean + tokenise), x100, Python-rounded.

    A pair's two token lists are marked and exploded together, so the pairs
    are read once, and counted in one partially-aggregated group-by; the
    per-pair sums are a second, small group-by. A pair without any token
    stays as a null token that counts nothing.
    """
    mark = lambda col, a, b: F.transform(
        TX.tokenize(TX.clean_text(col)),
        lambda t: F.struct(t.alias("token"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    both = spread(pairs).select(*keys, F.explode_outer(F.concat(mark(a_col, 1, 0), mark(b_col, 0, 1))).alias("t"))
    counts = both.groupBy(*keys, F.col("t.token").alias("token")).agg(
        F.coalesce(F.sum("t.a"), F.lit(0)).alias("ca"), F.coalesce(F.sum("t.b"), F.lit(0)).alias("cb"))
    sums = counts.groupBy(*keys).agg(
        F.sum(F.col("ca") * F.col("cb")).alias("dot"),
        F.sum(F.col("ca") * F.col("ca")).alias("na"),
        F.sum(F.col("cb") * F.col("cb")).alias("nb"))
    return sums.select(*keys, py_round1(_cosine_from_sums(
        F.col("dot"), F.col("na"), F.col("nb")) * 100.0).alias(out))


# --- V4 ---------------------------------------------------------------------------

def bank_term_counts(bank: DataFrame, question="question_id", bank_key="id",
                     ideal_text: str = "ideal_answer", mark: bool = True) -> tuple[DataFrame, DataFrame]:
    """The bank counted once: (question, token, cb) and (question, nb), both
    written once and, unless ``mark`` is false, marked for broadcast where
    their measured bytes allow it; every later batch reads them as they are."""
    q = _keys(question)
    b = bank.select(*[F.col(k).alias(n) for k, n in zip(_keys(bank_key), q)], F.col(ideal_text).alias("_ideal"))
    counts = written(_term_counts(b, q, "_ideal", "cb"), "bank-counts")
    norms = written(counts.groupBy(*q).agg(F.sum(F.col("cb") * F.col("cb")).alias("nb")), "bank-norms")
    return tuple(small_side(x, is_written=True) for x in (counts, norms)) if mark else (counts, norms)


def bank_for(answers: DataFrame, counts: DataFrame, norms: DataFrame, question="question_id") -> tuple[DataFrame, DataFrame]:
    """The counted bank as a batch of answers needs it: a side that is too
    large to be broadcast is first cut to the batch's questions (told by the
    first part of their key), whose ids are broadcast where their measured
    bytes allow it, so that a batch does not shuffle the whole bank."""
    q = _keys(question)[0]
    if table_bytes(counts) <= BROADCAST_MAX_BYTES:
        return F.broadcast(counts), F.broadcast(norms)
    asked = written(answers.select(q).distinct(), "asked")
    if table_bytes(asked) > BROADCAST_MAX_BYTES:
        return counts, norms
    return tuple(x.join(F.broadcast(asked), q, "left_semi") for x in (counts, norms))


def score_against_counts(answers: DataFrame, bank_counts: DataFrame, bank_norm: DataFrame,
                         answer_key="answer_id", question="question_id",
                         answer_text: str = "user_answer", out: str = "score") -> DataFrame:
    """(answer key, question, score): term-count cosine of each answer against
    its question's counted ideal answer. Answer tokens are counted under their
    answer and question, joined to the bank's counts on (question, token) and
    summed per answer: the answers are read once and not joined back."""
    a, q = _keys(answer_key), _keys(question)
    keys = [*a, *[c for c in q if c not in a]]
    tokens = spread(answers).select(
        *keys, F.explode_outer(TX.tokenize(TX.clean_text(answer_text))).alias("token"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("token").alias("ca"))
    sums = (counts.join(bank_counts, [*q, "token"], "left").groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("ca") * F.col("cb"), F.lit(0))).alias("dot"),
        F.sum(F.col("ca") * F.col("ca")).alias("na")))
    score = py_round1(_cosine_from_sums(F.col("dot"), F.col("na"), F.coalesce("nb", F.lit(0))) * 100.0)
    return sums.join(bank_norm, q, "left").select(*keys, score.alias(out))


def score_answers(answers: DataFrame, bank: DataFrame, answer_key="answer_id",
                  question="question_id", answer_text: str = "user_answer",
                  bank_key="id", ideal_text: str = "ideal_answer",
                  out: str = "score") -> DataFrame:
    """V4: score a whole answer table against the bank by term-count cosine;
    empty answers and answers to unknown questions score 0.0. The bank is
    counted once per question, not once per answer. Keys may be lists."""
    counts, norms = bank_term_counts(bank, question, bank_key, ideal_text)
    return score_against_counts(answers, counts, norms, answer_key, question, answer_text, out)


def score_answers_by_model(answers: DataFrame, bank: DataFrame, embedder=None, dim: int = 64,
                           answer_key: str = "answer_id", question: str = "question_id",
                           answer_text: str = "user_answer", bank_key: str = "id",
                           ideal_text: str = "ideal_answer", out: str = "score") -> DataFrame:
    """V1 + V2 + V4 as the source scores: embed the answer and the ideal
    answer, score = Python-rounded 100 x cosine; a blank answer or ideal
    scores 0.0. The bank is embedded once and written once, then
    joined to every answer by question id after a size check."""
    b = bank.select(F.col(bank_key).alias(question), F.col(ideal_text).alias("_ideal"))
    ideals = written(embed_texts(b, "_ideal", "ideal_embedding", dim, embedder)
                     .select(question, "_ideal", "ideal_embedding"), "ideals")
    a = embed_texts(answers, answer_text, "embedding", dim, embedder)
    j = a.join(small_side(ideals, is_written=True), question, "left")
    blank = TX.is_blank(answer_text) | TX.is_blank("_ideal")
    score = F.when(blank, F.lit(0.0)).otherwise(similarity_score("embedding", "ideal_embedding"))
    return j.withColumn(out, score).drop("embedding", "ideal_embedding", "_ideal")
