"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic texts and unlabelled
text with the non-negative risk estimator: with class prior p,

    risk = p * R(positives as 1) + max(0, R(unlabelled as 0) - p * R(positives as 0))

Features are word beginnings of several lengths and whole words. A text's
value of a feature is its count over the square root of the number of words,
so a text's score is a bias plus the sum of its words' weights over that root:
one rare word counts in a short text, a dense one in a long text.

Training runs in one Spark task on a bounded, documented sample: so many texts
of either side, whatever their length. The sampled texts are counted where they
lie, and the task gets each one's distinct words. Scoring reads every whole
text, and a word's weight is looked up once per worker.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_POSITIVE = 2000       # confirmed toxic texts in training, at most
MAX_UNLABELLED = 4000     # unlabelled texts in training, at most
MAX_FEATURES = 20_000     # size of the trained model, at most
PREFIXES = (4, 5, 6, 7, 8)
MIN_Z = 3.5               # a feature must be this many deviations more frequent in positives
EPOCHS = 400
STEP = 0.05
DECAY = 1e-6
LENGTH_POWER = 0.5
CACHED_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")
_WORDS = _WORD.findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def word_counts(text: str) -> Counter:
    """How often each word stands in the text, without a list of all of them."""
    return Counter(m[0] for m in _WORD.finditer(text.lower()))


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in PREFIXES if len(word) >= k]]


def scale(n_words: int) -> float:
    return max(1, n_words) ** LENGTH_POWER


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of (feature, value) with products by column and row vectors."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.val, self.shape = row, col, val, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])


def fit_nnpu(pos: Sparse, unl: Sparse, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk. Where the
    unlabelled part of the risk is negative, the step raises it again."""
    n = pos.shape[1]
    w = np.zeros(n + 1)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, EPOCHS + 1):
        zp, zu = pos.dot(w[:n]) + w[n], unl.dot(w[:n]) + w[n]
        as_one, as_zero, u_zero = _sigmoid(zp) - 1.0, _sigmoid(zp), _sigmoid(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

        def grad(x: Sparse, r: np.ndarray) -> np.ndarray:
            return np.append(x.t_dot(r), r.sum()) / len(r)

        negative = grad(unl, u_zero) - prior * grad(pos, as_zero)
        g = prior * grad(pos, as_one) + negative if rest >= 0 else -negative
        g[:n] += DECAY * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:n], float(w[n])


def train(counted: Iterable[tuple[bool, list[str], list[int]]], prior: float) -> pd.DataFrame:
    """(feature, weight) of the classifier from each text's side, words and
    their counts; the feature "" is the bias."""
    ids: dict[str, int] = {}
    rows = [(p, np.array([ids.setdefault(w, len(ids)) for w in ws], np.int32), np.array(ks, np.int64))
            for p, ws, ks in counted]
    names = list(ids)
    n_pos = sum(p for p, _, _ in rows)
    n_unl = len(rows) - n_pos
    if not n_pos or not n_unl:
        # nothing to tell apart: every text gets the prior
        b = math.log(prior / (1 - prior)) if 0 < prior < 1 else -30.0
        return pd.DataFrame({"feature": [""], "weight": [b]})
    in_pos, in_unl = Counter(), Counter()
    for p, ws, _ in rows:
        if p:
            in_pos.update({f for w in ws for f in features(names[w])})
    often = {f for f, k in in_pos.items() if k >= 3}
    for p, ws, _ in rows:
        if not p:
            in_unl.update({f for w in ws for f in features(names[w]) if f in often})
    z = {}
    for f in often:
        share = (in_pos[f] + in_unl[f]) / len(rows)
        sd = math.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_unl)) + 1e-12
        z[f] = (in_pos[f] / n_pos - in_unl[f] / n_unl) / sd
    kept = sorted((f for f in z if z[f] >= MIN_Z), key=lambda f: (-z[f], f))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(kept)}

    def matrix(side: bool) -> Sparse:
        row, col, val, n = [], [], [], 0
        for p, ws, ks in rows:
            if p == side:
                root = scale(int(ks.sum()))
                for w, k in zip(ws, ks.tolist()):
                    for f in features(names[w]):
                        if f in index:
                            row.append(n)
                            col.append(index[f])
                            val.append(k / root)
                n += 1
        return Sparse(np.array(row, np.int64), np.array(col, np.int64), np.array(val, float), (n, len(kept)))

    w, b = fit_nnpu(matrix(True), matrix(False), prior)
    return pd.DataFrame({"feature": ["", *kept], "weight": [b, *w.tolist()]})


def fit(docs: DataFrame, positives: DataFrame, prior: float, id_col: str = "doc_id",
        text_col: str = "text", max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> dict[str, float]:
    """The model {feature: weight} from the texts named by ``positives`` (one
    column of ids) and texts of ``docs`` as unlabelled ones. At most
    ``max_positive`` and ``max_unlabelled`` of them, chosen by a hash of the
    id, are used, each one whole. Null texts and null ids teach nothing. Where
    positives are named and ``docs`` has texts, but none of a chosen positive,
    a ValueError is raised."""
    def chosen(ids: DataFrame, n: int, salt: int) -> DataFrame:
        return ids.where("id IS NOT NULL").orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n)

    known = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pos = chosen(positives.select(F.col(positives.columns[0]).alias("id")).distinct(), max_positive, 1)
    unl = chosen(known.select("id"), max_unlabelled, 2)
    picked = pos.select("id", F.lit(True).alias("positive")).unionByName(
        unl.select("id", F.lit(False).alias("positive")))
    sample = known.join(F.broadcast(picked), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column("text")):
                c = word_counts(t.as_py())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).slice(i, 1) for n in ("positive", "at", "id", "text_sha")),
                     pa.array([list(c)], pa.list_(pa.string())), pa.array([list(c.values())], pa.list_(pa.int64()))],
                    names=["positive", "at", "id", "text_sha", "words", "counts"])

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Counter()

        def rows() -> Iterator[tuple[bool, list[str], list[int]]]:
            for b in batches:
                for p, w, k in zip(*(b.column(n) for n in ("positive", "words", "counts"))):
                    sides[p.as_py()] += 1
                    yield p.as_py(), w.as_py(), k.as_py()

        got = train(rows(), prior)
        got["n_positive"], got["n_unlabelled"] = sides[True], sides[False]
        yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    id_type = sample.schema["id"].dataType.simpleString()
    counted = sample.select("positive", F.xxhash64("id").alias("at"), "id", F.sha2("text", 256).alias("text_sha"), "text").mapInArrow(
        count, f"positive boolean, at long, id {id_type}, text_sha string, words array<string>, counts array<long>")
    # a sorted single partition: the same sample in the same order on a rerun
    model = counted.repartition(1).sortWithinPartitions("positive", "at", "id", "text_sha")
    got = model.mapInArrow(
        one_task, "feature string, weight double, n_positive long, n_unlabelled long").collect()
    if got and got[0].n_unlabelled and not got[0].n_positive and not pos.isEmpty():
        raise ValueError("positives are named, but none of the chosen ones has a text to learn from")
    return {r.feature: r.weight for r in got}


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.bias, self.known = model, model.get("", -30.0), {}

    def score(self, text: str | None) -> float:
        """Probability of being toxic; a text without words has the bias alone."""
        ws = words(text or "")
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known, get = self.known, self.model.get
        for w in set(ws).difference(known):
            known[w] = sum(get(f, 0.0) for f in features(w))
        z = self.bias + sum(map(known.__getitem__, ws)) / scale(len(ws))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def score_rows(rows: DataFrame, model: dict[str, float], text_col: str = "text",
               columns: tuple[str, ...] | None = None) -> DataFrame:
    """The named columns of ``rows`` (all by default) plus toxic_score, 0 to 1.

    Null and empty texts are scored by the bias alone. A text of any length is
    read whole. A column named toxic_score is replaced. An empty table gives
    an empty result; a model without positives gives every text the prior.
    """
    names = [c for c in (columns if columns is not None else rows.columns) if c != "toxic_score"]
    src = rows.select(*names, rows[text_col].alias("_tox_text"))
    held = src.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(held.value)
        for b in batches:
            out = [s.score(t.as_py()) for t in b.column("_tox_text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
