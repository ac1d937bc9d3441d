import random

import numpy as np
import pytest

from quizlens.llm import toxicity as TX

SCHEMA = "doc_id long, text string, toxic_score string"
BAD = ["vileword", "nastything", "grimstem"]


def corpus(seed, n, share=0.15):
    rnd = random.Random(seed)
    rows, toxic = [], set()
    for i in range(n):
        w = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 6))) for _ in range(rnd.choice([8, 60, 300]))]
        if rnd.random() < share:
            toxic.add(i)
            for k in range(0, len(w), 25):
                w[k] = rnd.choice(BAD) + rnd.choice(["", "xa", "yo"])
        rows.append((i, " ".join(w), "x"))
    return rows, toxic


def model_of(frame, rows, toxic, **kw):
    docs = frame(rows, SCHEMA)
    return TX.fit(docs, frame([(i,) for i in sorted(toxic)], "doc_id long"), 0.15, **kw)


def test_finds_held_out_toxic_texts(frame):
    rows, toxic = corpus(1, 600)
    rnd = random.Random(2)
    known = {i for i in toxic if rnd.random() < 0.6}       # the rest hides among the unlabelled
    model = model_of(frame, rows, known)
    assert len(model) <= TX.MAX_FEATURES + 1
    test, bad = corpus(7, 400)
    got = {r.doc_id: r.toxic_score for r in TX.score_rows(frame(test, SCHEMA), model).collect()}
    found = {i for i, s in got.items() if s >= 0.5}
    assert len(found & bad) >= 0.95 * len(bad) and len(found - bad) <= 0.03 * len(found)
    assert all(0 <= s <= 1 for s in got.values())


def test_same_model_on_a_rerun(frame):
    rows, toxic = corpus(3, 150)
    assert model_of(frame, rows, toxic) == model_of(frame, rows[::-1], toxic)


def test_risk_is_kept_non_negative():
    """The prior-corrected risk of the unlabelled part does not run below
    zero: without the correction a flexible model would call every unlabelled
    text clean."""
    n, hidden = 200, 60
    pos = TX.Sparse(np.arange(n), np.zeros(n, int), np.ones(n), (n, 2))
    col = np.r_[np.zeros(hidden, int), np.ones(n - hidden, int)]
    unl = TX.Sparse(np.arange(n), col, np.ones(n), (n, 2))
    w, b = TX.fit_nnpu(pos, unl, hidden / n)
    assert w[0] + b > 0 > w[1] + b


def test_sparse_products():
    rng = np.random.default_rng(1)
    dense = rng.random((6, 4)) * (rng.random((6, 4)) < 0.5)
    r, c = np.nonzero(dense)
    s = TX.Sparse(r, c, dense[r, c], dense.shape)
    w, v = rng.random(4), rng.random(6)
    assert np.allclose(s.dot(w), dense @ w) and np.allclose(s.t_dot(v), dense.T @ v)


def test_edges(frame, empty):
    assert TX.score_rows(empty(SCHEMA), {"": 0.0}).count() == 0
    nothing = TX.fit(empty(SCHEMA), empty("doc_id long"), 0.1)
    assert set(nothing) <= {""}
    rows, toxic = corpus(4, 200)
    model = model_of(frame, rows + [(None, "vileword", "x"), (900, None, "x")], toxic | {900})
    odd = [(1, None, "x"), (2, "", "x"), (3, "vileword " * 50_000, "x"), (3, "abc " * 50_000, "x"), (3, "abc " * 50_000, "x"),
           (None, "vileword", "x")]
    df = TX.score_rows(frame(odd, SCHEMA), model)
    assert df.columns == ["doc_id", "text", "toxic_score"]
    got = sorted((r.doc_id or 0, len(r.text or ""), r.toxic_score) for r in df.collect())
    assert len(got) == 6
    s = {(i, n): v for i, n, v in got}
    assert s[1, 0] == s[2, 0] < 0.5 < s[3, 450_000] and s[0, 8] > 0.5 > s[3, 200_000]


@pytest.mark.parametrize("prior", [0.0, 0.3, 1.0])
def test_no_positives_give_the_prior(frame, prior):
    model = TX.fit(frame([(1, "a b", "x")], SCHEMA), frame([], "doc_id long"), prior)
    score = TX.Scorer(model).score("a b")
    assert score == pytest.approx(prior if 0 < prior < 1 else 0.0, abs=1e-6)


def test_long_unlabelled_text_displaces_nothing(frame):
    """One unlabelled text of 44 million characters beside short positives."""
    from pyspark.sql import functions as F
    rows, toxic = corpus(5, 300)
    long_one = frame([(10_000, "", "x")], SCHEMA).withColumn("text", F.expr("repeat('abcd efghab ', 3666667)"))
    docs = frame(rows, SCHEMA).unionByName(long_one)
    positives = frame([(i,) for i in sorted(toxic)], "doc_id long")
    model = TX.fit(docs, positives, 0.15)
    score = TX.Scorer(model).score
    assert score("vileword nastything") > 0.5 > score("abcd efghab")


def test_positives_without_texts_are_an_error(frame):
    rows, _ = corpus(6, 30)
    with pytest.raises(ValueError, match="none of the chosen"):
        TX.fit(frame(rows, SCHEMA), frame([(5000,)], "doc_id long"), 0.15)


def plain_risk(w, pos, unl, prior, part):
    """The class-prior-corrected risk on dense rows, or its parts."""
    loss = lambda z: np.log1p(np.exp(z))
    zp, zu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
    rest = loss(zu).mean() - prior * loss(zp).mean()
    return rest if part == "rest" else prior * loss(-zp).mean() + rest


@pytest.mark.parametrize("prior", [0.1, 0.4, 0.9])
def test_training_follows_the_numeric_gradient_of_the_risk(monkeypatch, prior):
    """A plain Adam on numeric gradients of the non-negative risk, dense."""
    monkeypatch.setattr(TX, "EPOCHS", 40)
    rng = np.random.default_rng(int(prior * 10))
    pos, unl = (rng.random((n, 5)) * (rng.random((n, 5)) < 0.6) for n in (12, 30))
    pos[:, 0] += 1.5
    sparse = lambda d: TX.Sparse(*np.nonzero(d), d[np.nonzero(d)], d.shape)
    got_w, got_b = TX.fit_nnpu(sparse(pos), sparse(unl), prior)
    w, m, v, eps = np.zeros(6), np.zeros(6), np.zeros(6), 1e-6
    turned = 0
    for t in range(1, 41):
        rest = plain_risk(w, pos, unl, prior, "rest")
        part, sign = ("all", 1.0) if rest >= 0 else ("rest", -1.0)
        turned += rest < 0
        g = sign * np.array([(plain_risk(w + d, pos, unl, prior, part) - plain_risk(w - d, pos, unl, prior, part)) / (2 * eps)
                             for d in eps * np.eye(6)])
        g[:5] += TX.DECAY * w[:5]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= TX.STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose([*got_w, got_b], w, atol=2e-3)
    assert turned > 0 or prior < 0.9


def test_scores_equal_a_plain_sum_over_words(spark, frame):
    """Every document, word by word, from the model's weights alone."""
    import math
    import re
    rows, toxic = corpus(8, 200)
    model = model_of(frame, rows, toxic)
    docs = [(r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000 + i, t, "x") for i, t, _ in rows]
    got = {r.doc_id: r.toxic_score for r in TX.score_rows(frame(docs, SCHEMA), model, columns=("doc_id",)).collect()}
    for i, text, _ in docs:
        ws = re.findall(r"[^\W\d_]+", text.lower())
        z = sum(model.get("=" + w, 0.0) + sum(model.get(w[:k], 0.0) for k in (4, 5, 6, 7, 8) if len(w) >= k) for w in ws)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model[""] + z / math.sqrt(max(1, len(ws)))))), abs=1e-9)
