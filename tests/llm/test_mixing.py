import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quizlens.llm import mixing as MX

SCHEMA = "doc_id long, source string, text string"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Water filling by hand: cap, deal the rest again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, full = {}, share * sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        level = rest / sum(w[s] for s in left) if left else 0
        over = {s for s in left if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in left}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        full |= over


def corpus(seed, n=1500):
    rnd = random.Random(seed)
    names = ["hot"] * 5 + ["b", "a", "é", "Z", "z1", "😀", "\uffff", None, "tiny"]
    return [(i, rnd.choice(names), " ".join("w" * rnd.choice([0, 1, 5, 30, 30, 30, 200]))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(frame, seed):
    rows = corpus(seed)
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(t.split())
    df = MX.mix(frame(rows, SCHEMA, 6), "doc_id", "source", MX.n_words("text"))
    got = df.collect()
    want = targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r._mx_size == len(r.text.split()) and r._mx_source_size == size[r.source]
        assert r._mx_target == pytest.approx(want[r.source])
        assert r._mx_copies in (0, 1, 2)
        taken[r.source] += r._mx_copies * r._mx_size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * 200
    again = MX.mix(frame(rows, SCHEMA, 2), "doc_id", "source", MX.n_words("text"))
    assert {(r.doc_id, r._mx_copies) for r in again.collect()} == {(r.doc_id, r._mx_copies) for r in got}


def test_mixed_rows_repeat_documents(frame):
    rows = corpus(3, 300)
    df = frame(rows, SCHEMA)
    copies = {r.doc_id: r._mx_copies for r in MX.mix(df, "doc_id", "source", MX.n_words("text")).collect()}
    out = MX.mixed_rows(df)
    assert out.columns == df.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r.doc_id] += 1
    assert n == {i: c for i, c in copies.items() if c}


def test_words_are_ascii_space_separated(frame):
    rows = [(1, "a", "x\ty\x0bz\x1cq\u00a0r  \n"), (2, "a", None), (3, "a", ""), (4, "a", " \r\n")]
    got = {r.doc_id: r.n for r in frame(rows, "doc_id long, source string, text string").select(
        "doc_id", MX.n_words("text").alias("n")).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 0}


def test_edges(frame, empty):
    assert MX.mixed_rows(empty()).count() == 0
    rows = [(1, "no words", None, 5), (2, "no words", "", 5), (3, None, "one two", 5), (None, None, "one two", 5),
            (4, "x", "w " * 50_000, 5), (4, "x", "w " * 50_000, 5)]
    df = MX.mix(frame(rows, "doc_id long, source string, text string, size long"), "doc_id", "source", MX.n_words("text"))
    got = df.collect()
    assert len(got) == 6 and "size" in df.columns
    assert all(r._mx_copies == 0 and r._mx_target == 0 for r in got if r.source == "no words")
    assert MX.mix(empty(), "doc_id", "source", F.lit(1)).count() == 0


def test_main_path_is_native(frame):
    plan = MX.mixed_rows(frame(corpus(1, 20), SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_clashing_columns(frame):
    names = sorted(MX.ADDED) + ["_mx_size", "_mx_i", "c0"]
    rows = frame([(i, "s", "w w", *[k for k, _ in enumerate(names)]) for i in range(20)],
                 SCHEMA + "".join(f", {c} int" for c in names))
    got = MX.mixed_rows(rows)
    assert got.columns == rows.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(names)))}
    with pytest.raises(ValueError):
        MX.mix(rows, "doc_id", "source", MX.n_words("text"))
