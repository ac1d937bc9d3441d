import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlens.llm import vptree as VP

SCHEMA = "vec_id long, embedding array<float>, label int"
QUERY = "id % 5 = 0"


def vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(x) for x in v[i]], 0) for i in range(n)]


def brute(rows, k, q=5):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[(i, tuple(v))] = np.array(v, dtype=np.float64)
    out = set()
    for (i, iv), x in ok.items():
        if i % q == 0:
            s = sorted((-VP.cosine(x[None], y[None])[0], j) for (j, jv), y in ok.items() if j != i and len(jv) == len(iv))
            out |= {(i, r + 1, j, -c) for r, (c, j) in enumerate(s[:k])}
    return out


def got(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("n,shard", [(30, 8192), (700, 128), (700, 8192)])
def test_factor_one_is_exact(frame, n, shard):
    rows = vectors(n, n)
    df = VP.nearest(frame(rows, SCHEMA, 4), QUERY, shard_rows=shard)
    assert got(df) == brute(rows, 5)


def test_larger_factor_keeps_recall(frame):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    rows = [(i, [float(x) for x in v[i].astype(np.float32)], 0) for i in range(3000)]
    exact = {x[:1] + x[2:3] for x in brute(rows, 5, 50)}
    near = {x[:1] + x[2:3] for x in got(VP.nearest(frame(rows, SCHEMA), F.col("id") % 50 == 0, factor=2.0))}
    assert len(near & exact) >= 0.9 * len(exact)


def test_pruning_skips_leaves(monkeypatch):
    """On clustered vectors the tree scans far fewer vectors than there are."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    unit = VP._unit(centres[rng.integers(0, 40, 8000)] + 0.02 * rng.normal(size=(8000, 8)))
    tree = VP.Tree(unit)
    seen = []
    monkeypatch.setattr(VP, "chord", lambda c, f=VP.chord: (seen.append(c.size), f(c))[1])
    place, _ = tree.search(unit[:50], 3, 1.0)
    assert sum(seen) < 0.35 * 50 * 8000
    want = np.sort(np.argsort(-(unit[:50] @ unit.T), axis=1)[:, :3], axis=1)
    assert (np.sort(place, axis=1) == want).all()


def test_ties_and_copies(frame):
    """A third of the rows are one vector, more than a leaf holds."""
    rows = vectors(3, 900, 4)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, 0) for i, v, _ in rows]
    random.Random(1).shuffle(rows)
    assert got(VP.nearest(frame(rows, SCHEMA), QUERY, shard_rows=200)) == brute(rows, 5)


def test_edges(frame, empty):
    assert VP.nearest(empty(SCHEMA), QUERY).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (6, [], 1),
            (5, [1.0, None], 1), (None, [1.0, 1.0], 1), (10, [1.0, 1.0, 1.0], 1), (11, [2.0, 2.0, 2.0], 1),
            (12, [3.0, 0.0], 1), (12, [3.0, 0.0], 1), (13, [-1.0, 0.0], 1), (15, [0.0, 1.0], 1)]
    df = frame(rows, "vec_id long, embedding array<float>, rank int")
    assert got(VP.nearest(df, QUERY)) == {
        (0, 1, 12, 1.0), (0, 2, 15, 0.0), (0, 3, 13, -1.0), (10, 1, 11, 1.0),
        (15, 1, 0, 0.0), (15, 2, 12, 0.0), (15, 3, 13, 0.0)}


@pytest.mark.parametrize("shard", [8, 8192])
def test_all_ties_go_by_id(frame, shard):
    """Fifty positive multiples of one vector, in any shard, beside others."""
    base = np.array([0.3, -1.2, 0.7, 2.0])
    rows = [(i, [float(x) for x in base * 2.0 ** (i % 20 - 10)], 0) for i in range(50)] + [
        (100 + i, [1.0, float(i), 0.0, 0.0], 0) for i in range(20)]
    df = VP.nearest(frame(rows, "vec_id long, embedding array<double>, label int"), QUERY, shard_rows=shard)
    assert got(df) == brute(rows, 5)
    assert {(q, v) for q, _, v, _ in got(df) if q == 10} == {(10, v) for v in range(5)}


def test_ties_are_cut_while_they_are_found(frame, monkeypatch):
    monkeypatch.setattr(VP, "HELD", 10)
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)], 0) for i in range(300)]
    rows = [(i, [x * 2.0 ** (i % 7) for x in v], 0) for i, v, _ in rows]
    blob = VP.build_shard(__import__("pandas").DataFrame({"id": [r[0] for r in rows], "v": [r[1] for r in rows]}), 5)
    found = VP.search_shard(blob, np.array([9]), np.array([[4.0, 0.0, 0.0]]), 5, 1.0)
    assert found["vec_id"].tolist() == [0, 3, 6, 12, 15]


def test_rows_sent_grow_with_the_table():
    """Queries meet at most SHARDS shards until a shard is as large as a worker holds."""
    sent = lambda n: n // 50 * -(-n // VP.rows_of_shard(n))
    least, most = VP.SHARD_ROWS
    n = least * VP.SHARDS
    assert sent(8 * n) <= 8.1 * sent(n) and VP.rows_of_shard(10) == least and VP.rows_of_shard(10 ** 12) == most
