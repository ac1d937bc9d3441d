"""Approximate nearest neighbours by cosine: one vantage-point tree per shard.

Unit vectors are compared by chord length, a metric that orders as the cosine
does. A shard's tree halves its vectors by their distance to a vantage point
and keeps the smallest and largest distance of either half; the triangle
inequality then bounds how near a half can come to a query. A half is skipped
when that bound, times ``factor``, exceeds the query's k-th distance so far:
factor 1 is exact, larger factors skip more.

Vectors are dealt to shards by a hash, the trees are written once, and every
block of queries meets every shard in a task of its own. Found neighbours are
scored again on the original vectors in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import written

SHARD_ROWS = (8192, 131_072)   # least and most rows of a shard
SHARDS = 256                   # as long as shards do not grow beyond that
HELD = 1 << 20                 # found neighbours held before they are cut to k a query
QUERY_ROWS = 4096
LEAF = 128
EPS = 1e-7         # rounding of a chord length near 0


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): rows with an id and a finite vector that is not zero."""
    v = F.col(vector_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()).where(
        ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))


class Tree:
    """Arrays of a tree over unit vectors. ``nodes`` has a row for each inner
    node: vantage vector, the two children, and the range of distances in
    either; a child below 0 is the leaf ``~child``, a slice of ``order``."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        order = np.arange(len(unit))
        nodes: list[list[float]] = []
        leaves: list[tuple[int, int]] = []

        def grow(a: int, b: int) -> int:
            if b - a <= LEAF:
                leaves.append((a, b))
                return ~(len(leaves) - 1)
            # a vantage point far from the middle of its set splits best
            part = order[a:b]
            centre = unit[part].mean(axis=0)
            vp = int(part[np.argmin(unit[part] @ centre)])
            d = chord(unit[part] @ unit[vp])
            by = np.argsort(d, kind="stable")
            order[a:b], d = part[by], d[by]
            mid = (a + b) // 2
            h = mid - a
            nodes.append([vp, 0, 0, d[0], d[h - 1], d[h], d[-1]])
            me = len(nodes) - 1
            nodes[me][1] = grow(a, mid)
            nodes[me][2] = grow(mid, b)
            return me

        self.root = grow(0, len(unit)) if len(unit) else 0
        self.order, self.leaves = order, np.array(leaves, dtype=np.int64).reshape(-1, 2)
        self.nodes = np.array(nodes, dtype=np.float64).reshape(-1, 7)

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest vectors to each unit query,
        unordered; place -1 where there are fewer."""
        best = np.full((len(q), k), np.inf)
        place = np.full((len(q), k), -1, dtype=np.int64)
        if not len(self.unit):
            return place, best
        scanned = np.full(len(q), -1)

        def scan(leaf: int, some: np.ndarray) -> None:
            a, b = self.leaves[leaf]
            at = self.order[a:b]
            d = np.concatenate((best[some], chord(q[some] @ self.unit[at].T)), axis=1)
            p = np.concatenate((place[some], np.broadcast_to(at, (len(some), len(at)))), axis=1)
            low = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.arange(d.shape[1])[None, :]
            best[some], place[some] = np.take_along_axis(d, low, 1), np.take_along_axis(p, low, 1)

        # first each query's own leaf, for a good bound from the start
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, some = todo.pop()
            if node < 0:
                scan(~node, some)
                scanned[some] = ~node
                continue
            inner, outer = self._sides(node, q[some])
            near = inner <= outer
            for child, take in ((int(self.nodes[node][1]), near), (int(self.nodes[node][2]), ~near)):
                if take.any():
                    todo.append((child, some[take]))
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, some = todo.pop()
            if node < 0:
                some = some[scanned[some] != ~node]
                if len(some):
                    scan(~node, some)
                continue
            far = best[some].max(axis=1) + EPS
            for child, bound in zip((int(self.nodes[node][1]), int(self.nodes[node][2])), self._sides(node, q[some])):
                take = bound * factor <= far
                if take.any():
                    todo.append((child, some[take]))
        return place, best

    def within(self, q: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, places) of all vectors no further from a unit query than
        its radius, leaf by leaf, by the same bounds as ``search``."""
        todo = [(self.root, np.arange(len(q)))] if len(self.unit) else []
        while todo:
            node, some = todo.pop()
            if node < 0:
                a, b = self.leaves[~node]
                at = self.order[a:b]
                hit, col = np.nonzero(chord(q[some] @ self.unit[at].T) <= radius[some][:, None])
                yield some[hit], at[col]
                continue
            vp, inner, outer, *_ = self.nodes[node]
            for child, bound in zip((int(inner), int(outer)), self._sides(node, q[some])):
                take = bound * factor <= radius[some]
                if take.any():
                    todo.append((child, some[take]))

    def _sides(self, node: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near either half can come to each query."""
        vp, _, _, lo1, hi1, lo2, hi2 = self.nodes[node]
        d = chord(q @ self.unit[int(vp)])
        return np.maximum(np.maximum(lo1 - d, d - hi1), 0), np.maximum(np.maximum(lo2 - d, d - hi2), 0)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, summed component by
    component, so that equal pairs give equal results wherever they stand."""
    xy, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for j in range(x.shape[1]):
        xy += x[:, j] * y[:, j]
        xx += x[:, j] * x[:, j]
        yy += y[:, j] * y[:, j]
    return xy / np.sqrt(xx * yy)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def build_shard(rows: pd.DataFrame, k: int) -> bytes:
    """The shard's tree over its distinct vectors, with the k + 1 smallest ids
    of each: more of them can be in no answer."""
    v = np.array(rows["v"].tolist(), dtype=np.float64) + 0.0      # -0.0 is 0.0
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    v, ids = v[order], ids[order]
    raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    by = np.lexsort((ids, which))
    held = np.full((len(first), k + 1), -1, dtype=np.int64)
    used = np.zeros((len(first), k + 1), dtype=bool)
    last, n = [None] * len(first), [0] * len(first)
    for c, i in zip(which[by].tolist(), ids[by].tolist()):
        if n[c] <= k and last[c] != i:
            held[c, n[c]], used[c, n[c]] = i, True
            n[c] += 1
            last[c] = i
    tree = Tree(_unit(v[first]))
    out = io.BytesIO()
    np.savez(out, v=v[first], held=held, used=used, order=tree.order, leaves=tree.leaves,
             nodes=tree.nodes, root=np.array([tree.root]))
    return out.getvalue()


def search_shard(blob: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """The k best of the shard for each query, scored on the originals.

    The tree gives each query's k-th distance; then all vectors that are as
    near, but for rounding, are scored, so that ties go by id however many
    there are."""
    a = np.load(io.BytesIO(blob))
    v, held, used = a["v"], a["held"], a["used"]
    tree = Tree.__new__(Tree)
    tree.unit, tree.order, tree.leaves, tree.nodes, tree.root = (
        _unit(v), a["order"], a["leaves"], a["nodes"], int(a["root"][0]))
    unit = _unit(queries)
    # the query's own row may be among them
    _, best = tree.search(unit, k + 1, factor)
    columns = ["query_id", "vec_id", "score"]
    out, parts, n = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}), [], 0

    def cut(found: list[pd.DataFrame]) -> pd.DataFrame:
        all_ = pd.concat(found)[columns].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return all_.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    for qi, cls in tree.within(unit, best.max(axis=1) + EPS, factor):
        score = cosine(queries[qi], v[cls])
        r, c = np.nonzero(used[cls])
        found = pd.DataFrame({"query_id": query_ids[qi[r]], "vec_id": held[cls[r], c], "score": score[r]})
        parts.append(found[found["query_id"] != found["vec_id"]])
        n += len(parts[-1])
        if n > HELD:
            parts, n = [cut(parts)], 0
    return cut(parts) if parts else out


def rows_of_shard(n: int) -> int:
    """Rows of a shard in a table of n: every query meets every shard, so
    shards grow with the table, to what a worker holds, and their number does
    not, until they have grown that far."""
    return min(SHARD_ROWS[1], max(SHARD_ROWS[0], -(-n // SHARDS)))


def nearest(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            factor: float = 1.0, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by cosine,
    nearest first, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. Rows that share the
    query's id are the query itself. Vectors that are null, zero, or hold a
    null or non-finite component, and rows of null id, take no part; vectors
    of different lengths are not compared. A repeated row counts once. Fewer
    candidates than k give fewer rows; an empty table an empty result. Other
    columns are not looked at.
    """
    u = written(usable(rows, id_col, vector_col), "vectors")
    n = u.count()
    shards = max(1, -(-n // (shard_rows or rows_of_shard(n))))
    blocks = max(1, -(-u.where(is_query).count() // QUERY_ROWS))
    dealt = u.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))

    def build(key: tuple[Any, ...], rows_: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [build_shard(rows_, k)]})

    trees = written(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"), "trees")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = trees.withColumn("block", every(blocks))
    asked = u.where(is_query).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")) \
             .withColumn("shard", every(shards))
    keys = ["dim", "shard", "block"]

    def search(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if t.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_shard(t["tree"][0], q["id"].to_numpy(), np.array(q["v"].tolist(), dtype=np.float64), k, factor)

    found = left.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
