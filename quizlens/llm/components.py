"""Connected components of a table of links, by alternating large-star and
small-star steps. Every step is an aggregate and a join on a node; each round
is written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link a node's larger (large star) or smaller (small star)
    neighbours to the smallest node among its neighbours and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            low.select("u", F.col("low").alias("v")))
    return out.where("u != v")


def components(edges: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node that has a link; the component is its
    smallest node. Loops and repeated links are allowed; null ends are not
    links. No links give an empty table.

    With ``rounds``, only so many rounds are run: nodes of one label are then
    connected, but a long chain may still have several labels."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(
        "u IS NOT NULL AND v IS NOT NULL AND u != v")
    mark = None
    for _ in range(rounds or MAX_ROUNDS):
        e = written(_star(_star(e, True), False).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        if rounds is None:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    label = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().join(label, "node", "left_anti")
    return label.unionByName(roots.select("node", F.col("node").alias("component")))
