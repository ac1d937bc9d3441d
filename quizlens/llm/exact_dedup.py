"""Exact dedup: a tree-merge of sorted digest runs.

Every text becomes (SHA-256, byte length, 64-bit check hash). Rows are dealt
into ``fan ** rounds`` runs, each reduced to one entry per distinct text. The
runs are then exchanged in ``rounds`` rounds: in a round every group of
``fan`` runs that agree on the digits not yet dealt swap slices of the digest
space, and each node merges ``fan`` sorted slices, keeping of each verified
text the identifier that stays and the number of rows. After the last round a
node holds a disjoint slice of the digest space and is done.

No node sees more than its slice; a text held by a third of all rows has at
most one entry per run, so it crosses the network ``fan ** rounds`` times at
most, and the answer travels back to the rows by (run, digest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.llm.common import LOWER_AZ, chunks, positional, text_bytes, written

FAN = 64
ROUNDS = 2
KEY = ["digest", "n_bytes", "check"]
_RUN = "run int, digest binary, n_bytes long, check long, keep_id long, keep_row long, size long"


def digests(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest, n_bytes, check) of every row; null text counts as
    empty, A-Z are lower-cased."""
    src = rows.select(F.monotonically_increasing_id().alias("row"),
                      F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in chunks(whole, "text")):
            texts = [t.translate(LOWER_AZ) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("id"),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
            ], names=["row", "id", *KEY])

    return src.mapInArrow(hashed, "row long, id long, digest binary, n_bytes long, check long")


def _merged(frames: Iterator[pd.DataFrame], left: int) -> Iterator[pd.DataFrame]:
    """Merges the sorted slices of a partition as they stream by: equal texts
    of a node are neighbours. Only the open entry is kept between batches."""
    carry: pd.DataFrame | None = None
    for f in frames:
        if carry is not None:
            f = pd.concat([carry, f], ignore_index=True)
        if f.empty:
            continue
        new = np.zeros(len(f), dtype=bool)
        new[0] = True
        for c in ("node", *KEY):
            v = f[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        # sorted so that the identifier that stays comes first in its group
        out = f.iloc[starts].copy()
        out["size"] = np.add.reduceat(f["size"].to_numpy(), starts)
        out["run"] = out["run"] % left
        carry = out.iloc[-1:]
        yield out.iloc[:-1].drop(columns="node")
    if carry is not None:
        yield carry.drop(columns="node")


def tree_merge(runs: DataFrame, fan: int, rounds: int, keep_largest: bool) -> DataFrame:
    """The runs (run, digest, ..., keep_id, keep_row, size) merged in
    ``rounds`` exchange rounds into one entry per verified text."""
    # the digest's first 48 bits, read as base-fan digits
    point = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    first = F.col("keep_id").desc_nulls_last() if keep_largest else F.col("keep_id").asc_nulls_last()
    for r in range(rounds):
        left = fan ** (rounds - r - 1)            # runs that remain apart after this round
        slice_ = F.pmod(point, F.lit(fan ** (r + 1)))
        node = slice_ * F.lit(left) + F.col("run") % F.lit(left)
        dealt = runs.withColumn("node", node).repartition("node").sortWithinPartitions(
            "node", *KEY, first, "keep_row")
        runs = dealt.mapInPandas(lambda frames, left=left: _merged(frames, left), _RUN)
    return runs


def exact_dedup(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep_largest: bool = False, fan: int = FAN, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty (so null and empty texts are one group). Of equal texts the row with
    the smallest (``keep_largest``: largest) id stays; of rows that share text
    and id exactly one is kept, and a null id stays only if its group has no
    other. Extra columns of the input are not looked at. An empty table gives
    an empty result.
    """
    # Written once: the texts are read and hashed a single time, and row
    # numbers stay what they are when a task is run again.
    d = written(digests(rows, id_col, text_col), "digests")
    d = d.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(fan ** rounds)).cast("int"))
    # order of (id, row) that stays, as one comparable struct
    rank = F.col("id") if keep_largest else -F.col("id")
    best = F.max(F.struct(rank.isNotNull().alias("has"), rank.alias("rank"), (-F.col("row")).alias("row")))
    runs = d.groupBy("run", *KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("size")).select(
        "run", *KEY, (F.col("best.rank") if keep_largest else -F.col("best.rank")).alias("keep_id"),
        (-F.col("best.row")).alias("keep_row"), "size")
    runs = written(runs, "runs")
    groups = tree_merge(runs, fan, rounds, keep_largest).select(
        *KEY, F.col("keep_id"), F.col("keep_row"), F.col("size").alias("group_size"))
    # back along the runs: a hot text has one entry per run, and its rows are
    # spread over all runs
    back = runs.select("run", *KEY).join(groups, KEY)
    return d.join(back, ["run", *KEY]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep_largest: bool = False) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns, whatever
    their names.

    Rows are found again by (id, digest); where several rows share both, any
    one of them is kept."""
    names = rows.columns
    rows, id_col, text_col = positional(rows, id_col, text_col)
    kept = exact_dedup(rows, id_col, text_col, keep_largest)
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), "text_sha256")
    stay = kept.where("kept").select(key.alias("_ed_key"))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in chunks(whole, text_col)):
            ids = b.column(id_col).to_pylist()
            keys = [f"{'-' if i is None else i}:{hashlib.sha256(t.translate(LOWER_AZ)).hexdigest()}"
                    for i, t in zip(ids, text_bytes(b.column(text_col)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())],
                                             names=[*b.schema.names, "_ed_key"])

    named = rows.mapInArrow(tagged, T.StructType([*rows.schema.fields, T.StructField("_ed_key", T.StringType())]))
    # join and window share one exchange by the key
    once = Window.partitionBy("_ed_key").orderBy("_ed_key")
    return named.join(stay, "_ed_key").withColumn("_ed_n", F.row_number().over(once)) \
                .where("_ed_n = 1").select(*rows.columns).toDF(*names)
