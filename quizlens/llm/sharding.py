"""Sharding by longest-processing-time scheduling.

Rows of equal content form a group that must stay together. Groups go, the
largest first, to the least loaded shard, kept in a heap.

The schedule is made in two rounds, so that neither holds all groups: a hash
deals the groups to parts, each part streams its groups by falling size
through a heap of ``bins`` bins per shard, and the bins of all parts, whose
number is bounded, are then scheduled onto the shards the same way. A group is
never split, so a group larger than a shard's share has a shard to itself.

Rows learn their group's shard by a join: the few groups of more than one row
in ``MANY`` are broadcast (at most ``MANY`` of them), so that a group with a
third of all rows is in no exchange; the others are shuffled. A row's slot is
its number in (shard, block) plus the rows of the shard's earlier blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import written

SHARDS = 24
BINS = 4                    # bins of a part, per shard
PARTS = (64, 1024)          # least and most parts
GROUPS_PER_PART = 100_000   # as long as there are no more parts than that
MANY = 200_000              # groups that may be broadcast; they hold more than 1 / MANY of all rows
BLOCKS = (64, 4096)         # least and most blocks of a shard
BLOCK_ROWS = 2048


def text_key(text: str) -> Column:
    """Names a text's content; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def schedule(sizes: list[tuple], places: int) -> dict:
    """{name: place}: (size, name) pairs by falling size, then name, each to
    the least loaded place, the first of equals."""
    heap = [(0, k) for k in range(places)]
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out[name] = k
    return out


def schedule_groups(groups: DataFrame, shards: int, parts: int, bins: int = BINS) -> DataFrame:
    """``groups`` (group, bytes, ...) with the shard of each.

    A part's rows come sorted, and only its heap is held; the second round
    sees ``parts * shards * bins`` bins at most."""
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("group"), F.lit(parts)).cast("int")).repartition(
        parts, "part").sortWithinPartitions("part", F.col("bytes").desc(), "group")
    places = shards * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        for b in batches:
            at = []
            for part, size in zip(b.column("part").to_pylist(), b.column("bytes").to_pylist()):
                if part != now:
                    now, heap = part, [(0, k) for k in range(places)]
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                at.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "bin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    binned = written(dealt.mapInArrow(run, f"{schema}, bin int"), "bins")
    loads = binned.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    place = schedule([(r.bytes, (r.part, r.bin)) for r in loads], shards)
    spark = groups.sparkSession
    table = spark.createDataFrame([(p, b, s) for (p, b), s in place.items()], "part int, bin int, shard int")
    return binned.join(F.broadcast(table), ["part", "bin"]).drop("part", "bin")


def shard_rows(rows: DataFrame, id_col: str, group: Column, size: Column, shards: int = SHARDS,
               least_parts: int = PARTS[0], many: int = MANY) -> DataFrame:
    """``rows`` plus _sh_group, _sh_size, _sh_shard (0 to ``shards`` - 1) and
    _sh_slot (gapless from 0 in each shard).

    Rows of equal ``group`` share a shard; null is a group like any other.
    ``size`` is a row's weight, null or below 0 counts as 0. Groups of equal
    size go by ``group``, so the shards do not depend on the order of rows.
    Slots follow a hash of id and group, then the id; rows that agree in both
    are interchangeable. Null ids and repeated rows each get a slot. Columns
    that begin with ``_sh_`` are reserved; others pass through. An empty table
    gives an empty result, and a shard may be empty.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    taken = [c for c in rows.columns if c.lower().startswith("_sh_")]
    if taken:
        raise ValueError(f"reserved column names: {taken}")
    base = written(rows.withColumns({
        "_sh_group": F.coalesce(group.cast("binary"), F.lit(b"")),
        "_sh_none": group.isNull(),
        "_sh_size": F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0)),
    }).withColumn("_sh_key", F.when(F.col("_sh_none"), F.lit(b"0")).otherwise(F.concat(F.lit(b"1"), F.col("_sh_group"))))
        .drop("_sh_none"), "sized")
    groups = base.groupBy(F.col("_sh_key").alias("group")).agg(
        F.sum("_sh_size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = min(PARTS[1], max(least_parts, -(-n_groups // GROUPS_PER_PART)))
    placed = written(schedule_groups(groups, shards, parts), "placed")

    # of groups with more rows than this there are fewer than ``many``
    most = max(n_rows // many, 1)
    hot = placed.where(F.col("n") > most).select(F.col("group").alias("_sh_key"), F.col("shard").alias("_sh_hot"))
    rest = placed.where(F.col("n") <= most).select(F.col("group").alias("_sh_key"), F.col("shard").alias("_sh_shard"))
    known = base.join(F.broadcast(hot), "_sh_key", "left")
    sharded = (known.where("_sh_hot IS NOT NULL").withColumnRenamed("_sh_hot", "_sh_shard")
               .unionByName(known.where("_sh_hot IS NULL").drop("_sh_hot").join(rest, "_sh_key")))

    # slots: blocks of a shard are counted, so no window spans one
    blocks = min(BLOCKS[1], max(BLOCKS[0], -(-n_rows // (shards * BLOCK_ROWS))))
    sharded = written(sharded.withColumn("_sh_block", F.pmod(
        F.xxhash64(F.col(id_col), F.col("_sh_key")), F.lit(blocks)).cast("int")).drop("_sh_key"), "sharded")
    counts = sharded.groupBy("_sh_shard", "_sh_block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_sh_shard").orderBy("_sh_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_sh_shard", "_sh_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_sh_start"))
    inside = Window.partitionBy("_sh_shard", "_sh_block").orderBy(F.col(id_col), "_sh_group")
    numbered = sharded.withColumn("_sh_slot", F.row_number().over(inside) - 1)
    # shards * blocks rows at most
    return numbered.join(F.broadcast(starts), ["_sh_shard", "_sh_block"]).withColumn(
        "_sh_slot", F.col("_sh_start") + F.col("_sh_slot")).drop("_sh_start", "_sh_block").select(
        *rows.columns, "_sh_group", "_sh_size", "_sh_shard", "_sh_slot")


def write_shards(sharded: DataFrame, path: str, block_rows: int = 1_000_000) -> None:
    """The shards as folders of Parquet files ``shard=<n>``, each file a range
    of ``block_rows`` slots in their order."""
    ready = sharded.withColumnRenamed("_sh_shard", "shard").withColumn("_sh_file", F.floor(F.col("_sh_slot") / block_rows))
    (ready.repartition("shard", "_sh_file").sortWithinPartitions("shard", "_sh_slot").drop("_sh_file", "_sh_group")
     .write.partitionBy("shard").parquet(path))
