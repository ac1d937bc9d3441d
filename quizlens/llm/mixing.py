"""Mixing sources to target weights by systematic sampling, in native
DataFrame expressions only.

Targets come from water-filling over the (small) table of sources. A source's
documents are put in one order, by size, then by a hash of the id; every
document expects ``target / source size`` copies, and it is emitted once per
integer that its stretch of the running sum, shifted by one random offset per
source, crosses. Ordering by size spreads the copies evenly over short and
long documents, so the words taken stay close to the target.

The running sum is a rank times a constant, and the rank is built from counts
in three levels (size band, size, hash slot), so no window spans a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import positional

WEIGHTS = (3, 1, 2)      # of the sources by code point, null last, repeating
SHARE = 1.5              # the mix's words as a share of all words
MOST = 2.0               # a source's target is at most this many times its words
SEED = "mix"
BAND = 64                # sizes in a band
WORD = r"[^\x20\x09-\x0D]+"
ADDED = frozenset(f"_mx_{x}" for x in "key slot before rank u source_size target copies".split())


def n_words(text) -> Column:
    """Number of words of a text; null counts as no word."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source) -> Column:
    # sorts as the code points do, with null behind every text
    return F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("2"))


def _slot(id_col) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("-"))), 1, 3)


def _uniform(key) -> Column:
    """A number in [0, 1) fixed by the source's key and the seed."""
    eight = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.col(key))), 1, 8)
    return F.conv(eight, 16, 10).cast("double") / F.lit(2.0 ** 32)


def source_targets(sizes: DataFrame, key: str, size: str, weights=WEIGHTS,
                   share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target): ``share`` of all words dealt by weight; a
    source stops at ``most`` times its words and its excess is dealt again.

    With sources ordered by cap / weight, water level i deals what the first
    i - 1 caps leave to the remaining weights; the level that holds is the
    largest of them. One row per source enters the two ordered windows."""
    s = sizes.groupBy(key).agg(F.sum(size).alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(Window.orderBy(key)) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    ahead = Window.orderBy(F.col("_cap") / F.col("_w"), key).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share))
             - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0)))
    return s.withColumn("_level", level).select(
        key, "source_size", F.least("_cap", F.col("_w") * F.max("_level").over(everything)).alias("target"))


def mix(rows: DataFrame, id_col: str, source_col: str, size: Column, counted: DataFrame | None = None,
        **targets) -> DataFrame:
    """``rows`` plus _mx_size, _mx_source_size, _mx_target, _mx_copies.

    ``size`` is a row's number of words (null: 0). Rows of null source form
    one source of their own, the last; a source without words has target 0
    and no copies. Rows that agree in id, source and size are numbered in any
    order: they are interchangeable. Other columns pass through. An empty
    table gives an empty result. ``counted`` may give (id, source, size) of
    the same rows under the names of ``rows`` and ``_mx_size``, already
    written, so that sizes are not computed again for the counts. The names
    in ``ADDED`` are taken: rows that have one of them are refused.
    """
    taken = ADDED.intersection(c.lower() for c in rows.columns)
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")

    def keyed(df):
        return df.withColumn("_mx_key", _source_key(source_col)).withColumn("_mx_slot", _slot(id_col))

    sized = keyed(rows.withColumn("_mx_size", F.coalesce(size, F.lit(0)).cast("long")))
    c = (keyed(counted) if counted is not None else sized).groupBy(
        "_mx_key", "_mx_size", "_mx_slot").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("band", F.floor(F.col("_mx_size") / BAND))

    def before(keys, order):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    of_size = c.groupBy("_mx_key", "band", "_mx_size").agg(F.sum("n").alias("n"))
    of_band = of_size.groupBy("_mx_key", "band").agg(F.sum("n").alias("n"))
    bands = of_band.select("_mx_key", "band", before(["_mx_key"], "band").alias("b0"))
    by_size = of_size.withColumn("s0", before(["_mx_key", "band"], "_mx_size")).join(
        bands, ["_mx_key", "band"]).select("_mx_key", "_mx_size", (F.col("b0") + F.col("s0")).alias("s0"))
    words = of_size.withColumn("words", F.col("n") * F.col("_mx_size"))
    t = source_targets(words, "_mx_key", "words", **targets)
    per_source = t.select("_mx_key", F.col("source_size").alias("_mx_source_size"),
                          F.col("target").alias("_mx_target"), _uniform("_mx_key").alias("_mx_u"))
    offsets = c.withColumn("l0", before(["_mx_key", "_mx_size"], "_mx_slot")).join(
        by_size, ["_mx_key", "_mx_size"]).join(per_source, "_mx_key").select(
        "_mx_key", "_mx_size", "_mx_slot", (F.col("s0") + F.col("l0")).alias("_mx_before"),
        "_mx_source_size", "_mx_target", "_mx_u")

    near = Window.partitionBy("_mx_key", "_mx_size", "_mx_slot").orderBy(F.col(id_col))
    ranked = sized.join(offsets, ["_mx_key", "_mx_size", "_mx_slot"]).withColumn(
        "_mx_rank", F.col("_mx_before") + F.row_number().over(near))
    each = F.when(F.col("_mx_source_size") > 0, F.col("_mx_target") / F.col("_mx_source_size")).otherwise(0.0)
    upto = lambda r: F.floor(F.col("_mx_u") + each * r)
    return ranked.withColumn("_mx_copies", upto(F.col("_mx_rank")) - upto(F.col("_mx_rank") - 1)).drop(
        "_mx_key", "_mx_slot", "_mx_before", "_mx_u", "_mx_rank")


def mixed_rows(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """The mix itself: each row as often as it is emitted (not at all, once or
    twice), with the columns of ``rows``, whatever their names."""
    plain, id_, source, text = positional(rows, id_col, source_col, text_col)
    m = mix(plain, id_, source, n_words(text))
    return m.where("_mx_copies > 0").withColumn(
        "_mx_i", F.explode(F.sequence(F.lit(1), F.col("_mx_copies").cast("int")))).select(*plain.columns).toDF(*rows.columns)
