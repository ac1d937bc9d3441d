"""Keys and constraints as jobs: account/user linking, insert-if-absent,
registration checks, and a constraint audit (constraint -> offending rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.functions import text as TX
from quizlens.session import small_side, written


def link_accounts(accounts: DataFrame, users: DataFrame, account_key: str = "id",
                  user_key: str = "id", email: str = "email") -> DataFrame:
    """Each account with the user row of the same normalised email (the
    two tables have separate id sequences)."""
    a = accounts.select(F.col(account_key).alias("account_id"),
                        TX.normalise_email(email).alias("_email"))
    u = users.select(F.col(user_key).alias("user_id"), TX.normalise_email(email).alias("_email"))
    return a.join(u, "_email", "left").select("account_id", "user_id", F.col("_email").alias("email"))


def first_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a window group limit of one,
    so every task keeps one row per key before the shuffle, whatever the
    columns are."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return batch.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str],
                     order: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING for a whole batch: keep the first
    row per key inside the batch, drop keys the target has (anti join), and
    append. Running it twice gives the same table as once."""
    b = first_per_key(batch.select(*target.columns), keys, order)
    new = b.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new)


def registration_checks(reg: DataFrame, existing: DataFrame | None = None,
                        key: str = "reg_id", first_name: str = "first_name",
                        email: str = "email") -> DataFrame:
    """Per registration the list of failed rules: a missing required field,
    an email already taken by an account, or by an earlier registration of the
    same batch. Password rules are not built."""
    r = reg.withColumn("_email", TX.normalise_email(email)) \
           .withColumn("_first", TX.normalise_name(first_name))
    # First registration per email by a partial aggregate and a join back
    # (AQE splits a hot email in the join; a window would not).
    first = r.groupBy("_email").agg(F.min(key).alias("_first_key"))
    r = r.join(first, "_email", "left").withColumn(
        "_dup", F.col("_email").isNotNull() & (F.col(key) > F.col("_first_key")))
    if existing is not None:
        ex = existing.select(TX.normalise_email(email).alias("_email")).distinct() \
                     .withColumn("_taken", F.lit(True))
        r = r.join(ex, "_email", "left")
    else:
        r = r.withColumn("_taken", F.lit(None).cast("boolean"))
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.col("_first"), F.lit("")) == "", F.lit("missing first name")),
        F.when(F.coalesce(F.col("_email"), F.lit("")) == "", F.lit("missing email")),
        F.when(F.coalesce(F.col("_taken"), F.lit(False)), F.lit("email already registered")),
        F.when(F.col("_dup"), F.lit("duplicate email in batch")),
    ))
    return r.select(key, F.col("_email").alias("email"), errors.alias("errors"))


def _one(name: str, n) -> DataFrame:
    return n.select(F.lit(name).alias("check_name"), F.col("bad_rows").cast("bigint"))


SPARSE = 64          # places per id, from which bitmaps are not used


def id_bitmaps(df: DataFrame, key: str) -> DataFrame:
    """(bucket, bits, n): the ids of a table as bitmaps of 32,768 ids, built in
    the tasks first, and the rows of each bucket. Only bitmaps are shuffled,
    4 kB for each bucket and task, never the keys."""
    k = F.col(key).cast("bigint")
    return df.where(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"), F.count(F.lit(1)).alias("n"))


def _is_dense(df: DataFrame, key: str) -> bool:
    """Whether bitmaps pay: ids spread so widely that a bucket has few of them
    (random 64-bit keys) would take a bitmap each."""
    if not isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType)):
        return False
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    return n > 0 and hi - lo <= SPARSE * n


def _rows_in(df: DataFrame, key: str, buckets: DataFrame) -> DataFrame:
    """The keys of the rows in the named buckets, which are few."""
    k = F.col(key).cast("bigint")
    return df.select(k.alias("_k")).where("_k IS NOT NULL").withColumn("bucket", F.bitmap_bucket_number("_k")).join(
        small_side(buckets, is_written=True), "bucket", "left_semi").select("_k")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once (one row: bad_rows). For a single
    whole-number key, only rows in buckets that hold fewer ids than rows are
    grouped by key."""
    if len(keys) == 1 and _is_dense(df, keys[0]):
        full = written(id_bitmaps(df, keys[0]).where(F.bitmap_count("bits") < F.col("n")).select("bucket"), "full")
        g = df.where(F.col(keys[0]).isNull()).groupBy().agg(F.count(F.lit(1)).alias("_n"))
        if not full.isEmpty():
            g = g.unionByName(_rows_in(df, keys[0], full).groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).select("_n"))
    else:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") > 1).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("bad_rows"))


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of child whose non-null foreign key has no parent. Where ids are
    dense, those of both are compared as bitmaps, and only rows in buckets
    where the child has ids that the parent lacks are joined by key; if there
    are none, the child is not read again."""
    if not (_is_dense(child, fk) and _is_dense(parent, pk)):
        c, p = child.select(F.col(fk).alias("_k")).where("_k IS NOT NULL"), parent.select(F.col(pk).alias("_k"))
        return c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("bad_rows"))
    c = id_bitmaps(child, fk).select("bucket", F.col("bits").alias("child_bits"))
    p = id_bitmaps(parent, pk).select("bucket", F.col("bits").alias("parent_bits"))
    both = c.join(p, "bucket", "left")
    # the child adds ids to the parent's: the union holds more than the parent
    merged = both.select("bucket", "parent_bits", F.explode(F.array("child_bits", "parent_bits")).alias("b")).groupBy(
        "bucket").agg(F.bitmap_count(F.bitmap_or_agg("b")).alias("of_both"),
                      F.coalesce(F.max(F.bitmap_count("parent_bits")), F.lit(0)).alias("of_parent"))
    short = written(merged.where("of_both > of_parent").select("bucket"), "short")
    if short.isEmpty():
        return short.agg(F.count(F.lit(1)).alias("bad_rows"))
    return _rows_in(child, fk, short).join(_rows_in(parent, pk, short), "_k", "left_anti").agg(
        F.count(F.lit(1)).alias("bad_rows"))


def too_long(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose column is longer than n characters (one row: bad_rows)."""
    return df.agg(F.count_if(F.length(col) > n).alias("bad_rows"))


def audit(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of one-row checks (check_name, bad_rows)."""
    parts = [_one(name, df) for name, df in checks]
    return reduce(DataFrame.unionByName, parts)
