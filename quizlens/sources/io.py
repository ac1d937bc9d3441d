"""Reading and writing: question sets, the seed bank, the six tables, the
cleaned CSV, serial ids and appends with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.session import small_side, written
from quizlens.sources import schemas

NULL_TOKEN = "\\N"  # CSV text of a null, so that an empty string stays empty
RANGE_ROWS = 1_000_000   # rows of a range of an order, about
MAX_CUTS = 6             # times a range that came out too large is cut again


BAD_RECORD = "_bad_record"


def _parsed(reader, fmt: str, schema: T.StructType, path: str) -> DataFrame:
    """A permissive read in which a malformed record keeps its text in
    BAD_RECORD and has nulls elsewhere."""
    with_bad = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    return (reader.format(fmt).schema(with_bad).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_RECORD).load(path))


def read_question_set(spark: SparkSession, path: str, multi_line: bool = True, with_bad: bool = False):
    """A JSON question set (an array of objects, or JSON lines with
    ``multi_line=False``) cut to (question, ideal_answer); other fields are
    ignored and nothing is inferred. ``with_bad`` gives two tables: the good
    rows, and (file, record) of what is no valid JSON, of which there are no
    rows in the first. Without it such a record is a row of nulls. The file is
    parsed once for both. An array is read by one task per file; JSON lines
    are split."""
    if not with_bad:
        return (spark.read.schema(schemas.QUESTION_SET).option("multiLine", multi_line)
                .json(path).select("question", "ideal_answer"))
    # a table of its own: Spark does not read a record's text alone from JSON
    rows = written(_parsed(spark.read.option("multiLine", multi_line), "json", schemas.QUESTION_SET, path)
                   .withColumn("file", F.input_file_name()), "parsed")
    return (rows.where(F.col(BAD_RECORD).isNull()).select("question", "ideal_answer"),
            rows.where(F.col(BAD_RECORD).isNotNull()).select("file", F.col(BAD_RECORD).alias("record")))


def write_question_set(df: DataFrame, path: str) -> None:
    """Write (question, ideal_answer) as JSON lines."""
    df.select("question", "ideal_answer").write.mode("overwrite").json(path)


def load_bank(nested: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Flatten a nested bank ``map<category, array<struct<question, ideal,
    hint>>>`` (column ``bank``) into question rows with difficulty
    ``medium``. When ``existing`` already holds a question, it is returned
    unchanged: seeding happens only into an empty bank."""
    if existing is not None and not existing.isEmpty():
        return existing
    cats = nested.select(F.explode("bank").alias("category", "items"))
    items = cats.select("category", F.explode("items").alias("it"))
    return items.select(
        "category",
        F.col("it.question").alias("question_text"),
        F.col("it.ideal").alias("ideal_answer"),
        F.col("it.hint").alias("hint"),
        F.lit("medium").alias("difficulty"),
    )


# Tables stored in folders of columns' values.
PARTITIONS = {"interview_session": ["month"], "performance": ["category", "bucket"]}
BUCKET_ROWS = 1_000_000   # rows of a bucket of the performance table, about


def _stored_schema(name: str) -> T.StructType:
    schema = schemas.TABLES[name]
    extra = [c for c in PARTITIONS.get(name, []) if c not in schema.fieldNames()]
    return T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in extra]])


def bucket_name(user: str, buckets: int) -> Column:
    """The folder name of a user's bucket; it also tells the number of
    buckets, so that a stored table describes itself."""
    return F.format_string(f"%dof{buckets}", F.pmod(F.xxhash64(user), F.lit(buckets)))


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets a stored table was written with; None where
    nothing is stored."""
    for folder in _folders(spark, path):
        for name in _folders(spark, f"{path}/{folder}"):
            if name.startswith("bucket="):
                return int(name.split("of")[1])
    return None


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite", buckets: int | None = None) -> None:
    """Write one of the six tables as parquet under its fixed schema.

    ``mode``: ``overwrite``, ``append`` (new rows beside the stored ones, which
    are not read) or ``ignore`` (seed only where nothing is stored yet).
    Sessions are partitioned by month, so date filters prune files, and
    performance by category and a hash bucket of the user, so an upsert reads
    and rewrites only the buckets it touches (their number is that of the
    stored table, or ``buckets``, or one per BUCKET_ROWS rows).

    Rows are rebalanced by the partition columns: the adaptive planner splits
    a value with many rows into files of the advisory size and puts small
    values together into one task, so neither a hot month nor many small ones
    decide how many tasks write.
    """
    schema = schemas.TABLES[name]
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    by = PARTITIONS.get(name)
    if by is None:
        out.write.mode(mode).parquet(path)
        return
    if "month" in by:
        out = out.withColumn("month", F.date_format("interview_date", "yyyy-MM"))
    if "bucket" in by:
        had = stored_buckets(df.sparkSession, path) if mode == "append" else None
        n = had or buckets or max(1, -(-out.count() // BUCKET_ROWS))
        out = out.withColumn("bucket", bucket_name("user_id", n))
    out.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read one of the six tables under its fixed schema (never inferred)."""
    return spark.read.schema(_stored_schema(name)).parquet(path).select(*schemas.TABLES[name].fieldNames())


def read_touched(spark: SparkSession, path: str, batch: DataFrame, name: str = "performance") -> DataFrame:
    """The stored rows of the (category, bucket) folders that a batch touches:
    a filter on partition columns only, so no other folder is opened. The
    touched folders, which are listed in the plan, are no more than there are
    folders."""
    buckets = stored_buckets(spark, path)
    rows = spark.read.schema(_stored_schema(name)).parquet(path)
    touched: dict[str | None, list[str]] = {}
    for r in batch.select("category", bucket_name("user_id", buckets).alias("b")).distinct().collect():
        touched.setdefault(r.category, []).append(r.b)
    where = F.lit(False)
    for category, names in touched.items():
        where = where | (F.col("category").eqNullSafe(F.lit(category)) & F.col("bucket").isin(sorted(names)))
    return rows.where(where).select(*schemas.TABLES[name].fieldNames())


def read_sessions_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Sessions with start <= interview_date < end. The month predicate on
    the partition column prunes whole folders before any file is opened; the
    exact bound is then pushed into the parquet scan."""
    df = spark.read.schema(_stored_schema("interview_session")).parquet(path)
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    months = (F.col("month") >= F.date_format(lo, "yyyy-MM")) & (F.col("month") <= F.date_format(hi, "yyyy-MM"))
    rows = df.where(months & (F.col("interview_date") >= lo) & (F.col("interview_date") < hi))
    schema = schemas.TABLES["interview_session"]
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def write_clean_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index; array columns go out as JSON text
    (CSV cannot hold arrays)."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array"
            else F.col(f.name) for f in df.schema.fields]
    (df.select(*cols).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("emptyValue", '""')
     .option("nullValue", NULL_TOKEN).csv(path))


def _listed(spark: SparkSession, path: str) -> list:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(folder)) if fs.exists(folder) else []


def _folders(spark: SparkSession, path: str) -> list[str]:
    names = [f.getPath().getName() for f in _listed(spark, path) if f.isDirectory()]
    return [n for n in names if not n.startswith(("_", "."))]


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds files or folders of data."""
    return any(not f.getPath().getName().startswith(("_", ".")) for f in _listed(spark, path))


def _files_outside_partitions(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds data files of its own beside its partitions."""
    return any(f.isFile() and not f.getPath().getName().startswith(("_", ".")) for f in _listed(spark, path))


def write_touched_partitions(state: DataFrame, touched: DataFrame, path: str,
                             partition_col: str = "category") -> None:
    """Store an updated state table, rewriting only the partitions whose
    values (null among them) appear in ``touched`` (the batch): dynamic
    partition overwrite, so untouched partitions are left as they are, and
    readers see a partition's old files until the job commits. Where the
    table is stored in buckets of users, only the touched (category, bucket)
    folders are rewritten. A target that holds unpartitioned files is refused:
    its rows would no longer be read beside the partitions."""
    spark = state.sparkSession
    if _files_outside_partitions(spark, path):
        raise ValueError(f"{path} holds files outside {partition_col}= folders; store it with write_table first")
    by = [partition_col]
    buckets = stored_buckets(spark, path) if "user_id" in state.columns and "user_id" in touched.columns else None
    if buckets:
        by.append("bucket")
        state, touched = (df.withColumn("bucket", bucket_name("user_id", buckets)) for df in (state, touched))
    keys = touched.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    (state.join(keys, same, "left_semi").hint("rebalance", *[F.col(c) for c in by])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def reserve_ids(spark: SparkSession, path: str, id_col: str, wanted: int) -> int:
    """Sets the next ``wanted`` serial ids of a stored table aside and returns
    the id before them. The largest id given so far is kept beside the table
    (a reader of the table does not see it), so no old row is read; where it
    is missing, one column of the table is scanned. It is moved on before any
    row is stored: a job that fails in between leaves a gap, never an id given
    twice. One writer at a time."""
    held = f"{path}/_serial"
    if _listed(spark, held):
        top = spark.read.schema("top bigint").parquet(held).agg(F.max("top")).first()[0]
    elif _listed(spark, path):
        top = max_id(spark.read.schema(f"`{id_col}` bigint").parquet(path), id_col).first()[0]
    else:
        top = 0
    spark.createDataFrame([(top + wanted,)], "top bigint").coalesce(1).write.mode("overwrite").parquet(held)
    return top


def read_clean_csv(spark: SparkSession, path: str, columns: list[str], with_bad: bool = False):
    """Read the cleaned CSV back, every column as text. ``with_bad`` gives two
    tables: the rows, and (file, record) of the lines that have more or fewer
    fields than there are columns."""
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("emptyValue", "").option("nullValue", NULL_TOKEN))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not with_bad:
        return reader.schema(schema).csv(path)
    rows = written(_parsed(reader, "csv", schema, path).withColumn("file", F.input_file_name()), "parsed")
    return (rows.where(F.col(BAD_RECORD).isNull()).select(*columns),
            rows.where(F.col(BAD_RECORD).isNotNull()).select("file", F.col(BAD_RECORD).alias("record")))


def max_id(existing: DataFrame, id_col: str) -> DataFrame:
    """One row: the largest id, or 0 for an empty table."""
    return existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("max_id"))


def ranged(df: DataFrame, order_cols: list[str], rows_per_range: int = RANGE_ROWS,
           ranges: int | None = None) -> DataFrame:
    """df written in the order of ``order_cols`` (null first), cut into ranges:
    the added ``_range`` rises with the order, ``_pos`` is the 0-based place
    inside it. Both are read back from the written files, so every later use,
    retry or reuse sees the same cut.

    The cut is a sample sort: splitters are sampled from the whole order tuple
    with its full values, so a hot first value or texts that begin alike are
    spread over as many ranges as they fill. There is a range for every
    ``rows_per_range`` rows (or ``ranges`` of them). A range that comes out
    larger than twice that is cut again by splitters of its own, until none
    is, or only rows that agree in all order columns are left in it.
    """
    n = df.count()
    room = rows_per_range if ranges is None else max(1, -(-n // ranges))
    todo, done, key = df, [], []
    for turn in range(MAX_CUTS):
        parts = max(1, -(-n // room))
        dealt = todo.repartitionByRange(parts, *key, *order_cols).sortWithinPartitions(*key, *order_cols)
        # partition << 33 | place in it
        rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranged")
        key = [*key, f"_cut{turn}"]
        rows = rows.withColumns({key[-1]: F.shiftright("_at", 33),
                                 "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
        # a partition may hold the end of one range and the start of another
        sizes = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")), "ranges")
        if turn:
            rows = rows.join(small_side(sizes.drop("_n"), is_written=True), key).withColumn(
                "_pos", F.col("_pos") - F.col("_first")).drop("_first")
        large = sizes.where(F.col("_n") > 2 * room)
        left = large.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if parts == 1 or not left or left == n and turn or turn + 1 == MAX_CUTS:
            done.append(rows)
            break
        large = small_side(large.select(*key))
        done.append(rows.join(large, key, "left_anti"))
        todo, n = rows.join(large, key, "left_semi").drop("_pos"), left
    return _one_range(done, len(key), df.columns)


def _one_range(parts: list[DataFrame], depth: int, columns: list[str]) -> DataFrame:
    """The rows of all turns, with the numbers of the cuts made one struct."""
    out = None
    for rows in parts:
        cuts = [F.col(f"_cut{i}") if f"_cut{i}" in rows.columns else F.lit(0).cast("bigint") for i in range(depth)]
        one = rows.select(*[F.col(f"`{c}`") for c in columns],
                          F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cuts)]).alias("_range"), "_pos")
        out = one if out is None else out.unionAll(one)
    return out


def global_rank(df: DataFrame, order_cols: list[str], out: str = "_grank", ranges: int | None = None,
                rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """0-based rank of every row in the order of ``order_cols`` (null first),
    with all other columns kept. Rows that agree in all of them are ranked in
    some order; otherwise ranks do not depend on the cut.

    No window spans the rows: they are sorted in ranges (see ``ranged``), rows
    are counted per range, and a row's rank is the number of rows in earlier
    ranges plus its place inside its own."""
    rows = ranged(df, order_cols, rows_per_range, ranges)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: a millionth of the rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (rows.join(small_side(starts), "_range")
            .withColumn(out, F.col("_start") + F.col("_pos")).drop("_range", "_pos", "_start"))


def assign_ids(df: DataFrame, existing: DataFrame | int, id_col: str, order_cols: list[str],
               out_col: str | None = None, ranges: int | None = None) -> DataFrame:
    """Serial ids for new rows, continuing above the current maximum (of the
    stored rows, or given), in the order of ``order_cols`` (together unique);
    other columns are kept."""
    out_col = out_col or id_col
    top = existing if isinstance(existing, int) else max_id(existing, id_col).first()[0]
    r = global_rank(df, order_cols, out="_grank", ranges=ranges)
    return r.withColumn(out_col, F.col("_grank") + F.lit(top + 1)).drop("_grank")


def append_rows(existing: DataFrame, new_rows: DataFrame, table: str,
                fill_timestamp: bool = True) -> DataFrame:
    """INSERT with column defaults: a default applies to new rows that come
    without the column. Stored rows, and nulls given on purpose, stay as they
    are."""
    fills = dict(schemas.DEFAULTS.get(table, {}))
    if fill_timestamp:
        fills |= dict.fromkeys(("created_at", "interview_date", "answered_at"), F.localtimestamp())
    for col, val in fills.items():
        if col in existing.columns and col not in new_rows.columns:
            value = val if isinstance(val, Column) else F.lit(val)
            new_rows = new_rows.withColumn(col, value.cast(existing.schema[col].dataType))
    return existing.unionByName(new_rows, allowMissingColumns=True)


def is_empty_df(df: DataFrame) -> DataFrame:
    """One row ``has_rows``: whether df holds any row; reads at most one."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))


