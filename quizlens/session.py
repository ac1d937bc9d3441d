"""Session helpers: building a local session for tests, the shared scratch
folder, and the size-checked broadcast used by every small-side join."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes a side may have to be broadcast. A side is broadcast only after its
# bytes are measured; beyond the bound the join is left to Catalyst
# (sort-merge, with AQE skew handling).
BROADCAST_MAX_BYTES = 64 << 20


# Settings for a large cluster (about 100 TB of input). They are advice for
# the job's submitter, not applied by the library: a session owns its config.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # an initial shuffle width that AQE coalesces down: ~100 TB / 256 MB
    "spark.sql.shuffle.partitions": "400000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    "spark.sql.session.timeZone": "UTC",
    # checkpoints written by the operators are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # spark.checkpoint.dir: a shared folder (HDFS/object store) of the cluster
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quizlens") -> SparkSession:
    """A local session as used in tests and the bench. On a cluster the
    caller's own session is used instead and none of this applies."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in spark.checkpoint.dir.

    Only when the session has none (local tests) is a folder of our own set.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="quizlens-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "quizlens", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared scratch folder and read back
    under its schema: later readers, and retries after a lost executor, start
    from the files and read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _value_bytes(value, kind: T.DataType):
    """Bytes of one value, as a column: text and binary by length, arrays by
    their elements, anything else as 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"),
                                          lambda n, x: n + _value_bytes(x, kind.elementType)), F.lit(0))
        return F.greatest(F.size(value), F.lit(0)).cast("bigint") * 8
    return F.lit(8).cast("bigint")


def table_bytes(df: DataFrame) -> int:
    """Rows and bytes as they would sit in a broadcast: one partial aggregate,
    of which only the sum comes to the driver."""
    row = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("bigint"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small_side(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, is_written: bool = False) -> DataFrame:
    """Mark df for broadcast only when its measured bytes are below the bound;
    otherwise Catalyst shuffles both sides. The plan differs, the result does
    not. df is written once first (unless it is already), so measuring and
    joining do not compute it twice."""
    side = df if is_written else written(df, "side")
    return F.broadcast(side) if table_bytes(side) <= max_bytes else side


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regex cleaning of whole texts) at least
    as many partitions as the cluster has cores.

    A scan yields one task per file split / row group; a many-file input on
    a cluster already has far more partitions than cores, and then this is a
    no-op. Only an input with fewer splits than cores (one large row group)
    is spread by a round-robin repartition before the expensive expressions.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    # After a shuffle the data already has shuffle-level parallelism, and
    # asking an adaptive plan for its partitions would run its stages: only
    # a plan without an exchange (a scan and narrow steps) is inspected.
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder (set from the session's
    ``spark.checkpoint.dir`` first if the context has none yet)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
