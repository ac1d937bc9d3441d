"""Helpers that several operators share: table reading, written
intermediates, ASCII lower-casing and chunked Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quizlens.session import written  # noqa: F401

# A-Z -> a-z on single bytes; UTF-8 continuation bytes are never in that range.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Texts are handled in Python half a MB at a time, so that a worker's memory
# does not follow the size of an Arrow batch.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def positional(rows: DataFrame, *named: str) -> list:
    """The rows under names of their places (c0, c1, ...), which clash with no
    name that an operator adds, and the new names of the named columns."""
    found = [c.lower() for c in rows.columns]
    return [rows.toDF(*[f"c{i}" for i in range(len(found))]), *[f"c{found.index(c.lower())}" for c in named]]
