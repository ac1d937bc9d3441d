"""The training-data pipeline: documents in, token ids out.

Each stage is one operator of ``quizlens.llm`` over everything its predecessor
kept; its result is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizlens.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from quizlens.llm.common import table, written
from quizlens.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the positive-unlabelled classifier, which
    learns from the labels of ``sf_dir`` and these documents."""
    model = toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)
    return toxicity.score_rows(docs, model).where("toxic_score < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep_largest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.75 of its 5-word shingles the document of the
    smallest id. Rows that share an id stay or go together; rows of null id
    are in no group and stay."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document not at all, once or twice."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text,
    for every document of the mix."""
    import public_tokenizers as tokenizers
    return bpe.encode_rows(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN,
                           columns=("doc_id",), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

# Training, components and merges are not SQL: tests/llm/test_pipeline.py
# holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs

