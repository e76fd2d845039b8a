"""From documents to packed sequences: toxicity, exact copies, near copies, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm.common import checkpointed
from tidebar.llm.exact_dedup import drop_exact_duplicates
from tidebar.llm.packing import pack, read_vocabulary
from tidebar.llm.secrets import redact_secrets
from tidebar.llm.simhash import drop_near_duplicates
from tidebar.llm.toxicity import drop_toxic


#: Bytes of text that packing takes at once; its workers share an executor with what the earlier stages left there.
PACKED_BYTES = 1 << 20


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels finds toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles of similarity 0.8 or more: found by their SimHashes,
    and by shared rare shingles where these lie too far apart."""
    return drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as sequences of ids without padding."""
    return pack(docs, read_vocabulary(), word_block=PACKED_BYTES)


STAGES = [
    ("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash", near_stage), ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
