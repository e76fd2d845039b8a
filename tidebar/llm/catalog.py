"""Registered queries of this package and the DuckDB SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm.common import read_table
from tidebar.llm.conversation_trie import conversation_trie
from tidebar.llm.exact_dedup import exact_duplicates
from tidebar.llm.line_dedup import line_dedup_digest
from tidebar.llm.neighbours import nearest
from tidebar.llm.packing import pack, read_vocabulary
from tidebar.llm.pieces import pieces_digest, read_pieces
from tidebar.llm.ppm import lm_scores
from tidebar.llm.quality_rules import quality_rules
from tidebar.llm.recompression import periodic_digest
from tidebar.llm.secrets import secret_digest
from tidebar.llm.sharding import balanced_shards
from tidebar.llm.simhash import simhash_groups
from tidebar.llm.toxicity import toxicity_scores


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(read_table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), read_vocabulary(), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(read_table(spark, sf_dir, "documents"), read_pieces())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("level", "name")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ppm": op2_ppm,
    "op3_secrets": op3_secrets,
    "op4_neighbours": op4_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}

EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def sql() -> dict[str, str]:
    return {"op10_exact_dedup": EXACT_DEDUP_SQL}
