"""From raw documents to tokens: quality, repeated lines, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. A stage first lets go of what the driver still holds of the one before: plans,
broadcast tables and shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifline.llm import bagminhash, bpe, lines, raking, weaklabels
from motifline.llm.common import free_shuffles, table
from motifline.plans.blocks import stage

#: Expected share of the tokens that the mixture keeps.
KEPT_TOKENS = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return weaklabels.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has, up to two edits, go; so do documents left without a line."""
    free_shuffles(spark)
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    free_shuffles(spark)
    return bagminhash.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target shares."""
    free_shuffles(spark)
    return raking.sample(docs, KEPT_TOKENS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the tokens of each text and their number."""
    import public_tokenizers

    free_shuffles(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Expectation maximisation, minwise signatures and encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
