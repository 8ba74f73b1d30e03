"""From documents to encoded training data: five operators in turn, each over all that the one before kept.

Each stage takes texts whole, however long, treats repeated rows each as a row, gives an empty table for an empty one, and
minds no column but doc_id, text, lang and source, whatever the others are called; the operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm.curriculum import training_stream
from tessel.llm.gray_simhash import keep_one
from tessel.llm.line_chunks import remove_passages
from tessel.llm.piece_bpe import encode_documents
from tessel.llm.shared import cut, read_table
from tessel.llm.weak_quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged as empty, equal texts alike."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines or more go from the texts; every document stays, a null text as null."""
    return remove_passages(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; null ids come after others."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; a text without words isn't taken."""
    return training_stream(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the training order with its tokens counted and digested; a null text counts as empty."""
    return encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("encoding", encode)]

#: The classifier, XXH64 and the tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
