"""Training-data pipeline over ``documents``: quality, near-duplicates, benchmark passages, personal data, piece encoding.

Each stage takes the rows its predecessor kept, with the columns of ``documents``; the last returns ids. A stage's result is written as
Parquet in the shared folder and read again as the next one's input.

Rows: NULL and empty texts are no near-duplicates, hold no passage and no personal data, and encode to no ids; the classifier judges them
like any text. Rows with a NULL id stay. Rows that share an id are judged by the id: they go or stay together. Without labels nothing is
rejected. Columns beside ``text`` and ``n_chars`` pass unread. Empty tables give no rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabreg.llm.common import cut_lineage, table
from tabreg.llm.decontaminate import without_passages
from tabreg.llm.minhash import keep_one_of_each_group
from tabreg.llm.pieces import encode_pieces
from tabreg.llm.pii import mask_documents
from tabreg.llm.quality import keep_good

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return keep_one_of_each_group(docs, shingle=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return mask_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document."""
    return encode_pieces(docs, MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("encoding", encoding)]
ORACLE_SQL = None  # learned scores, estimated reliabilities and subword merges have no SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
