"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabreg.llm.alignment import alignment_digests
from tabreg.llm.common import table
from tabreg.llm.decontaminate import find_passages
from tabreg.llm.html_wrappers import main_text
from tabreg.llm.minhash import near_duplicates
from tabreg.llm.mixing import mix_sources
from tabreg.llm.pii import find_personal_data
from tabreg.llm.pieces import round_trip_digests
from tabreg.llm.quality import score_quality
from tabreg.llm.token_files import token_file_digests
from tabreg.llm.toxicity import score_toxicity
from tabreg.llm.vectors import near_duplicate_vectors
from tabreg.llm.web_archive import archive_digests
from tabreg.llm.whitening import whiten

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(table(spark, folder, "documents"), PIECE_MODEL)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents"))


def op7_web_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive_digests(table(spark, folder, "pages"))


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file_digests(table(spark, folder, "documents"), BYTE_MODEL)


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment_digests(table(spark, folder, "documents"), BYTE_MODEL, PIECE_MODEL)


def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality, op2_piece_encoding, op3_toxicity, op4_benchmark_passages, op5_near_vectors, op6_personal_data, op7_web_archive,
        op8_minhash, op9_token_files, op10_main_text, op11_token_alignment, op12_source_mix, op13_whitening)}

ORACLES: dict[str, str] = {
    "op8_minhash": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
""",
}
