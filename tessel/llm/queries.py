"""One query per operator, each over its whole table with production parameters, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import secret_scan
from tessel.llm.curriculum import mix
from tessel.llm.gray_simhash import near_duplicates
from tessel.llm.language_gru import identify
from tessel.llm.line_chunks import remove_passages
from tessel.llm.ogg_media import ogg_columns
from tessel.llm.order_minhash import edited_fingerprints
from tessel.llm.piece_bpe import encode_documents
from tessel.llm.shared import read_table
from tessel.llm.toxicity import toxicity
from tessel.llm.weak_quality import quality


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of the two passes as columns, null where a pass doesn't take the document."""
    mixed = mix(read_table(spark, sf_dir, "documents"))
    at = lambda i: F.round(F.try_element_at("positions", F.lit(i)), 9)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times", at(1).alias("first_position"), at(2).alias("second_position"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "removed_chunks", "removed_lines")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_columns(read_table(spark, sf_dir, "documents"))


def op10_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_order_minhash": op2_order_minhash,
    "op3_gray_simhash": op3_gray_simhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_curriculum": op5_curriculum,
    "op6_weak_quality": op6_weak_quality,
    "op7_line_chunks": op7_line_chunks,
    "op8_secret_scan": op8_secret_scan,
    "op9_ogg": op9_ogg,
    "op10_language_gru": op10_language_gru,
}

_AT = "round(CASE WHEN a = b THEN m / target ELSE (sqrt(a * a + 2 * (b - a) * (m / target * (a + b) / 2)) - a) / (b - a) END, 9)"

ORACLES: dict[str, str] = {
    "op8_secret_scan": secret_scan.ORACLE,
    "op5_curriculum": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS slot FROM d GROUP BY source),
w AS (SELECT *, CASE slot % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE slot % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS a, CASE slot % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS b FROM s),
r AS (SELECT *, source_size::DOUBLE / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2) / (sum(weight) OVER after)::DOUBLE AS level FROM w WINDOW before AS (ORDER BY source_size::DOUBLE / weight, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY source_size::DOUBLE / weight, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
line AS (SELECT level FROM r WHERE level * weight < source_size * 2 ORDER BY ratio, slot LIMIT 1),
t AS (SELECT source, source_size, a, b, least(source_size * 2::DOUBLE, coalesce((SELECT level FROM line) * weight, source_size * 2::DOUBLE)) AS target FROM r),
p AS (SELECT d.doc_id, size, source_size, target, d.source, a, b, sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size / 2::DOUBLE AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, size > 0 AND middle < target AS one, size > 0 AND middle + source_size < target AS two FROM p)
SELECT doc_id, size, source_size, target, (size * (one::BIGINT + two::BIGINT))::BIGINT AS taken, source, (one::BIGINT + two::BIGINT)::BIGINT AS times,
CASE WHEN one THEN {_AT.replace("m /", "middle /")} END AS first_position, CASE WHEN two THEN {_AT.replace("m /", "(middle + source_size) /")} END AS second_position FROM q""",
}
