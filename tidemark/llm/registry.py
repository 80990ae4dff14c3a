"""Queries of the text operators over the documents table.

Encoding, packing and language cannot be stated in SQL; two queries check what must hold of them, and SQL
states the counts that a whole and faultless result has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import language, packing, tokens
from tidemark.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """How many texts there are, come back whole from their ids, and are empty with empty ids."""
    docs = table(spark, d, "documents").select("text").withColumn("ids", tokens.encode("text"))
    text = F.coalesce("text", F.lit(""))
    return docs.agg(
        F.count("*").alias("texts"), F.count_if(tokens.decode("ids") == text).alias("whole"), F.count_if((text == "") & (F.size("ids") == 0)).alias("empty")
    )


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed (first parts), texts without tokens, overlaps in containers, containers too full, and whether 98 % is used but for one."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    before = F.lag(F.col("place") + F.col("n_tokens")).over(Window.partitionBy("container_id").orderBy("place", "n_tokens"))
    per = packed.withColumn("clash", before > F.col("place")).groupBy("container_id").agg(
        F.sum("n_tokens").alias("used"), F.count_if("clash").alias("clashes"), F.count_if(F.col("part_no") == 0).alias("first"),
        F.count_if((F.col("part_no") == 0) & (F.col("n_tokens") == 0)).alias("none"),
    )
    return per.agg(
        F.coalesce(F.sum("first"), F.lit(0)).alias("texts"), F.coalesce(F.sum("none"), F.lit(0)).alias("empty"), F.coalesce(F.sum("clashes"), F.lit(0)).alias("overlaps"),
        F.count_if(F.col("used") > packing.CAPACITY).alias("too_full"), F.coalesce(F.sum("used") >= 0.98 * packing.CAPACITY * (F.count("*") - 1), F.lit(True)).alias("well_used"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(language.language_segments(table(spark, d, "documents")))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every one-language stretch of every text, with a confidence."""
    return language.language_segments(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_roundtrip, p9_containers, p9_checks, p10_found, p10_segments)}
ORACLE: dict[str, str] = {
    "p8_roundtrip": "SELECT count(*) AS texts, count(*) AS whole, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty FROM documents",
    "p9_checks": "SELECT count(*) AS texts, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty, 0 AS overlaps, 0 AS too_full, true AS well_used FROM documents",
}
