"""Queries that mine phrases, urls and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import collocations, hardneg, urlwords
from tickloom.llm.registry import query, table


def shifted_label() -> Column:
    """The label of the query: every seventh row is moved to the next one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@query("op13_hard_negatives", hardneg.SQL)
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hardneg.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, shifted_label())


@query("op12_url_words")
def op12_url_words(spark: SparkSession, sf: str) -> DataFrame:
    return urlwords.judged(table(spark, sf, "pages"))


@query("op11_collocations", collocations.SQL)
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))
