"""Queries over ``pages`` and ``conversations``, and those that look for values inside ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import sitelines
from tickloom.llm.chat import read_written, written
from tickloom.llm.htmllstm import main_text
from tickloom.llm.pii import pseudonymised
from tickloom.llm.registry import query, table
from tickloom.llm.secretscan import secret_report

#: The key of the query; a production run passes its own secret.
PII_KEY = "corpus-pseudonyms-1"


@query("op1_feistel_pseudonyms")
def op1_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonymised(table(spark, sf, "documents"), PII_KEY).select("doc_id", "text", "n_pseudonyms")


@query("op4_site_lines", sitelines.SQL)
def op4_site_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sitelines.without_boilerplate(table(spark, sf, "pages"))


@query("op6_page_text")
def op6_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations and number -1, whose texts consist of control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(rows)


@query("op7_prefix_examples")
def op7_prefix_examples(spark: SparkSession, sf: str) -> DataFrame:
    return read_written(written(with_probe(table(spark, sf, "conversations"))))


@query("op9_linked_secrets")
def op9_linked_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_report(table(spark, sf, "documents"))
