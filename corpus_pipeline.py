"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, then the mix of sources.

Every stage works on all rows its predecessor kept and takes effect; ``run`` applies them to ``documents``. The
language masks are learned from the stage's own documents. The duplicate stages and the mix know rows by their file and
place in it, not by ``doc_id`` and not by the task that reads them: of every group exactly one row stays, that of the
smallest identifier, nulls last, of equal identifiers the first row. So a table loaded twice is left once, and rows that
only share an identifier stay. A null text is an empty one (and has no language, so the first stage rejects it). The last
stage returns the texts to train on, each cut to the tokens taken from it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.doc_queries import language_split, mixed
from tickloom.llm.langmask import UNKNOWN, identify, learn
from tickloom.llm.ngramjoin import jaccard_components
from tickloom.llm.quotient import exact_duplicates
from tickloom.llm.registry import table
from tickloom.llm.sizes import small_side
from tickloom.llm.tiling import without_leaks
from tickloom.session import checkpointed, scratch_path

#: Texts whose score is lower fit no language that the corpus has.
LEAST_SCORE = 0.1
#: Near copies share four fifths of their shingles of five words; op8 has its own pair.
NEAR_WORDS, NEAR_PERCENT = 5, 80
ROW, FILE = "_row_of_stage", "_file_of_stage"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that fit no learned language."""
    _modest(spark)
    masks = learn(language_split(docs).where("not held_out").select("lang", "text"))
    found = identify(docs, masks, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of every row that is the same however the input is split into tasks: the number of its
    file and its place in it. Rows that come from no file are written first."""
    try:
        files = docs.select("_metadata.file_path").distinct()
        named = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return checkpointed(docs.withColumn(ROW, F.monotonically_increasing_id()))
    numbers = checkpointed(files.select(F.col("file_path").alias(FILE), (
        (F.row_number().over(Window.orderBy("file_path")) - 1) * F.lit(1 << 36)).alias("_first")))
    return named.join(F.broadcast(numbers), FILE).withColumn(ROW, F.col("_first") + F.col(ROW)).drop(FILE, "_first")


def _modest(spark: SparkSession) -> None:
    """Smaller batches to Python: every worker and the executor itself hold several of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Numbered ``docs`` without those rows of ``groups`` (row, ``group``) that are not the first of their group."""
    groups = checkpointed(groups)
    named = groups.join(docs.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW))
    firsts = named.groupBy("group").agg(first.alias("first")).select(F.col("first")[ROW].alias(ROW))
    gone = checkpointed(groups.select(ROW).join(firsts, ROW, "left_anti"))
    return docs.join(small_side(gone), ROW, "left_anti").drop(ROW)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the smallest ``doc_id``."""
    _modest(spark)
    rows = _numbered(docs)
    copies = exact_duplicates(rows, id_col=ROW).where("group_size > 1")
    return _one_of_each(rows, copies.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents one row stays, with the smallest ``doc_id``."""
    _modest(spark)
    rows = _numbered(docs)
    linked = jaccard_components(rows, id_col=ROW, words=NEAR_WORDS, percent=NEAR_PERCENT)
    return _one_of_each(rows, linked.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _modest(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row per document and epoch, with its text cut to the tokens to use."""
    _modest(spark)
    rows = _numbered(docs)
    chosen = checkpointed(mixed(rows, carry=(ROW,)))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("take_tokens").cast("int")), "")
    texts = rows.select(ROW, "text")
    return texts.join(small_side(chosen), ROW).withColumn(
        "text", F.when(F.col("take_tokens") < F.col("tokens"), cut).otherwise(F.col("text"))).withColumnRenamed(ROW, "row_id")


STAGES = [("language", language), ("exact", exact), ("near", near), ("leaks", leaks), ("mix", mix)]

#: Learned masks, shingle components and tiles are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
