"""News: tagging, mood and history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.labels import market_mood
from tickloom.functions.text import (
    NEGATIVE_WORDS, POSITIVE_WORDS, TICKER_KEYWORDS, sentiment, tag_entities,
)


def _with_text(news: DataFrame) -> DataFrame:
    """Adds the lower-case text as a column, which all the word conditions read."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return news.withColumn("_text", F.lower(text))


def tagged(news: DataFrame, lexicon: Mapping[str, Sequence[str]] = TICKER_KEYWORDS, mode: str = "substring") -> DataFrame:
    tags = tag_entities(F.col("_text"), lexicon, mode, lowered=True)
    return _with_text(news).withColumn("tags", tags).drop("_text")


def scored(news: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
           mode: str = "substring") -> DataFrame:
    score = sentiment(F.col("_text"), positive, negative, mode, lowered=True)
    return _with_text(news).withColumn("score", score).drop("_text")


def ticker_news(news: DataFrame, ticker: str, n: int = 20) -> DataFrame:
    """The newest ``n`` tagged items that mention the ticker."""
    return news.where(F.array_contains("tags", ticker)).orderBy(F.col("published").desc(), "link").limit(n)


def market_sentiment(news: DataFrame, ticker: str | None = None, n: int = 50) -> DataFrame:
    """Mean score and mood of the newest ``n`` items; with a ticker, of its items and untagged ones."""
    d = news
    if ticker is not None:
        d = d.where((F.size("tags") == 0) | F.array_contains("tags", ticker))
    d = d.orderBy(F.col("published").desc(), "link").limit(n)
    return d.agg(F.avg("score").alias("_s"), F.count(F.lit(1)).alias("articles_analyzed")).select(
        F.coalesce("_s", F.lit(0.0)).alias("sentiment_score"), market_mood(F.col("_s")).alias("market_mood"),
        "articles_analyzed")


def sentiment_history(news: DataFrame) -> DataFrame:
    return news.groupBy(F.to_date("published").alias("day")).agg(
        F.avg("score").alias("score"), F.count(F.lit(1)).alias("items"))
