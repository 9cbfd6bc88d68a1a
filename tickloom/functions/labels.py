"""Labels and rules on single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_strength(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size >= 0.7, "Strong").when(size >= 0.4, "Moderate").otherwise("Weak")


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.3, "Positive").when(score < -0.3, "Negative").otherwise("Neutral")


def market_mood(score: Column) -> Column:
    return (
        F.when(score.isNull(), "Unknown").when(score > 0.3, "Very Bullish").when(score > 0.1, "Bullish")
        .when(score > -0.1, "Neutral").when(score > -0.3, "Bearish").otherwise("Very Bearish"))


def risk_score(volatility: Column) -> Column:
    return F.least(volatility * 10, F.lit(1.0))


def risk_level(score: Column) -> Column:
    return F.when(score > 0.7, "High").when(score > 0.4, "Medium").otherwise("Low")


def confidence(signal: Column, rsi: Column) -> Column:
    """0.7, and 0.2 more where the index confirms the signal; at most 1."""
    confirmed = ((signal == "BUY") & (rsi < 30)) | ((signal == "SELL") & (rsi > 70))
    return F.least(F.lit(0.7) + F.when(confirmed, 0.2).otherwise(0.0), F.lit(1.0))


def expected_return(signal: Column, buy: float = 0.05, sell: float = -0.03) -> Column:
    return F.when(signal == "BUY", buy).when(signal == "SELL", sell).otherwise(0.0)


def stop_loss(signal: Column, price: Column) -> Column:
    """Five percent below for a BUY, five percent above otherwise."""
    return F.when(signal == "BUY", price * 0.95).otherwise(price * 1.05)


def signal_code(signal: Column) -> Column:
    return F.when(signal == "BUY", 1).when(signal == "SELL", -1).otherwise(0)
