"""Keyword tags and sentiment of texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a ticker.
TICKER_KEYWORDS = {
    "BTC": ["bitcoin", "btc", "₿"],
    "ETH": ["ethereum", "eth", "ether"],
    "ADA": ["cardano", "ada"],
    "BNB": ["binance", "bnb"],
    "XRP": ["ripple", "xrp"],
    "SOL": ["solana", "sol"],
    "DOT": ["polkadot", "dot"],
    "DOGE": ["dogecoin", "doge"],
    "AVAX": ["avalanche", "avax"],
    "MATIC": ["polygon", "matic"],
    "LINK": ["chainlink", "link"],
    "UNI": ["uniswap", "uni"],
    "ATOM": ["cosmos", "atom"],
    "LTC": ["litecoin", "ltc"],
    "FIL": ["filecoin", "fil"],
}

# Words of good news.
POSITIVE_WORDS = [
    "bullish", "surge", "rally", "gain", "rise", "growth", "positive", "breakthrough", "adoption", "success",
    "upgrade", "moon", "pump",
]

# Words of bad news.
NEGATIVE_WORDS = [
    "bearish", "crash", "fall", "drop", "decline", "negative", "concern", "risk", "warning", "scam", "hack",
    "loss", "dump", "fear",
]


_EDGE = r"[^\p{L}\p{N}₿]"


def _mentions(low: Column, words: Sequence[str], mode: str) -> list[Column]:
    """One condition per word of a lower-case text: it occurs anywhere or as a whole word."""
    if mode == "substring":
        return [F.contains(low, F.lit(w)) for w in words]
    if mode == "word":
        return [F.contains(low, F.lit(w)) & F.rlike(low, F.lit(rf"(?:^|{_EDGE})\Q{w}\E(?:$|{_EDGE})")) for w in words]
    raise ValueError(f"unknown mode: {mode}")


def tag_entities(text: Column, lexicon: Mapping[str, Sequence[str]] = TICKER_KEYWORDS,
                 mode: str = "substring", lowered: bool = False) -> Column:
    """Names whose words occur in the whole text, in lexicon order.

    With ``lowered`` the text is in lower case already, so that it is converted once and not per word.
    """
    low = text if lowered else F.lower(text)
    tags = []
    for name, words in lexicon.items():
        found = F.lit(False)
        for hit in _mentions(low, words, mode):
            found = found | hit
        tags.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*tags))


def sentiment(text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
              mode: str = "substring", lowered: bool = False) -> Column:
    """(good - bad) / (good + bad) over the distinct words that occur; 0 if none does."""
    low = text if lowered else F.lower(text)
    good = sum((h.cast("int") for h in _mentions(low, positive, mode)), F.lit(0))
    bad = sum((h.cast("int") for h in _mentions(low, negative, mode)), F.lit(0))
    return F.coalesce((good - bad) / F.when(good + bad > 0, good + bad), F.lit(0.0))
