"""Ticker spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known base symbols.
BASE_SYMBOLS = [
    "BTC", "ETH", "BNB", "SOL", "XRP", "ADA", "AVAX", "DOGE", "DOT", "MATIC", "SHIB", "TRX", "LINK", "UNI",
    "ATOM", "XLM", "XMR", "BCH", "LTC", "ETC", "ALGO", "VET", "FIL", "HBAR", "EGLD", "SAND", "MANA", "AXS",
    "THETA", "FTM", "NEAR", "FLOW", "ICP", "APE", "CHZ", "QNT", "GRT", "LDO", "CRV", "AAVE",
]

# Known stable coins.
STABLECOINS = [
    "USDT", "USDC", "BUSD", "DAI", "TUSD", "USDP", "UST",
]

# Display names.
COMMON_NAMES = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "BNB": "Binance Coin", "SOL": "Solana", "XRP": "Ripple",
    "ADA": "Cardano", "AVAX": "Avalanche", "DOGE": "Dogecoin", "DOT": "Polkadot", "MATIC": "Polygon",
    "SHIB": "Shiba Inu", "TRX": "TRON", "LINK": "Chainlink", "UNI": "Uniswap", "ATOM": "Cosmos",
    "XLM": "Stellar", "XMR": "Monero", "BCH": "Bitcoin Cash", "LTC": "Litecoin",
    "ETC": "Ethereum Classic", "USDT": "Tether", "USDC": "USD Coin", "BUSD": "Binance USD", "DAI": "Dai",
}

_ANY = "|".join([*BASE_SYMBOLS, *STABLECOINS])
_QUOTED = rf"^({_ANY})(?:USDT|-USD|USD|-USDT|BUSD)$"
_WRAPPED = rf"^(?:W|ST)({'|'.join(BASE_SYMBOLS)})$"


def base_symbol(ticker: Column) -> Column:
    """The symbol itself: known ones as they are, else without quote currency, else unwrapped."""
    t = F.upper(F.trim(ticker))
    return (
        F.when(t.isin(*BASE_SYMBOLS, *STABLECOINS), t)
        .when(t.rlike(_QUOTED), F.regexp_extract(t, _QUOTED, 1))
        .when(t.rlike(_WRAPPED), F.regexp_extract(t, _WRAPPED, 1))
        .otherwise(t)
    )


def format_ticker(ticker: Column, source: Column) -> Column:
    """``X-USD`` for one source, ``XUSDT`` for the other, the base symbol for any other name."""
    t, src, base = F.upper(F.trim(ticker)), F.lower(source), base_symbol(ticker)
    return (
        F.when((src == "yfinance") & t.endswith("-USD"), t)
        .when(src == "yfinance", F.concat(base, F.lit("-USD")))
        .when((src == "binance") & t.endswith("USDT"), t)
        .when((src == "binance") & (base == "USDT"), F.lit("USDTBUSD"))
        .when(src == "binance", F.concat(base, F.lit("USDT")))
        .otherwise(base)
    )


def common_name(ticker: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in COMMON_NAMES.items() for x in pair])
    base = base_symbol(ticker)
    return F.coalesce(F.element_at(names, base), base)


def is_valid_ticker(ticker: Column, source: Column) -> Column:
    """Whether the ticker is spelled the way the source spells it."""
    return F.upper(ticker) == F.upper(format_ticker(base_symbol(ticker), source))


def strip_suffix(ticker: Column) -> Column:
    """Without the source suffix ``_yf`` / ``_bn`` and without ``-USD``."""
    return F.regexp_replace(F.regexp_replace(ticker, "_yf|_bn", ""), "-USD", "")


def split_list(text: Column) -> Column:
    """A comma list as trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def variants(entity: Column) -> Column:
    """Spellings to try for an entity, most specific first, as an array."""
    clean = F.regexp_replace(entity, "_yf|_bn", "")
    base = base_symbol(clean)
    return F.array(entity, clean, F.concat(base, F.lit("-USD")), F.concat(base, F.lit("USD")),
                   F.concat(base, F.lit("USDT")), base)
