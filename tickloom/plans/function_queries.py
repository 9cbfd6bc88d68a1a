"""Functions, news, documents and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import dates, docs, labels, text, tickers
from tickloom.operators import news as N
from tickloom.operators import runs as R
from tickloom.operators import signals as G
from tickloom.operators.scenarios import latest_price
from tickloom.plans.quality_queries import rounded
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.views import bars_day, news, runs, steps, table, ticks, using

_KNOWN = [*tickers.BASE_SYMBOLS, *tickers.STABLECOINS]
_LIST = "[" + ", ".join(f"'{k}'" for k in _KNOWN) + "]"
_BASES = "[" + ", ".join(f"'{k}'" for k in tickers.BASE_SYMBOLS) + "]"
_FORMS = ["", "-USD", "USDT", "USD", "BUSD", "-USDT", "W", "ST", "/EUR"]

_SPELLED = f"""spelled AS (SELECT p_partkey, b AS known, CASE p_partkey % 9 """ + " ".join(
    f"WHEN {i} THEN " + (f"'{f}' || b" if f in ("W", "ST") else f"' ' || lower(b) || '{f}'") for i, f in enumerate(_FORMS)) + f""" END AS ticker
  FROM (SELECT p_partkey, ({_LIST})[1 + p_partkey % {len(_KNOWN)}] AS b FROM part))"""
_BASE_SQL = f"""base AS (SELECT p_partkey, ticker, t, CASE WHEN list_contains({_LIST}, t) THEN t
  WHEN list_contains({_LIST}, regexp_replace(t, '(USDT)$', '')) THEN regexp_replace(t, '(USDT)$', '')
  WHEN list_contains({_LIST}, regexp_replace(t, '(-USD)$', '')) THEN regexp_replace(t, '(-USD)$', '')
  WHEN list_contains({_LIST}, regexp_replace(t, '(USD)$', '')) THEN regexp_replace(t, '(USD)$', '')
  WHEN list_contains({_LIST}, regexp_replace(t, '(-USDT)$', '')) THEN regexp_replace(t, '(-USDT)$', '')
  WHEN list_contains({_LIST}, regexp_replace(t, '(BUSD)$', '')) THEN regexp_replace(t, '(BUSD)$', '')
  WHEN t[1] = 'W' AND list_contains({_BASES}, t[2:]) THEN t[2:]
  WHEN t[1:2] = 'ST' AND list_contains({_BASES}, t[3:]) THEN t[3:] ELSE t END AS base
  FROM (SELECT *, upper(trim(ticker)) AS t FROM spelled))"""


def spelled(spark, sf):
    known = F.array(*[F.lit(k) for k in _KNOWN])
    b = F.get(known, (F.col("p_partkey") % len(_KNOWN)).cast("int"))
    form = F.lit(None).cast("string")
    for i, f in reversed(list(enumerate(_FORMS))):
        spelling = F.concat(F.lit(f), b) if f in ("W", "ST") else F.concat(F.lit(" "), F.lower(b), F.lit(f))
        form = F.when(F.col("p_partkey") % len(_FORMS) == i, spelling).otherwise(form)
    return table(spark, sf, "part").select("p_partkey", form.alias("ticker"))


@query("f1_base_symbol", f"WITH {_SPELLED}, {_BASE_SQL} SELECT p_partkey, ticker, base FROM base")
def f1(spark, sf):
    return spelled(spark, sf).withColumn("base", tickers.base_symbol(F.col("ticker")))


@query("f2_format_ticker", f"""WITH {_SPELLED}, {_BASE_SQL} SELECT p_partkey, ticker,
  CASE WHEN t LIKE '%-USD' THEN t ELSE base || '-USD' END AS yf,
  CASE WHEN t LIKE '%USDT' THEN t WHEN base = 'USDT' THEN 'USDTBUSD' ELSE base || 'USDT' END AS bn, base AS other FROM base""")
def f2(spark, sf):
    t = F.col("ticker")
    return spelled(spark, sf).withColumns({
        "yf": tickers.format_ticker(t, F.lit("yfinance")), "bn": tickers.format_ticker(t, F.lit("binance")),
        "other": tickers.format_ticker(t, F.lit("paper"))})


_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tickers.COMMON_NAMES.items()) + "}"


@query("f3_common_name", f"""WITH {_SPELLED}, {_BASE_SQL} SELECT p_partkey, coalesce(element_at({_NAMES}, base)[1], base) AS name,
  upper(ticker) = base || '-USD' AS valid_yf FROM base""".replace("element_at(" + _NAMES + ", base)[1]", f"{_NAMES}[base]"))
def f3(spark, sf):
    t = F.col("ticker")
    return spelled(spark, sf).select(
        "p_partkey", tickers.common_name(t).alias("name"),
        tickers.is_valid_ticker(t, F.lit("yfinance")).alias("valid_yf"))


@query("f6_suffix_and_lists", """SELECT p_partkey, regexp_replace(regexp_replace(p_brand || '-USD' || CASE p_partkey % 2 WHEN 0 THEN '_yf' ELSE '_bn' END, '_yf|_bn', '', 'g'), '-USD', '', 'g') AS clean,
  unnest([trim(x) FOR x IN string_split(p_name || ', ' || p_type || ',,', ',') IF trim(x) <> '']) AS item FROM part""")
def f6(spark, sf):
    p = table(spark, sf, "part")
    suffix = F.when(F.col("p_partkey") % 2 == 0, "_yf").otherwise("_bn")
    return p.select(
        "p_partkey", tickers.strip_suffix(F.concat(F.col("p_brand"), F.lit("-USD"), suffix)).alias("clean"),
        F.explode(tickers.split_list(F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(",,")))).alias("item"))


@query("f7_dates", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, epoch_us(ts) // 1000 AS ms, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S') AS back,
  strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') AS first_forecast, strftime(CAST(ts AS DATE) + 7, '%Y-%m-%d') AS last_forecast FROM events""")
def f7(spark, sf):
    days = dates.forecast_dates(F.to_date("ts"), F.lit(7))
    return ticks(spark, sf).select(
        "event_id", dates.day_text(F.col("ts")).alias("d"), F.unix_millis("ts").alias("ms"),
        F.date_format(dates.from_epoch_millis(F.unix_millis("ts")), "yyyy-MM-dd HH:mm:ss").alias("back"),
        F.date_format(days[0], "yyyy-MM-dd").alias("first_forecast"),
        F.date_format(F.element_at(days, -1), "yyyy-MM-dd").alias("last_forecast"))


@query("f8_intervals", """SELECT p_partkey, label, CASE WHEN label = '1h' THEN '60m' WHEN label = '9x' THEN NULL ELSE label END AS yf,
  CASE label WHEN '1wk' THEN '1w' WHEN '1mo' THEN '1M' WHEN '9x' THEN NULL ELSE label END AS bn,
  CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 365 ELSE 90 END AS days FROM
  (SELECT *, (['1m','5m','15m','30m','1h','1d','1wk','1mo','9x'])[1 + p_partkey % 9] AS label FROM part)""")
def f8(spark, sf):
    names = F.array(*[F.lit(x) for x in "1m 5m 15m 30m 1h 1d 1wk 1mo 9x".split()])
    k = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    period = F.when(k == 0, F.concat(size, F.lit("d"))).when(k == 1, F.concat(size, F.lit("y"))).otherwise("max")
    d = table(spark, sf, "part").withColumn("label", F.get(names, (F.col("p_partkey") % 9).cast("int")))
    return d.select("p_partkey", "label", dates.source_interval(F.col("label"), F.lit("yfinance")).alias("yf"),
                    dates.source_interval(F.col("label"), F.lit("binance")).alias("bn"),
                    dates.period_days(period).alias("days"))


@query("f9_math", f"""SELECT event_id, {r('round(value, 2)', 2)} AS rounded, {r('sqrt(abs(value))')} AS root, {r('pow(1 + value / 10000, 12)')} AS compounded,
  {r('sign(value - 50)', 0)} AS side, {r('least(greatest(value, 10), 90)')} AS clipped FROM events""")
def f9(spark, sf):
    v = F.col("price")
    return ticks(spark, sf).select(
        "event_id", rnd(v, 2).alias("rounded"), rnd(F.sqrt(F.abs(v))).alias("root"),
        rnd(F.pow(1 + v / 10000, F.lit(12))).alias("compounded"), rnd(F.signum(v - 50), 0).alias("side"),
        rnd(F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0))).alias("clipped"))


@query("f10_json", using("ticks", """SELECT event_id, props ->> '$.k' AS k_text, CAST(props ->> '$.k' AS BIGINT) * 2 AS k_twice,
  '{"id":' || event_id || ',"kind":"' || ticker || '"}' AS document FROM ticks"""))
def f10(spark, sf):
    k = docs.typed(F.col("props"), "k bigint")["k"]
    return ticks(spark, sf).select(
        "event_id", docs.field(F.col("props"), "k").alias("k_text"), (k * 2).alias("k_twice"),
        docs.to_document(id=F.col("event_id"), kind=F.col("ticker")).alias("document"))


@query("f11_pack_points", using("bars_day", f"""SELECT ticker, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day,
  count(*) AS points, {r('sum(close)', 2)} AS total FROM bars_day GROUP BY ticker, date_trunc('month', ts)"""))
def f11(spark, sf):
    p = docs.pack_points(bars_day(spark, sf), "close")
    total = F.aggregate("data_points", F.lit(0.0), lambda acc, x: acc + x["value"])
    return p.select("ticker", F.date_format("timestamp_start", "yyyy-MM-dd").alias("first_day"),
                    F.date_format("timestamp_end", "yyyy-MM-dd").alias("last_day"),
                    F.size("data_points").cast("long").alias("points"), rnd(total, 2).alias("total"))


@query("f11_unpack_points", using("bars_day", f"SELECT ticker, {DAY}, {r('close')} AS close FROM bars_day"))
def f11_back(spark, sf):
    p = docs.pack_points(bars_day(spark, sf), "close")
    return docs.unpack_points(p).select("ticker", day(), rnd("value").alias("close"))


_RULES = """SELECT event_id, signal, {conf} AS confidence, CASE signal WHEN 'BUY' THEN 0.05 WHEN 'SELL' THEN -0.03 ELSE 0.0 END AS expected_return,
  {stop} AS stop_loss, CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS code FROM
  (SELECT *, CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS signal, event_id % 101 AS rsi FROM ticks)"""


@query("f13_signal_rules", using("ticks", _RULES.format(
    conf=r("least(0.7 + CASE WHEN (signal = 'BUY' AND rsi < 30) OR (signal = 'SELL' AND rsi > 70) THEN 0.2 ELSE 0 END, 1)"),
    stop=r("CASE WHEN signal = 'BUY' THEN price * 0.95 ELSE price * 1.05 END")).replace(
        "0.05 WHEN 'SELL' THEN -0.03 ELSE 0.0 END", "CAST(0.05 AS DOUBLE) WHEN 'SELL' THEN CAST(-0.03 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")))
def f13(spark, sf):
    k = F.col("event_id") % 3
    s = F.when(k == 0, "BUY").when(k == 1, "SELL").otherwise("HOLD")
    return ticks(spark, sf).withColumn("signal", s).select(
        "event_id", "signal", rnd(labels.confidence(F.col("signal"), F.col("event_id") % 101)).alias("confidence"),
        labels.expected_return(F.col("signal")).alias("expected_return"),
        rnd(labels.stop_loss(F.col("signal"), F.col("price"))).alias("stop_loss"),
        labels.signal_code(F.col("signal")).alias("code"))


@query("f14_find_documents", using("ticks", """SELECT event_id, props FROM ticks WHERE ticker = 'click' AND props ->> '$.k' = '42' ORDER BY ts DESC, event_id DESC LIMIT 15"""))
def f14(spark, sf):
    d = ticks(spark, sf).select(F.col("ticker").alias("collection"), F.col("event_id").alias("document_id"),
                                F.col("props").alias("data"), F.col("ts").alias("created_at"))
    return docs.find_documents(d, "click", {"k": 42}, 15).select(
        F.col("document_id").alias("event_id"), F.col("data").alias("props"))


@query("f15_projection", using("bars_day", f"""SELECT ticker, signal, CAST(i AS INTEGER) AS step, {r('price * (1 + i * 0.01)')} AS price,
  {r("greatest(0.1, CASE signal WHEN 'HOLD' THEN 0.6 ELSE 0.8 END - i * 0.05)")} AS confidence,
  {r("CASE signal WHEN 'BUY' THEN 0.03 WHEN 'SELL' THEN -0.02 ELSE 0 END")} AS expected_return,
  CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS code
  FROM (SELECT ticker, arg_max(close, ts) AS price, CASE length(ticker) % 2 WHEN 0 THEN 'BUY' ELSE 'SELL' END AS signal FROM bars_day GROUP BY ticker), range(0, 14) t(i)"""))
def f15(spark, sf):
    last = latest_price(bars_day(spark, sf))
    s = last.select("ticker", F.when(F.length("ticker") % 2 == 0, "BUY").otherwise("SELL").alias("signal"))
    return G.projection(last, s, 14).select(
        "ticker", "signal", "step", *rounded(["price", "confidence", "expected_return"]), "code")


@query("f16_relative_age", using("ticks", """SELECT event_id, CASE WHEN m < 60 THEN m || ' minutes ago' WHEN m < 1440 THEN (m // 60) || ' hours ago' ELSE (m // 1440) || ' days ago' END AS age,
  CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 30 ELSE 7 END AS days FROM
  (SELECT event_id, (CAST(floor(epoch(TIMESTAMP '2024-02-01')) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) // 60 AS m FROM ticks)"""))
def f16(spark, sf):
    k = F.col("event_id") % 4
    frame = F.when(k == 0, "week").when(k == 1, "2weeks").when(k == 2, "month").otherwise("year")
    now = F.lit("2024-02-01").cast("timestamp")
    return ticks(spark, sf).select("event_id", dates.relative_age(F.col("ts"), now).alias("age"),
                                   dates.timeframe_days(frame).alias("days"))


# words that occur in the given documents; the default good and bad words do not
GOOD, BAD = ["tion", "the", "que"], ["ment", "ung", "eau", "ing"]


def _hits(words, col="txt"):
    return " + ".join(f"CAST(contains(lower({col}), '{w}') AS INTEGER)" for w in words)


_TXT = "txt AS (SELECT link, published, title || ' ' || description AS txt FROM news)"
_TAGGED = "tagged AS (SELECT link, published, txt, [x FOR x IN [" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(txt), '{w}')" for w in ws) + f" THEN '{t}' END"
    for t, ws in text.TICKER_KEYWORDS.items()) + "] IF x IS NOT NULL] AS tags FROM txt)"
_SCORED = f"scored AS (SELECT *, CASE WHEN g + b = 0 THEN 0 ELSE (g - b) / (g + b) END AS score FROM (SELECT *, CAST({_hits(GOOD)} AS DOUBLE) AS g, CAST({_hits(BAD)} AS DOUBLE) AS b FROM tagged))"


@query("f4_tag_entities", using("news", "SELECT link, array_to_string(tags, ',') AS tags FROM tagged", _TXT, _TAGGED))
def f4(spark, sf):
    return N.tagged(news(spark, sf)).select("link", F.array_join("tags", ",").alias("tags"))


_WORD_LEXICON = {"FR": ["le", "de", "et"], "EN": ["the", "and", "of"], "XX": ["bitcoin"]}


@query("f4_tag_words", using("news", """SELECT link, array_to_string([x FOR x IN [""" + ", ".join(
    "CASE WHEN " + " OR ".join(f"list_contains(words, '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in _WORD_LEXICON.items())
    + r"""] IF x IS NOT NULL], ',') AS tags FROM (SELECT link, regexp_split_to_array(lower(txt), '[^\p{L}\p{N}₿]+') AS words FROM txt)""", _TXT))
def f4_words(spark, sf):
    return N.tagged(news(spark, sf), _WORD_LEXICON, "word").select("link", F.array_join("tags", ",").alias("tags"))


@query("f5_sentiment", using("news", f"SELECT link, {r('score')} AS score FROM scored", _TXT, _TAGGED, _SCORED))
def f5(spark, sf):
    return N.scored(news(spark, sf), GOOD, BAD).select("link", rnd("score").alias("score"))


@query("t6_ticker_news", using("news", "SELECT link FROM tagged WHERE list_contains(tags, 'ETH') ORDER BY published DESC, link LIMIT 20", _TXT, _TAGGED))
def t6(spark, sf):
    return N.ticker_news(N.tagged(news(spark, sf)), "ETH", 20).select("link")


def _mood(where):
    return f"""SELECT {r('coalesce(avg(score), 0)')} AS sentiment_score, CASE WHEN avg(score) IS NULL THEN 'Unknown' WHEN avg(score) > 0.3 THEN 'Very Bullish' WHEN avg(score) > 0.1 THEN 'Bullish'
  WHEN avg(score) > -0.1 THEN 'Neutral' WHEN avg(score) > -0.3 THEN 'Bearish' ELSE 'Very Bearish' END AS market_mood, count(*) AS articles_analyzed
  FROM (SELECT score FROM scored {where} ORDER BY published DESC, link LIMIT 50)"""


@query("a18_market_sentiment", using("news", _mood(""), _TXT, _TAGGED, _SCORED))
def a18(spark, sf):
    n = N.scored(N.tagged(news(spark, sf)), GOOD, BAD)
    return N.market_sentiment(n).withColumn("sentiment_score", rnd("sentiment_score"))


@query("a18_ticker_sentiment", using("news", _mood("WHERE len(tags) = 0 OR list_contains(tags, 'DOT')"), _TXT, _TAGGED, _SCORED))
def a18_dot(spark, sf):
    n = N.scored(N.tagged(news(spark, sf)), GOOD, BAD)
    return N.market_sentiment(n, "DOT").withColumn("sentiment_score", rnd("sentiment_score"))


@query("a23_sentiment_history", using("news", f"SELECT strftime(published, '%Y-%m-%d') AS day, {r('avg(score)')} AS score, count(*) AS items FROM scored GROUP BY 1", _TXT, _TAGGED, _SCORED))
def a23(spark, sf):
    d = N.sentiment_history(N.scored(news(spark, sf), GOOD, BAD))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), rnd("score").alias("score"), "items")


_COUNTS = """counts AS (SELECT r.*, coalesce(s.total, 0) AS total_steps, coalesce(s.done, 0) AS completed_steps, coalesce(s.bad, 0) AS failed_steps,
  coalesce(s.done * 1.0 / s.total, 0) AS success_rate FROM runs r LEFT JOIN (SELECT trace_id, count(*) AS total,
  count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS bad FROM steps GROUP BY trace_id) s USING (trace_id))"""


@query("j5_run_steps", using("runs steps", """SELECT r.trace_id, r.status, s.step_order, s.status AS step_status, CAST(s.step_id AS DOUBLE) AS step_id,
  strftime(s.start_time, '%Y-%m-%d') AS step_day FROM runs r JOIN steps s USING (trace_id)"""))
def j5(spark, sf):
    d = R.run_with_steps(runs(spark, sf), steps(spark, sf)).where(F.col("step_order").isNotNull())
    return d.select("trace_id", "status", "step_order", "step_status", F.col("step_id").cast("double").alias("step_id"),
                    F.date_format("step_start", "yyyy-MM-dd").alias("step_day"))


@query("a15_run_step_counts", using("runs steps", f"SELECT trace_id, status, total_steps, completed_steps, failed_steps, {r('success_rate')} AS success_rate FROM counts", _COUNTS))
def a15(spark, sf):
    d = R.run_step_counts(runs(spark, sf), steps(spark, sf))
    return d.select("trace_id", "status", "total_steps", "completed_steps", "failed_steps", rnd("success_rate").alias("success_rate"))


@query("a16_run_statistics", using("runs steps", f"""SELECT count(*) AS total_executions, count(*) FILTER (status = 'completed') AS completed_executions,
  count(*) FILTER (status = 'failed') AS failed_executions, count(*) FILTER (status = 'running') AS running_executions,
  {r('avg(duration_seconds)', 2)} AS avg_duration_seconds, {r('avg(success_rate)')} AS avg_success_rate FROM counts""", _COUNTS))
def a16(spark, sf):
    d = R.run_statistics(R.run_step_counts(runs(spark, sf), steps(spark, sf)))
    return d.withColumns({"avg_duration_seconds": rnd("avg_duration_seconds", 2), "avg_success_rate": rnd("avg_success_rate")})


@query("a24_run_trends", using("runs steps", f"""SELECT trace_id, strftime(start_time, '%Y-%m-%d') AS day, {r('success_rate')} AS success_rate, duration_seconds
  FROM (SELECT * FROM counts ORDER BY start_time DESC, trace_id DESC LIMIT 30) WHERE duration_seconds IS NOT NULL""", _COUNTS))
def a24(spark, sf):
    d = R.run_trends(R.run_step_counts(runs(spark, sf), steps(spark, sf)), 30)
    return d.select("trace_id", F.date_format("start_time", "yyyy-MM-dd").alias("day"), rnd("success_rate").alias("success_rate"), "duration_seconds")
