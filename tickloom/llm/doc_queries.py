"""Queries over ``documents``, with the SQL twins of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.langmask import identify, learn
from tickloom.llm.mixture import mix_sources
from tickloom.llm.ngramjoin import jaccard_components
from tickloom.llm.quotient import exact_duplicates
from tickloom.llm.registry import query, table
from tickloom.llm.tiling import leaked_items

#: The tree of the mix: a domain for groups of sources, then language, then source.
DOMAIN_WEIGHTS = {"crawl": 0.45, "books": 0.3, "forum": 0.25}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 3, 17


def mix_levels() -> dict[str, Column]:
    number = F.expr("try_cast(substring(source, 4) as int)")
    domain = (F.when(number.isNull(), "crawl").when(number % 3 == 0, "crawl")
              .when(number % 3 == 1, "books").otherwise("forum"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return mix_sources(docs, mix_levels(), [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}], MIX_SHARE, MIX_EPOCHS, MIX_SEED, carry=carry)


def _weights(col: str, w: dict[str, float]) -> str:
    cases = " ".join(f"WHEN {col} = '{k}' THEN {round(v * 1_000_000)}" for k, v in w.items())
    return f"CAST(CASE {cases} ELSE 1000000 END AS HUGEINT)" if cases else "CAST(1000000 AS HUGEINT)"


def _level(name: str, keys: list[str], w: dict[str, float], out: str) -> str:
    """One level of the tree; every step mirrors a definition of the mix, in integers."""
    up, all_keys = ", ".join(keys[:-1]) or "1", ", ".join(keys)
    budget = (f"FROM (SELECT {all_keys}, sum(cap) AS cap FROM leaves GROUP BY {all_keys}) n "
              + (f"JOIN (SELECT {up}, amount AS budget FROM {name}) b USING ({up})" if len(keys) > 1 else ", total"))
    side = f"PARTITION BY {up} ORDER BY fill, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""{out}_a AS (SELECT *, {_weights(keys[-1], w)} AS w,
      CAST(cap AS DOUBLE) / CAST({_weights(keys[-1], w)} AS DOUBLE) AS fill {budget}),
    {out}_b AS (SELECT *, sum(w) OVER (PARTITION BY {up}) - coalesce(sum(w) OVER ({side} 1 PRECEDING), 0) AS left_w,
      budget - coalesce(sum(cap) OVER ({side} 1 PRECEDING), 0) AS left_b FROM {out}_a),
    {out}_c AS (SELECT *, min(CASE WHEN CAST(cap AS HUGEINT) * left_w <= w * left_b THEN 1 ELSE 0 END)
      OVER ({side} CURRENT ROW) AS is_full FROM {out}_b),
    {out}_d AS (SELECT *, greatest(budget - coalesce(sum(CASE WHEN is_full = 1 THEN cap END) OVER (PARTITION BY {up}), 0), 0) AS rest_b,
      coalesce(sum(CASE WHEN is_full = 0 THEN w END) OVER (PARTITION BY {up}), 0) AS rest_w,
      coalesce(sum(CASE WHEN is_full = 0 THEN w END) OVER ({side} CURRENT ROW), 0) AS upto FROM {out}_c),
    {out} AS (SELECT {all_keys}, cap, CAST(CASE WHEN is_full = 1 THEN cap
      ELSE (CAST(upto AS HUGEINT) * CAST(rest_b AS HUGEINT)) // CAST(greatest(rest_w, 1) AS HUGEINT)
         - (CAST(upto - w AS HUGEINT) * CAST(rest_b AS HUGEINT)) // CAST(greatest(rest_w, 1) AS HUGEINT) END AS BIGINT) AS amount
      FROM {out}_d)"""


MIX_SQL = rf"""WITH light AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      CASE WHEN TRY_CAST(substring(source, 4) AS INTEGER) IS NULL OR TRY_CAST(substring(source, 4) AS INTEGER) % 3 = 0 THEN 'crawl'
        WHEN TRY_CAST(substring(source, 4) AS INTEGER) % 3 = 1 THEN 'books' ELSE 'forum' END AS domain,
      CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) AS BIGINT) * {MIX_EPOCHS} AS cap
      FROM light GROUP BY ALL HAVING sum(tokens) > 0),
    total AS (SELECT CAST((sum(supply) * {round(MIX_SHARE * 1000)}) // 1000 AS BIGINT) AS budget FROM leaves),
    {_level("total", ["domain"], DOMAIN_WEIGHTS, "l1")},
    {_level("l1", ["domain", "lang"], LANG_WEIGHTS, "l2")},
    {_level("l2", ["domain", "lang", "source"], {}, "l3")},
    cut AS (SELECT domain, lang, source, amount // supply AS whole, amount % supply AS rest
      FROM l3 JOIN leaves USING (domain, lang, source) WHERE amount > 0),
    due AS (SELECT * FROM light JOIN cut USING (domain, lang, source) WHERE tokens > 0),
    last AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5(concat_ws('|', '{MIX_SEED}', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id, tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM due WHERE rest > 0)
    SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, tokens, tokens AS take_tokens
      FROM due, generate_series(0, {MIX_EPOCHS}) AS g(e) WHERE e < whole
    UNION ALL
    SELECT doc_id, domain, lang, source, CAST(whole AS INTEGER), tokens, CAST(least(tokens, rest - before) AS BIGINT)
      FROM last WHERE before < rest"""


@query("op2_source_mix", MIX_SQL)
def op2_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(table(spark, sf, "documents"))


@query("op3_benchmark_tiles")
def op3_benchmark_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_quotient_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM n JOIN g USING (body)""")
def op5_quotient_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(table(spark, sf, "documents"))


@query("op8_ngram_components")
def op8_ngram_components(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"), words=4, percent=85)


def language_split(docs: DataFrame) -> DataFrame:
    """Whether a document is held out of learning: crc32 of its identifier's digits leaves 2 by 4 (never without one)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


@query("op10_language_masks")
def op10_language_masks(spark: SparkSession, sf: str) -> DataFrame:
    docs = language_split(table(spark, sf, "documents"))
    masks = learn(docs.where("not held_out").select("lang", "text"))
    return identify(docs, masks, keep=("doc_id", "held_out"))
