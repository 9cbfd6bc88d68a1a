"""Url filter: names of hosts and paths split into words, then judged by naive Bayes; fixed rules come first.

Splitting: words of the pages' own texts are counted (each task adds up its own first). A name is a run of letters in a
host or path. Each distinct name's substrings meet the counts in a join, and a Viterbi search takes the cheapest split: a
known word costs the logarithm of its share, an unknown run a fixed price and one for each letter. So ``cheappills``
becomes ``cheap pills`` although no page has that name in two.

Judging: a page belongs to the class to block while learning if a word of its split url is one of the seed words; all
others belong to the class to allow. Multinomial naive Bayes over the words of all pages then decides, so words that
keep company with seeds count as well; a name counts once in a url and a word once in a name, so that one url that says a
word a thousand times doesn't outweigh the others. Smoothing adds ``PRIOR_WORDS`` words of the overall distribution to both classes,
which makes a word that only clean pages have speak for them however rare it is. Logarithms are added as whole
millionths, so the order of rows changes nothing.

Frequent names (at most ``FREQUENT`` can have that share) are broadcast; no other key holds more than that share.

Rows: a null url, or one without ``://``, has an empty host and path and no words (rules and the prior decide); a null
page has no words to count; repeated pages count as often as they come; tables without rows give no rows. Names of any
length are split whole. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sizes import small_side
from tickloom.session import checkpointed

LONGEST = 24              # letters of a known word
UNKNOWN_LETTER = math.log(10)
SEED_SHARE = 1e-5         # share of the running text that a seed word has at least
PRIOR_WORDS = 50.0
FREQUENT = 2000
HELD_WORDS = 100_000      # distinct words that a task holds before it hands them over

#: Words whose presence marks a url while learning; fixed values.
SEEDS = ("adult ads bet bets betting casino dating escort gambling jackpot loans lottery malware nude payday pharmacy "
         "phishing pills poker porn sex slots spam torrent viagra warez xxx").split()
#: (verdict, host, path) of the query; fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

TAGS = re.compile(r"<(?:script|style)\b[^<>]*>[^<]*|<[^<>]*>|&\w+;", re.IGNORECASE)
LETTERS = re.compile(r"[^\W\d_]+")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path as one string) and its verdict; nulls without one."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``word`` and ``n`` over the texts of all pages; words longer than ``LONGEST`` letters are not counted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for html in b.column(0).to_pylist():
                if html:
                    held.update(w for w in LETTERS.findall(TAGS.sub(" ", html).lower()) if len(w) <= LONGEST)
                    if len(held) > HELD_WORDS:
                        yield as_batch(held)
                        held = Counter()
        yield as_batch(held)

    def as_batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          names=["word", "n"])

    texts = pages.select(F.col(html_col).cast("string"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, cells, total: float) -> list[str]:
    """The cheapest split of ``name``; ``cells`` has (place, letters, count) of every known word in it."""
    known: dict[int, list] = {}
    for at, size, n in cells:
        known.setdefault(at + size, []).append((size, n))
    price = math.log(max(total, 2))
    best, run = [0.0], math.inf       # the cheapest split of the first letters; the same with an open unknown run
    back, open_at = [0], 0            # letters of the last piece; where the open run began
    for end in range(1, len(name) + 1):
        fresh = best[end - 1] + price
        if fresh < run:
            run, open_at = fresh, end - 1
        run += UNKNOWN_LETTER
        cost, size = run, end - open_at
        for s, n in sorted(known.get(end, ())):
            c = best[end - s] + price - math.log(n)
            if c < cost:
                cost, size = c, s
        best.append(cost)
        back.append(size)
    words, at = [], len(name)
    while at > 0:
        words.append(name[at - back[at]:at])
        at -= back[at]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name`` and its ``words`` for all distinct names, split by the counts of words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    names = checkpointed(names.select(F.monotonically_increasing_id().alias("id"), "name"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at in range(len(name)):
                    rows.extend((i, at, name[at:at + s]) for s in range(1, min(LONGEST, len(name) - at) + 1))
                    if len(rows) > 20_000:
                        yield as_batch(rows)
                        rows = []
        if rows:
            yield as_batch(rows)

    def as_batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))],
                                          names=["id", "at", "word"])

    places = names.mapInArrow(parts, "id long, at int, word string")
    needed = checkpointed(counts.join(places.select("word").distinct(), "word", "left_semi"))
    cells = places.join(small_side(needed), "word").groupBy("id").agg(
        F.collect_list(F.struct("at", F.length("word").alias("size"), "n")).alias("cells"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [viterbi(name, [(c["at"], c["size"], c["n"]) for c in cells] if cells is not None else (), total)
                     for name, cells in zip(b["name"], b["cells"])]
            yield pd.DataFrame({"name": b["name"], "words": found})

    return names.join(cells, "id", "left").select("name", "cells").mapInPandas(split, "name string, words array<string>")


def _by_name(occurrences: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """``occurrences`` with the columns of ``values`` (name, n, ...), which has every name once."""
    common = F.col("n") * FREQUENT >= total
    others = values.where(~common).drop("n")
    hot = F.broadcast(values.where(common).drop("n").withColumn("hot", F.lit(True)))
    met = occurrences.join(hot, "name", "left")
    rest = met.where("hot is null").select(*occurrences.columns).join(others, "name")
    return met.where("hot").drop("hot").unionByName(rest)


def judged(pages: DataFrame, rules=RULES, seeds=tuple(SEEDS), id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html", prior_words: float = PRIOR_WORDS) -> DataFrame:
    """One row per page: identifier, ``host``, ``path``, the ``rule`` that fits, ``verdict``, and the method's ``log_odds``
    of blocking."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    letters = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(r"(\p{L}+)"), 1))
    urls = checkpointed(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"),
                                     host.alias("host"), path.alias("path"))
                        .withColumn("names", letters))
    named = urls.select("row", F.explode("names").alias("name"))
    uses = named.groupBy("name").agg(F.count("*").alias("n"))

    counts = checkpointed(page_words(pages, html_col))
    running = counts.agg(F.sum("n")).first()[0] or 0
    floor = spark.createDataFrame([(w, max(1, round(running * SEED_SHARE))) for w in seeds], "word string, n long")
    split = segmented(uses.select("name"), counts.unionByName(floor).groupBy("word").agg(F.sum("n").alias("n")))
    split = checkpointed(split.join(uses, "name").withColumn("words", F.array_distinct("words")).withColumn("seeded", F.exists("words", lambda w: w.isin(*seeds))))
    total = split.agg(F.sum("n")).first()[0] or 0

    # pages of the two classes, then words by class
    marked = _by_name(named, split.select("name", "n", "seeded"), total).where("seeded").select("row").distinct()
    classed = urls.join(marked.withColumn("bad", F.lit(1)), "row", "left").select(
        "names", F.coalesce("bad", F.lit(0)).alias("bad"))
    classed = checkpointed(classed)
    size = classed.agg(F.count("*").alias("pages"), F.sum("bad").alias("bad")).first()
    n_bad = size["bad"] or 0
    prior = math.log((n_bad + 1) / (size["pages"] - n_bad + 1))
    uses_by_class = classed.select(F.explode("names").alias("name"), "bad").groupBy("name").agg(
        F.sum("bad").alias("bad"), F.count("*").alias("all"))
    words = checkpointed(split.join(uses_by_class, "name").select(F.explode("words").alias("word"), "bad", "all")
                         .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all")))
    whole = words.agg(F.sum("bad").alias("bad"), F.sum("all").alias("all")).first()
    b, a = float(whole["bad"] or 0), float((whole["all"] or 0) - (whole["bad"] or 0))
    share = F.col("all") / F.lit(max(a + b, 1.0)) * prior_words
    odds = F.log((F.col("bad") + share) / (b + prior_words)) - F.log((F.col("all") - F.col("bad") + share) / (a + prior_words))
    of_word = words.select("word", F.round(odds * 1_000_000).cast("long").alias("odds"))
    of_name = (split.select("name", "n", F.explode("words").alias("word")).join(small_side(of_word), "word")
               .groupBy("name", "n").agg(F.sum("odds").alias("odds")))

    of_page = _by_name(named, checkpointed(of_name), total).groupBy("row").agg(F.sum("odds").alias("odds"))
    odds_of = F.lit(round(prior * 1_000_000)) + F.coalesce("odds", F.lit(0))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    return urls.join(of_page, "row", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(odds_of > 0, "block").otherwise("allow")).alias("verdict"),
        (odds_of / 1_000_000).alias("log_odds"))
