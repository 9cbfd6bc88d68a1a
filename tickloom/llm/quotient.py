"""Exact duplicates by counting quotient filters.

A 64-bit fingerprint of the normalised text is split into a quotient (its home slot) and a remainder.
Every task builds a counting quotient filter of its own rows: a bit for each occupied slot, the length
of each slot's run, the remainders in order, and counters for remainders seen more than once. Filters
are cut into shards by the leading bits of the quotient, and the filters of one shard are merged by
their sorted remainders; slot and remainder together give the fingerprint back, so nothing is lost.
Only fingerprints counted more than once go on to the comparison of whole texts.

Rows: a null text counts as empty; a null identifier takes part (it never is the least one, and a group
of null identifiers only has a null ``keep_id``); of rows that repeat an identifier with equal texts each
stays a row of its own, and all rows with the least identifier are kept. An empty table gives an empty
result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sizes import small_side
from tickloom.session import checkpointed

SLOT_BITS = 12          # slots of one shard
SHARD_ROWS = 1 << 20    # rows expected in one shard
FILTER = "shard int, occupied binary, runs binary, remainders binary, places binary, counts binary"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def build_filter(keys: np.ndarray, counts: np.ndarray, shard_bits: int) -> Iterator[dict]:
    """Filters, one per shard, of sorted distinct fingerprints and their counts."""
    slot_shift = np.uint64(64 - shard_bits - SLOT_BITS)
    shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for part, n in zip(np.split(np.arange(len(keys)), cuts), np.split(counts, cuts)):
        if not len(part):
            continue
        k = keys[part]
        slot = (k >> slot_shift).astype(np.int64) & ((1 << SLOT_BITS) - 1)
        runs = np.bincount(slot, minlength=1 << SLOT_BITS)
        many = np.flatnonzero(n > 1)
        yield {
            "shard": int(shard[part[0]]),
            "occupied": np.packbits(runs > 0).tobytes(),
            "runs": runs[runs > 0].astype("<u4").tobytes(),
            "remainders": (k & ((np.uint64(1) << slot_shift) - np.uint64(1))).astype("<u8").tobytes(),
            "places": many.astype("<u4").tobytes(),
            "counts": n[many].astype("<u8").tobytes(),
        }


def read_filter(shard: int, occupied: bytes, runs: bytes, remainders: bytes, places: bytes, counts: bytes,
                shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of one filter, in order, and their counts."""
    slots = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    slot = np.repeat(slots, np.frombuffer(runs, "<u4")).astype(np.uint64)
    shift = np.uint64(64 - shard_bits - SLOT_BITS)
    keys = np.frombuffer(remainders, "<u8") | (slot << shift)
    if shard_bits:
        keys = keys | (np.uint64(shard) << np.uint64(64 - shard_bits))
    n = np.ones(len(keys), np.int64)
    n[np.frombuffer(places, "<u4")] = np.frombuffer(counts, "<u8")
    return keys, n


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted runs of fingerprints; the counts of equal ones add up."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def repeated_fingerprints(fingerprints: DataFrame, shard_bits: int) -> DataFrame:
    """``fp`` and ``n`` of every fingerprint counted more than once (column ``fp``, 64 bits)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            k, n = np.unique(b["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
            held.append((k, n))
            if sum(len(x) for x, _ in held) > 1 << 21:
                held = [merged(held)]
                if len(held[0][0]) > 1 << 20:  # a large partition gives several filters
                    yield pd.DataFrame(build_filter(*held[0], shard_bits))
                    held = []
        held = [h for h in held if len(h[0])]
        if held:
            yield pd.DataFrame(build_filter(*merged(held), shard_bits))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = merged([read_filter(*r, shard_bits) for r in rows[FILTER_COLUMNS].itertuples(index=False)])
        many = n > 1
        return pd.DataFrame({"fp": keys[many].view(np.int64), "n": n[many]})

    return (fingerprints.mapInPandas(build, FILTER)
            .groupBy("shard").applyInPandas(merge, "fp long, n long"))


FILTER_COLUMNS = [c.split()[0] for c in FILTER.split(", ")]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    light = checkpointed(rows.select(
        "doc_id", F.xxhash64("body").alias("fp"), F.sha2("body", 256).alias("text_sha256")))
    shard_bits = max(5, math.ceil(math.log2(max(light.count(), 1) / SHARD_ROWS + 1e-9)))
    many = checkpointed(repeated_fingerprints(light.select("fp"), shard_bits)).select("fp")
    # whole texts of routed rows meet under their own bytes; equal ones combine before the exchange
    groups = (rows.withColumn("fp", F.xxhash64("body")).join(small_side(many), "fp")
              .groupBy("fp", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("fp", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    out = light.join(groups, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
