"""Benchmark decontamination by greedy string tiling.

Every benchmark item and every document is a sequence of words (letters and digits; ASCII punctuation and
white space separate, A-Z is lowered). Runs of ``min_match`` words of a document that also occur in an
item are seeds, joined by their rolling hash. For each (document, item) with enough seeds the longest
common runs are marked one after another, longest first, never using a word of either side twice. An item
leaked into a document when the marked words make up at least ``coverage`` of it; since tiles may come in any
order and with gaps, reordered passages and edited ones are caught, too. Hashes of 64 bits find the runs;
a tile is then compared word by word (by their own hashes).

The benchmark is cut into blocks of at most ``block_chars`` characters. One block at a time is broadcast, and
the documents are scanned once per block, so memory does not depend on the size of the benchmark.

Rows: null texts are empty and never match; items with fewer than ``min_match`` words are too short to
be evidence and never match; rows that repeat an identifier are looked at one by one, and the result has a
row for each. Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import slices, windows, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_CHARS = 32 << 20
SIEVE_BITS = 22
EXPANDED = 1 << 21        # places of seeds looked at together
TILES = ("doc_id long, item_id long, item_words long, covered_words long, coverage double, tiles long, "
         "longest long, doc_start long, doc_end long")


class Block:
    """A bounded part of the benchmark: words of its items and an index of their seeds."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        self.n, self.ids = n, ids
        self.words, owner = word_hashes(texts, punctuation=True)
        self.start = np.searchsorted(owner, np.arange(len(texts) + 1))
        seed, item, at = windows(self.words, owner, n)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        rank = np.cumsum(np.r_[False, self.seed[1:] != self.seed[:-1]]) if len(order) else order
        self.place = rank * max(len(texts), 1) + self.item  # sorted: places of a seed in a range of items lie together
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def seeds(self, seed: np.ndarray) -> np.ndarray:
        """Which of these hashes are seeds of the block."""
        maybe = np.flatnonzero(self.sieve[(seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        place = np.searchsorted(self.seed, seed[maybe])
        hit = place < len(self.seed)
        hit[hit] = self.seed[place[hit]] == seed[maybe[hit]]
        return maybe[hit]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Tiles (place in ``doc``, place in ``item``, length) from seeds ``doc[i:i + n] == item[j:j + n]``.

    Seeds on one diagonal join into maximal runs; the longest run whose words are all free is marked first,
    and what is left of a partly marked run is tried again.
    """
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    size = np.diff(np.r_[new, len(i)]) + n - 1
    heap = [(-int(s), int(a), int(b)) for s, a, b in zip(size, i[new], j[new])
            if (doc[a:a + s] == item[b:b + s]).all()]
    heapq.heapify(heap)
    used_doc, used_item, tiles = set(), np.zeros(len(item), bool), []
    while heap:
        s, a, b = heapq.heappop(heap)
        s = -s
        free = [not used_item[b + k] and a + k not in used_doc for k in range(s)]
        if all(free):
            tiles.append((a, b, s))
            used_item[b:b + s] = True
            used_doc.update(range(a, a + s))
            continue
        k = 0
        while k < s:
            if not free[k]:
                k += 1
                continue
            e = k
            while e < s and free[e]:
                e += 1
            if e - k >= n:
                heapq.heappush(heap, (-(e - k), a + k, b + k))
            k = e
    return tiles


def scan(ids: list, texts: list[str | None], block: Block, coverage: float) -> Iterator[tuple]:
    """Leaked items of a batch of documents."""
    words, owner = word_hashes(texts, punctuation=True)
    seed, doc, at = windows(words, owner, block.n)
    hit = block.seeds(seed)
    if not len(hit):
        return
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    low, high = np.searchsorted(block.seed, seed[hit]), np.searchsorted(block.seed, seed[hit], side="right")
    doc, at, upto = doc[hit], at[hit], np.cumsum(high - low)
    k = 0
    while k < len(hit):  # whole documents, as many as have EXPANDED places together
        end = int(np.searchsorted(upto, (upto[k - 1] if k else 0) + EXPANDED, side="right"))
        if end < len(hit):
            first = int(np.searchsorted(doc, doc[end]))
            end = first if first > k else int(np.searchsorted(doc, doc[k], side="right"))
        total = int(upto[end - 1] - (upto[k - 1] if k else 0))
        # a single document with more of them looks at the items in several ranges
        cuts = np.linspace(0, len(block.ids), max(1, -(-total // EXPANDED)) + 1).astype(np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if len(cuts) == 2:
                lo, hi = low[k:end], high[k:end]
            else:
                base = block.place[low[k:end]] // len(block.ids) * len(block.ids)
                lo, hi = np.searchsorted(block.place, base + a), np.searchsorted(block.place, base + b)
            yield from _tiled(ids, words, starts, block, coverage, doc[k:end], at[k:end], lo, hi)
        k = end


def _tiled(ids: list, words: np.ndarray, starts: np.ndarray, block: Block, coverage: float, doc: np.ndarray, at: np.ndarray,
           low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
    """Leaked items from seeds at ``at`` in ``doc``, whose places in the block are ``low`` to ``high``."""
    many = high - low
    place = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc, i, item, j = np.repeat(doc, many), np.repeat(at, many), block.item[place], block.at[place]
    order = np.lexsort((item, doc))
    doc, i, item, j = doc[order], i[order], item[order], j[order]
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)])
    last = np.r_[first[1:], len(doc)]
    words_of = np.diff(block.start)[item[first]] if len(doc) else first
    enough = block.n * (last - first) >= coverage * words_of  # a seed covers n words at most
    for a, b in zip(first[enough], last[enough]):
        d, t = int(doc[a]), int(item[a])
        text = block.words[block.start[t]:block.start[t + 1]]
        here = np.unique(j[a:b]) - block.start[t]
        reach = len(here) + block.n - 1 + int(np.minimum(np.diff(here) - 1, block.n - 1).sum())
        if reach < coverage * len(text):  # not even all seeds together would do
            continue
        tiles = greedy_tiles(words[starts[d]:starts[d + 1]], text, i[a:b] - starts[d], j[a:b] - block.start[t], block.n)
        covered = sum(s for _, _, s in tiles)
        if tiles and covered >= coverage * len(text):
            yield (ids[d], block.ids[t], len(text), covered, covered / len(text), len(tiles), max(s for _, _, s in tiles),
                   min(x for x, _, _ in tiles), max(x + s for x, _, s in tiles))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_chars: int) -> Iterator[Broadcast]:
    """The benchmark in broadcast blocks of at most ``block_chars`` characters (or one longer item)."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"),
                             F.col(text_col).cast("string").alias("text")).where("text is not null")
    for part in slices(items.toLocalIterator(), lambda r: len(r["text"]), block_chars):
        yield benchmark.sparkSession.sparkContext.broadcast(
            Block([r["item_id"] for r in part], [r["text"] for r in part], min_match))


def _pieces(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list]]:
    pairs = zip(ids.to_pylist(), texts.to_pylist())
    for piece in slices(pairs, lambda r: len(r[1] or ""), 1 << 20):
        yield [i for i, _ in piece], [t for _, t in piece]


def leaked_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
                 coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and leaked item: the share of the item's words covered by tiles, their number,
    the longest, and the word range of the document that they span."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], TILES)
    for shared in blocks(benchmark, item_id, item_text, min_match, block_chars):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [r for ids, texts in _pieces(b.column(0), b.column(1))
                         for r in scan(ids, texts, shared.value, coverage)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), KINDS)], names=NAMES)

        out = out.unionByName(rows.mapInArrow(find, TILES))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in whose text no item leaked, with all their columns; no row moves to another task."""
    for shared in blocks(benchmark, item_id, item_text, min_match, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for ids, texts in _pieces(pa.array(range(b.num_rows)), b.column(b.num_columns - 1)):
                    keep[[r[0] for r in scan(ids, texts, shared.value, coverage)]] = False
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(keep))

        docs = docs.select("*", F.col(doc_text).cast("string").alias("_words")).mapInArrow(clean, docs.schema)
    return docs


NAMES = [c.split()[0] for c in TILES.split(", ")]
KINDS = [pa.float64() if c.endswith("double") else pa.int64() for c in TILES.split(", ")]
