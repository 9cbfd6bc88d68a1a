"""Hard negatives by the threshold algorithm over sorted lists per dimension.

Vectors become integers (``floor(256 x)``), a row's score is its inner product with an anchor. Rows are dealt into
blocks; inside a block every dimension has a list of the rows in the order of its component. An anchor walks all lists
at once, from the high end where its own component is positive and from the low end where it is negative. Rows met for
the first time are scored whole (random access). No row still unseen can score more than the threshold, the sum of the
anchor's components times the values reached. A search ends when the threshold falls strictly below the k-th score
found (strictly, since of equal scores the smaller identifier comes first), or below a window's lower bound.

Two passes: the first finds an anchor's positives, in lists of its own label; the second the best rows of other labels
inside the window that each positive's score opens. Both deal rows and anchors to tasks by (block, part of the
anchors): the rows of a block come first, then its anchors one after another, so that a task holds one block and one
batch of anchors. Answers of blocks are merged by rank. A label or a vector that many rows share moves nothing together,
because blocks are dealt by row number.

Rows: those with a null identifier, label or vector, or with a null, non-finite or huge component (beyond ``2 ** 20``,
where scores could leave 64 bits) take no part; vectors shorter than the longest are filled with zeros; repeated rows
are rows of their own, and a second row with the anchor's identifier is another row. Equal scores and identifiers give
equal output rows, whichever comes first. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import checkpointed

SCALE = 256
LARGEST = 2.0 ** 20       # components beyond take no part
LEAST_BLOCK, LARGEST_BLOCK = 512, 65_536
FIRST_DEPTH = 16          # the lists are read in runs that double
ANCHORS_AT_ONCE = 256


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label: Column | None = None) -> DataFrame:
    """``row``, ``vec_id``, ``label`` and the integer components ``q`` of all rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"),
                        (F.col("label") if label is None else label).cast("long").alias("label"),
                        F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.forall("x", lambda v: F.coalesce(F.abs(v) <= LARGEST, F.lit(False)))  # no NaN: it is above all numbers
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & usable)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label",
                       F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("q"))


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of integers, short ones filled with zeros."""
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(length) and (length == dim).all():
        return flat.reshape(len(length), dim)
    out = np.zeros((len(length), dim), np.int64)
    first = np.cumsum(length) - length
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(first, length)] = flat
    return out


class Lists:
    """The rows of a block, with one sorted list for each dimension."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, q: np.ndarray):
        order = np.lexsort((row, vec_id))  # a place in the block is the rank of the identifier
        self.row, self.vec_id, self.label, self.q = row[order], vec_id[order], label[order], q[order]
        self.order = np.argsort(self.q, axis=0, kind="stable").T.astype(np.int32).copy()
        self.value = np.take_along_axis(self.q, self.order.T, axis=0).T.copy()
        largest = int(np.abs(self.q).max()) if self.q.size else 0
        self.floats = self.q.astype(np.float64) if largest * LARGEST * SCALE * q.shape[1] < 2 ** 53 else None

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.floats is not None:  # exact as long as every sum stays below 2 ** 53
            return (self.floats[places] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[places] @ anchor

    def search(self, anchor: np.ndarray, enough: Callable[[np.ndarray, np.ndarray, int], bool]
               ) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores met until ``enough(places, scores, threshold)`` holds, or all."""
        n, used = len(self.row), np.flatnonzero(anchor)
        sign, weight = anchor[used] > 0, anchor[used]
        fresh = np.ones(n, bool)
        places, scores = [], []
        at, depth = 0, FIRST_DEPTH
        while at < n:
            end = min(n, at + depth)
            if len(used):
                high, low = used[sign], used[~sign]
                met = np.concatenate((self.order[high, n - end:n - at].ravel(), self.order[low, at:end].ravel()))
                new = np.unique(met[fresh[met]])
                reached = np.where(sign, self.value[used, n - end], self.value[used, end - 1])
                threshold = int(reached @ weight)
            else:  # every row scores 0, and so does the threshold
                new, threshold = np.arange(at, end), 0
            fresh[new] = False
            places.append(new)
            scores.append(self.scores(new, anchor))
            at, depth = end, depth * 2
            if at < n and enough(np.concatenate(places), np.concatenate(scores), threshold):
                break
        return (np.concatenate(places), np.concatenate(scores)) if places else (np.empty(0, np.int64),) * 2


def _best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` first by score, ties by place (the rank of the identifier)."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((places[some], -scores[some]))[:k]]


def _deal(vectors: DataFrame, anchors: DataFrame, n_blocks: int, parts: int, extra: str) -> DataFrame:
    """Rows of every block once for each part of the anchors, then that part's anchors, in one stream a task."""
    rows = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                          (F.col("row") % n_blocks).cast("int").alias("block"), F.lit(0).alias("kind"),
                          "row", "vec_id", "label", "q", F.lit(None).cast(extra).alias("windows"))
    asked = anchors.select((F.col("row") % parts).cast("int").alias("part"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                           "row", "vec_id", "label", "q", F.col("windows").cast(extra).alias("windows"))
    return (rows.unionByName(asked).repartition(n_blocks * parts, "block", "part")
            .sortWithinPartitions("block", "part", "kind", "row"))


def _stream(batches: Iterator[pa.RecordBatch], dim: int, answer) -> Iterator[pa.RecordBatch]:
    """Gathers the rows of a block, then hands its anchors to ``answer(block rows, anchors)`` batch by batch."""
    key, held, block, lists = None, [], None, {}
    for b in batches:
        part, number, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        change = np.flatnonzero(np.diff(part) | np.diff(number) | np.diff(kind)) + 1
        for lo, hi in zip(np.r_[0, change], np.r_[change, b.num_rows]):
            if lo == hi:
                continue
            if key != (number[lo], part[lo]):
                key, held, block = (number[lo], part[lo]), [], None
            piece = b.slice(lo, hi - lo)
            if kind[lo] == 0:
                held.append((piece.column(3).to_numpy(), piece.column(4).to_numpy(), piece.column(5).to_numpy(),
                             as_matrix(piece.column(6), dim)))
                continue
            if block is None:
                if not held:
                    continue
                block, held, lists = tuple(np.concatenate(c) for c in zip(*held)), [], {}
            for k in range(0, hi - lo, ANCHORS_AT_ONCE):
                out = answer(block, lists, piece.slice(k, ANCHORS_AT_ONCE))
                if out is not None:
                    yield out


def _top(found: DataFrame, keys: list[str], k: int, by: list[str], rank: str) -> DataFrame:
    order = [F.col("score").desc(), *by]
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def positives_of(vectors: DataFrame, anchors: DataFrame, dim: int, n_blocks: int, parts: int, k: int) -> DataFrame:
    """For every anchor row its ``k`` best other rows of the same label: anchor, ``positive_id``, ``score``, rank."""
    def answer(block, lists, asked):
        row, vec_id, label = (asked.column(i).to_numpy() for i in (3, 4, 5))
        out = []
        for a, name, own, q in zip(row, vec_id, label, as_matrix(asked.column(6), dim)):
            if own not in lists:
                lists[own] = Lists(*(c[block[2] == own] for c in block))
            mine = lists[own]
            others = lambda places: mine.row[places] != a

            def enough(places, scores, threshold):
                s = scores[others(places)]
                return len(s) >= k and threshold < np.partition(s, len(s) - k)[len(s) - k]

            places, scores = mine.search(q, enough)
            keep = others(places)
            places, scores = places[keep], scores[keep]
            for i in _best(places, scores, k):
                out.append((a, name, mine.vec_id[places[i]], mine.row[places[i]], scores[i]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=FOUND) if out else None

    FOUND = ["row", "anchor_id", "positive_id", "positive_row", "score"]
    dealt = _deal(vectors, anchors.withColumn("windows", F.lit(None)), n_blocks, parts, "array<struct<rank:int,low:long,high:long>>")
    found = dealt.mapInArrow(lambda b: _stream(b, dim, answer), ", ".join(f"{c} long" for c in FOUND))
    return _top(found, ["row"], k, ["positive_id", "positive_row"], "positive_rank")


def negatives_of(vectors: DataFrame, anchors: DataFrame, dim: int, n_blocks: int, parts: int, k: int) -> DataFrame:
    """For every anchor row and window its ``k`` best rows of other labels inside the window."""
    def answer(block, lists, asked):
        if not lists:
            lists[None] = Lists(*block)
        mine, out = lists[None], []
        row, label = asked.column(3).to_numpy(), asked.column(5).to_numpy()
        for a, own, q, windows in zip(row, label, as_matrix(asked.column(6), dim), asked.column(7).to_pylist()):

            def inside(places, scores, w):
                return np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]) & (mine.label[places] != own))

            def enough(places, scores, threshold):
                for w in windows:
                    if threshold < w["low"]:
                        continue
                    s = scores[inside(places, scores, w)]
                    if len(s) < k or threshold >= np.partition(s, len(s) - k)[len(s) - k]:
                        return False
                return True

            places, scores = mine.search(q, enough)
            for w in windows:
                here = inside(places, scores, w)
                for i in here[_best(places[here], scores[here], k)]:
                    out.append((a, w["rank"], mine.vec_id[places[i]], mine.row[places[i]], scores[i]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=FOUND) if out else None

    FOUND = ["row", "positive_rank", "negative_id", "negative_row", "score"]
    dealt = _deal(vectors, anchors, n_blocks, parts, "array<struct<rank:int,low:long,high:long>>")
    found = dealt.mapInArrow(lambda b: _stream(b, dim, answer), ", ".join(f"{c} long" for c in FOUND))
    return _top(found, ["row", "positive_rank"], k, ["negative_id", "negative_row"], "rank")


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding", positives: int = 5, negatives: int = 3,
                   low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """One row per anchor, positive and hard negative, with both scores and the negative's rank.

    ``is_anchor`` is a condition on the identifier (named ``vec_id``); ``label`` an expression over the table's columns.
    """
    vectors = checkpointed(integer_vectors(table, id_col, vector_col, label))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dim, n = max(1, size["dim"] or 0), size["n"]
    # blocks are as large as memory allows, but not fewer than there are tasks; beyond that, anchors are divided
    n_blocks = max(1, -(-n // max(LEAST_BLOCK, min(LARGEST_BLOCK, -(-n // tasks)))))
    parts = max(1, min(8, -(-tasks // n_blocks)))
    anchors = vectors.where(is_anchor)
    best = checkpointed(positives_of(vectors, anchors, dim, n_blocks, parts, positives))
    score = F.col("score").cast("decimal(20,0)")
    low = F.ceil(score * low_percent / 100).cast("long")
    high = F.floor(score * high_percent / 100).cast("long")
    windows = best.groupBy("row").agg(F.collect_list(F.struct(
        F.col("positive_rank").alias("rank"), low.alias("low"), high.alias("high"))).alias("windows"))
    asked = anchors.join(windows, "row")
    found = negatives_of(vectors, asked, dim, n_blocks, parts, negatives)
    return found.join(best.select("row", "anchor_id", F.col("positive_rank").cast("long").alias("positive_rank"),
                                  "positive_id", F.col("score").alias("positive_score")), ["row", "positive_rank"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        F.col("score").alias("negative_score"))


SQL = """WITH v AS (SELECT row_number() OVER () AS row_id, vec_id,
  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row_id AS anchor_row, a.vec_id AS anchor_id, b.row_id AS other_row, b.vec_id AS other_id,
  a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row_id <> b.row_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, other_id, other_row) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_row = p.anchor_row AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_row, p.other_row ORDER BY s.score DESC, s.other_id, s.other_row)
QUALIFY row_number() OVER w <= 3"""
