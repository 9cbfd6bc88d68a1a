"""Regression trees, one model per key, grown level by level for all keys and trees at once.

Features are binned evenly over the key's range and labels become whole units of it, so all sums are exact whatever the
order of rows. A level is one aggregate: counts and sums by (key, tree, node, feature, bin), combined on the map side. Its
running totals give the best split of every node; the splits, a few rows per tree, are joined back to the rows. No key
meets in one task, and a long series costs more rows, not more levels.

``grow_forest`` gives every row a weight per tree (how often a bootstrap would draw it, from a hash), ``grow_boosted`` fits
each tree to what the ones before left over, with shrunken leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import checkpointed

UNITS = 1 << 20           # parts of a key's range in which labels are counted
BINS = 128
DEPTH = 10
RATE, PENALTY = 0.3, 1.0  # fixed values: usual defaults of boosted trees
SMALL = 200_000           # nodes that are broadcast
#: Shares of 2^32, in hexadecimal, below which a Poisson variable of mean 1 is 0, 1, 2, ...
POISSON = ("5e2d58d8", "bc5ab1b1", "eb715e1d", "fb239797", "ff1025f5", "ffd90f3b", "fffa8b71", "ffff540c")


@dataclass(frozen=True)
class TreeModel:
    """``nodes``: (keys, tree, node, feature, cut, left, value); children are ``left`` and ``left + 1``, a leaf has 0.
    ``ranges``: (keys, lo, hi, base); values are units of that range."""

    nodes: DataFrame
    ranges: DataFrame
    keys: list[str]
    features: list[str]
    bins: int
    depth: int
    trees: int
    boosted: bool


def _ranges(rows: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    all_values = [*features, label]
    return rows.groupBy(*keys).agg(F.min(F.least(*all_values)).alias("lo"), F.max(F.greatest(*all_values)).alias("hi"))


def _bin(value: Column, bins: int) -> Column:
    place = F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))).otherwise(0).cast("int")


def _units(value: Column) -> Column:
    place = F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * UNITS + 0.5)
    return F.when(F.col("hi") > F.col("lo"), place).otherwise(0).cast("long")


def _with_bins(rows: DataFrame, ranges: DataFrame, keys: list[str], features: list[str], bins: int) -> DataFrame:
    return rows.join(ranges, keys).withColumn("_b", F.array(*[_bin(F.col(f), bins) for f in features]))


def _splits(pos: DataFrame, keys: list[str], min_leaf: int, penalty: float) -> DataFrame:
    """Per open node: its weight and sum, and the feature and bin of its best split (null if none gains)."""
    node = [*keys, "_tree", "_node"]
    cells = pos.where("_open and _w > 0").select(*node, "_w", (F.col("_w") * F.col("_q")).alias("_s"),
                                                 F.posexplode("_b").alias("_feature", "_cut"))
    cells = cells.groupBy(*node, "_feature", "_cut").agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    cells = cells.repartition(*keys, "_tree")  # all that follows stays within a tree; its nodes, features and bins bound it
    side = Window.partitionBy(*node, "_feature")
    upto = side.orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(*node, "_feature", "_cut", F.sum("_w").over(upto).alias("lw"), F.sum("_s").over(upto).alias("ls"),
                         F.sum("_w").over(side).alias("w"), F.sum("_s").over(side).alias("s"))

    def score(s: Column, w: Column) -> Column:
        return s.cast("double") * s.cast("double") / (w + penalty)

    rw, rs = F.col("w") - F.col("lw"), F.col("s") - F.col("ls")
    whole = score(F.col("s"), F.col("w"))
    gain = score(F.col("ls"), F.col("lw")) + score(rs, rw) - whole
    gains = (F.col("lw") >= min_leaf) & (rw >= min_leaf) & (gain > whole * 1e-10 + 1e-6)
    order = F.when(gains, F.struct(gain.alias("g"), (-F.col("_feature")).alias("f"), (-F.col("_cut")).alias("c")))
    return cells.groupBy(*node).agg(F.max("w").alias("w"), F.max("s").alias("s"),
                                    F.max_by(F.struct("_feature", "_cut"), order).alias("best"))


def _moved(pos: DataFrame, nodes: DataFrame, node: list[str], small: bool) -> DataFrame:
    """Rows in split nodes go to a child; the others stay where they are and are not looked at again."""
    to = nodes.where("left > 0").select(*[F.col(c).alias(d) for c, d in zip(node, [*node[:-2], "_tree", "_node"])], "feature", "cut", "left")
    moved = pos.join(F.broadcast(to) if small else to, [*node[:-2], "_tree", "_node"], "left")
    right = (F.element_at("_b", F.col("feature") + 1) > F.col("cut")).cast("int")
    return moved.withColumns({"_node": F.when(F.col("left").isNull(), F.col("_node")).otherwise(F.col("left") + right),
                              "_open": F.col("left").isNotNull()}).drop("feature", "cut", "left")


def _grow(pos: DataFrame, keys: list[str], depth: int, min_leaf: int, penalty: float, rate: float
          ) -> tuple[DataFrame, DataFrame]:
    """All trees of ``pos`` (keys, _tree, _node, _open, _b, _w, _q, ...): their nodes, and ``pos`` in the leaves."""
    tree, levels = [*keys, "_tree"], []
    for level in range(depth + 1):
        if level < depth:
            found = _splits(pos, keys, min_leaf, penalty)
        else:
            found = pos.where("_open and _w > 0").groupBy(*tree, "_node").agg(
                F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_q")).alias("s"),
                F.first(F.lit(None).cast("struct<_feature:int,_cut:int>")).alias("best"))
        # children are numbered after the nodes of this level, in their order
        split = F.col("best").isNotNull().cast("int")
        before = F.sum(split).over(Window.partitionBy(*tree).orderBy("_node").rowsBetween(Window.unboundedPreceding, 0))
        first = F.max("_node").over(Window.partitionBy(*tree)) + 1
        nodes = checkpointed(found.select(
            *keys, F.col("_tree").alias("tree"), F.col("_node").cast("int").alias("node"),
            F.col("best._feature").alias("feature"), F.col("best._cut").alias("cut"),
            F.when(split == 1, first + 2 * (before - 1)).otherwise(0).cast("int").alias("left"),
            (F.col("s") / (F.col("w") + penalty) * rate).alias("value")))
        levels.append(nodes)
        size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left")).first()
        if not size["left"]:
            break
        small = size["n"] <= SMALL
        pos = _moved(pos, nodes, [*keys, "tree", "node"], small)
        if not small:
            pos = checkpointed(pos)
    return reduce(DataFrame.unionByName, levels), pos


def _bootstrap(keys: list[str], ts: str, trees: int, seed: int) -> Column:
    """How often each tree draws a row: Poisson variables of mean 1 from a hash of the row and the tree."""
    row = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.unix_seconds(F.col(ts)).cast("string"))
    hashes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                         lambda t: F.substring(F.md5(F.concat_ws("|", row, t.cast("string"))), 1, 8))
    return F.transform(hashes, lambda h: reduce(lambda a, b: a + b, [(h >= t).cast("int") for t in POISSON]))


def grow_forest(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str], ts: str = "ts", trees: int = 100,
                depth: int = DEPTH, bins: int = BINS, min_leaf: int = 1, bootstrap: bool = True, seed: int = 42) -> TreeModel:
    """A forest per key over ``rows`` (keys, ts, features, label), all features at every split."""
    keys, features = list(by), list(features)
    rows = checkpointed(rows.select(*keys, ts, *features, label).na.drop())
    ranges = _ranges(rows, keys, features, label)
    drawn = _bootstrap(keys, ts, trees, seed) if bootstrap else F.array_repeat(F.lit(1), trees)
    base = checkpointed(_with_bins(rows, ranges, keys, features, bins).select(
        *keys, "_b", _units(F.col(label)).alias("_q"), drawn.alias("_drawn")))
    pos = base.select(*keys, "_b", "_q", F.posexplode("_drawn").alias("_tree", "_w")).where("_w > 0").withColumns(
        {"_w": F.col("_w").cast("long"), "_node": F.lit(0), "_open": F.lit(True)})
    nodes, _ = _grow(pos, keys, depth, min_leaf, 0.0, 1.0)
    return TreeModel(nodes, ranges.withColumn("base", F.lit(0.0)), keys, features, bins, depth, trees, False)


def grow_boosted(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str], ts: str = "ts", trees: int = 100,
                 depth: int = 6, bins: int = BINS, min_leaf: int = 1, rate: float = RATE, penalty: float = PENALTY) -> TreeModel:
    """Boosted trees per key: each tree fits the rounded rest, leaves are shrunk by ``penalty`` and ``rate``."""
    keys, features = list(by), list(features)
    rows = checkpointed(rows.select(*keys, ts, *features, label).na.drop())
    ranges = _ranges(rows, keys, features, label)
    base = _with_bins(rows, ranges, keys, features, bins).select(*keys, ts, "_b", "lo", "hi", _units(F.col(label)).alias("_y"))
    means = checkpointed(base.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                                                 (F.sum("_y") / F.count("_y")).alias("base")))
    state = checkpointed(base.drop("lo", "hi").join(means.select(*keys, F.col("base").alias("_f")), keys))
    grown = []
    for t in range(trees):
        pos = state.withColumns({"_tree": F.lit(t), "_node": F.lit(0), "_open": F.lit(True), "_w": F.lit(1).cast("long"),
                                 "_q": F.floor(F.col("_y") - F.col("_f") + 0.5)})
        nodes, pos = _grow(pos, keys, depth, min_leaf, penalty, rate)
        grown.append(nodes)
        leaves = nodes.select(*keys, F.col("node").alias("_node"), "value")
        if leaves.limit(SMALL + 1).count() <= SMALL:
            leaves = F.broadcast(leaves)
        state = checkpointed(pos.join(leaves, [*keys, "_node"]).select(*keys, ts, "_b", "_y", (F.col("_f") + F.col("value")).alias("_f")))
    return TreeModel(reduce(DataFrame.unionByName, grown), means, keys, features, bins, depth, trees, True)


def _value(model: TreeModel, raw: Column) -> Column:
    """Units of the range as a value; ``raw`` is the sum over trees."""
    units = F.col("base") + raw if model.boosted else raw / model.trees
    return F.col("lo") + units / UNITS * (F.col("hi") - F.col("lo"))


def predicted(model: TreeModel, rows: DataFrame, ts: str = "ts") -> DataFrame:
    """``rows`` whose key has a model, with ``predicted`` from their features; (keys, ts) is unique."""
    columns, keys = rows.columns, [k for k in model.keys if k in rows.columns]
    own = [c for c in columns if c not in (*keys, ts)]
    pos = _with_bins(rows, model.ranges, keys, model.features, model.bins)
    pos = pos.withColumns({"_tree": F.explode(F.sequence(F.lit(0), F.lit(model.trees - 1))), "_node": F.lit(0)})
    nodes = checkpointed(model.nodes)
    small = nodes.limit(SMALL + 1).count() <= SMALL
    for _ in range(model.depth):
        pos = _moved(pos, nodes, [*keys, "tree", "node"], small).drop("_open")
    leaves = nodes.select(*keys, F.col("tree").alias("_tree"), F.col("node").alias("_node"), "value")
    pos = pos.join(F.broadcast(leaves) if small else leaves, [*keys, "_tree", "_node"])
    out = pos.groupBy(*keys, ts).agg(*[F.first(c).alias(c) for c in (*own, "lo", "hi", "base")], F.sum("value").alias("_raw"))
    return out.withColumn("predicted", _value(model, F.col("_raw"))).select(*columns, "predicted")


def packed(model: TreeModel) -> DataFrame:
    """One row per key: range and base, and its trees as arrays of nodes; for walking without a join."""
    node = F.struct("node", "feature", "cut", "left", "value")
    trees = model.nodes.groupBy(*model.keys, "tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    trees = trees.groupBy(*model.keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("_trees"))
    return trees.join(model.ranges, model.keys)


def walked(model: TreeModel, features: Sequence[Column]) -> Column:
    """The prediction for features given as columns, on rows that carry ``packed`` columns."""
    bins = F.array(*[_bin(f, model.bins) for f in features])

    def leaf(nodes: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            n = F.get(nodes, at)
            return F.when(n["left"] == 0, at).otherwise(n["left"] + (F.get(bins, n["feature"]) > n["cut"]).cast("int"))
        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(model.depth)), F.lit(0), down))["value"]

    return _value(model, F.aggregate("_trees", F.lit(0.0), lambda s, nodes: s + leaf(nodes)))
