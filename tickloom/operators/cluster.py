"""Reduction to two dimensions, clustering and its quality.

Entities come as (entity, features) with ``features`` an array of doubles. Nothing here forms rows of
pairs: distances are computed between bounded packs of points inside vectorised tasks, which give
back one row per point and cluster, or per point and cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import checkpointed, scratch_path, written
from tickloom.sources.store import remove

PACK = 2048       # points per pack
MIN_ENTITIES = 4  # fixed value: fewer entities are not reduced or clustered
N_CLUSTERS = 4    # fixed value: default number of clusters
EPS = 0.5         # fixed value: default neighbourhood radius
MIN_SAMPLES = 2   # fixed value: default neighbours (itself included) that make a point a core


def entity_rows(cells: DataFrame, by: str = "ticker", column: Sequence[str] = ("d", "feature"), value: str = "value") -> DataFrame:
    """One array per entity from the cells of a full matrix, columns in order."""
    points = F.array_sort(F.collect_list(F.struct(*column, F.col(value).alias("v"))))
    return cells.groupBy(F.col(by).alias("entity")).agg(F.transform(points, lambda p: p["v"]).alias("features"))


# --- reduction ---------------------------------------------------------------------------------

def pca(df: DataFrame, k: int = 2, scale: bool = False) -> DataFrame:
    """(entity, dim1, dim2): centred principal components; the largest loading of each is positive."""
    df = checkpointed(df.select("entity", "features"))  # read once per pass of the two fits
    first = df.select(F.size("features")).head()
    if first is None:
        return df.select("entity", *[F.lit(None).cast("double").alias(f"dim{i + 1}") for i in range(k)])
    width = first[0]
    vectors = df.select("entity", array_to_vector("features").alias("v"))
    centred = StandardScaler(withMean=True, withStd=scale, inputCol="v", outputCol="c").fit(vectors).transform(vectors)
    model = PCA(k=min(k, width), inputCol="c", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if col[np.argmax(np.abs(col))] >= 0 else -1.0 for col in loadings.T]
    parts = vector_to_array("p")
    dims = [(parts[i] * signs[i]) if i < len(signs) else F.lit(0.0) for i in range(k)]
    return model.transform(centred).select("entity", *[d.alias(f"dim{i + 1}") for i, d in enumerate(dims)])


def as_points(reduced: DataFrame) -> DataFrame:
    return reduced.select("entity", F.array("dim1", "dim2").alias("features"))


# --- clustering by Spark ML --------------------------------------------------------------------

def _labelled(estimator, df: DataFrame) -> DataFrame:
    vectors = df.withColumn("_v", array_to_vector("features"))
    model = estimator.setFeaturesCol("_v").setPredictionCol("cluster").fit(vectors)
    return model.transform(vectors).drop("_v").withColumn("cluster", F.col("cluster").cast("string"))


def kmeans(df: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    return _labelled(KMeans(k=k or N_CLUSTERS, seed=seed), df)


# --- packs -------------------------------------------------------------------------------------

def _packed(df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Points per key in packs of about ``PACK``: (keys, pack, ids, x, extra...), x flattened."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PACK).alias("_packs"))
    spread = df.join(sizes, list(keys)).withColumn("pack", F.pmod(F.xxhash64("entity"), F.col("_packs")))
    def column(name: str):
        return F.transform("_r", lambda r: r[name])

    rows = F.collect_list(F.struct("entity", "features", *extra))
    return spread.groupBy(*keys, "pack").agg(rows.alias("_r")).select(
        *keys, "pack", column("entity").alias("ids"), F.flatten(column("features")).alias("x"),
        *[column(e).alias(e) for e in extra])


def _matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(n, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += np.subtract.outer(a[:, i], b[:, i]) ** 2
    return np.sqrt(total)


# --- silhouette --------------------------------------------------------------------------------

BLOCK = 16        # packs of a block
TILE = 256        # points whose distances to four times as many are held at once
CANCELS = 1e-4    # share of the squared lengths below which a squared distance is not taken from a product


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by one product of the matrices; pairs so near that the product would cancel are taken by coordinates."""
    nx, ny = (x ** 2).sum(1), (y ** 2).sum(1)
    far = x @ y.T
    far *= -2
    far += nx[:, None]
    far += ny
    i, j = np.nonzero(~(far > (CANCELS * (nx + ny.max()))[:, None]))  # also what is not finite
    for k in range(0, len(i), PACK):
        far[i[k:k + PACK], j[k:k + PACK]] = ((x[i[k:k + PACK]] - y[j[k:k + PACK]]) ** 2).sum(1)
    return np.sqrt(far, out=far)


def _by_cluster(packs: pd.DataFrame) -> tuple:
    """The points of some packs, sorted by cluster: coordinates, code of each one's cluster, names, counts, the order."""
    x = np.concatenate([_matrix(r.x, len(r.ids)) for r in packs.itertuples(index=False)])
    names, code, n = np.unique(np.concatenate([np.asarray(c, dtype=str) for c in packs["cluster"]]), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    return x[order], code[order], names, n, order


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per pack of two blocks and cluster of the other one: the sums of distances of the pack's points, in their order.

    A block that meets itself gives its sums once; of two blocks each distance counts for both of its ends."""
    blocks = [g for _, g in pdf.groupby("block")]
    one, two = _by_cluster(blocks[0]), _by_cluster(blocks[-1])
    solid = two[0][np.isfinite(two[0]).all(axis=1)]
    if len(solid):
        one, two = (one[0] - solid.mean(0), *one[1:]), (two[0] - solid.mean(0), *two[1:])
    sums = [np.zeros((len(two[2]), len(one[0]))), np.zeros((len(one[2]), len(two[0])))]
    for i in range(0, len(one[0]), TILE):
        rows = slice(i, i + TILE)
        first = np.flatnonzero(np.diff(one[1][rows], prepend=-1))
        for j in range(0, len(two[0]), 4 * TILE):
            cols = slice(j, j + 4 * TILE)
            far = _apart(one[0][rows], two[0][cols])
            start = np.flatnonzero(np.diff(two[1][cols], prepend=-1))
            sums[0][two[1][cols][start], rows] += np.add.reduceat(far, start, axis=1).T
            if len(blocks) > 1:
                sums[1][one[1][rows][first], cols] += np.add.reduceat(far, first, axis=0)
    out: dict[str, list] = {"pack": [], "cluster": [], "n": [], "total": []}
    for packs, own, other, total in zip(blocks, (one, two), (two, one), sums):
        total[:, own[4]] = total.copy()
        ends = np.cumsum([len(ids) for ids in packs["ids"]])
        for pack, part in zip(packs["pack"], np.split(total, ends[:-1], axis=1)):
            out["pack"] += [pack] * len(part)
            out["cluster"] += list(other[2])
            out["n"] += other[3].tolist()
            out["total"] += list(part)
    return pd.DataFrame(out)


def _fold_block(block: Broadcast) -> Callable:
    """Mean squared distances of points to the clusters of one block, from the clusters' counts and sums."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, n, sums, squares = block.value
        at = {c: i for i, c in enumerate(names)}
        for pdf in frames:
            x = np.stack(pdf["features"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, sums.shape[1]))
            far = np.maximum(((x ** 2).sum(1)[:, None] - 2 * x @ (sums / n[:, None]).T + (squares / n)[None, :]), 0)
            own = pdf["cluster"].map(at).to_numpy(float)
            mine = np.flatnonzero(~np.isnan(own))
            k = own[mine].astype(int)
            a, size = pdf["a"].to_numpy(float).copy(), pdf["size"].to_numpy(float).copy()
            a[mine] = far[mine, k] * n[k] / np.maximum(n[k] - 1, 1)  # the point itself is no neighbour
            size[mine] = n[k]
            far[mine, k] = np.inf
            yield pdf.assign(a=a, size=size, b=np.fmin(pdf["b"].to_numpy(float), far.min(axis=1)))
    return fold


def silhouette_of(df: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The silhouette of every entity of (entity, cluster, features), with squared Euclidean distances.

    The mean squared distance of a point to a cluster follows from the cluster's count, sum and sum of squares, so the work
    is linear. These sums are broadcast in blocks of at most ``block`` numbers, and the points pass one block after the
    other in place. 0 for a cluster of one point, and where there is one cluster only.
    """
    pts = df.select("entity", F.col("cluster").cast("string").alias("cluster"), "features").where("cluster is not null")
    stats = pts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector("features"))).alias("s"),
        F.sum(F.aggregate("features", F.lit(0.0), lambda t, v: t + v * v)).alias("q"))
    kind = df.schema["entity"].dataType.simpleString()
    out = pts.withColumns({"a": F.lit(0.0), "size": F.lit(0.0), "b": F.lit(float("inf"))})
    held: list = []

    def folded(rows: list, d: DataFrame) -> DataFrame:
        share = df.sparkSession.sparkContext.broadcast((
            [r["cluster"] for r in rows], np.array([r["n"] for r in rows], float), np.array([r["s"] for r in rows]),
            np.array([r["q"] for r in rows])))
        return d.mapInPandas(_fold_block(share), f"entity {kind}, cluster string, features array<double>, a double, size double, b double")

    for r in stats.toLocalIterator():
        held.append(r)
        if len(held) * len(r["s"]) >= block:
            out, held = folded(held, out), []
    if held:
        out = folded(held, out)
    far = F.greatest("a", "b")
    score = F.when((F.col("size") > 1) & (F.col("b") < float("inf")) & (far > 0), (F.col("b") - F.col("a")) / far).otherwise(0.0)
    return out.select("entity", "cluster", score.alias("silhouette"))


def euclidean_silhouette_of(df: DataFrame) -> DataFrame:
    """The silhouette of every entity of (entity, cluster, features), with Euclidean distances.

    Packs of points, dealt by hash, form blocks that meet each other once, as the definition asks for all distances; what
    leaves a task is one list of sums per pack and cluster. The work grows with the square of the points.
    """
    rows = df.select("entity", F.col("cluster").cast("string").alias("cluster"), "features").where("cluster is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("c")).head()
    count = max(1, -(-size["n"] // PACK))
    per = max(1, min(BLOCK, count // 12, 2 * PACK // max(size["c"], 1)))  # packs in a block: work for all cores, bounded sums
    points = F.collect_list(F.struct("entity", "cluster", "features"))
    packs = checkpointed(rows.groupBy(F.pmod(F.xxhash64("entity"), F.lit(count)).cast("int").alias("pack")).agg(points.alias("_r")).select(
        "pack", F.floor(F.col("pack") / per).cast("int").alias("block"), F.transform("_r", lambda r: r["entity"]).alias("ids"),
        F.flatten(F.transform("_r", lambda r: r["features"])).alias("x"), F.transform("_r", lambda r: r["cluster"]).alias("cluster")))
    meeting = packs.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // per)))).withColumns(
        {"one": F.least("block", "_o"), "two": F.greatest("block", "_o")}).drop("_o")
    parts = meeting.groupBy("one", "two").applyInPandas(_pair_sums, "pack int, cluster string, n bigint, total array<double>")
    none = F.array_repeat(F.lit(0.0), F.size(F.col("_t")[0]))
    added = F.aggregate("_t", none, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    whole = parts.groupBy("pack", F.col("cluster").alias("other")).agg(F.collect_list("total").alias("_t"), F.sum("n").alias("n")).select(
        "pack", "other", "n", added.alias("total"))
    each = F.explode(F.arrays_zip("ids", "cluster", "total")).alias("_p")
    sums = packs.select("pack", "ids", "cluster").join(whole, "pack").select("other", "n", each).select(
        F.col("_p.ids").alias("entity"), F.col("_p.cluster").alias("own"), F.col("other").alias("cluster"), F.col("_p.total").alias("total"), "n")
    sums = sums.groupBy("entity", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("cluster")
    each = sums.groupBy("entity", F.col("own").alias("cluster")).agg(
        F.max(F.when(mine, F.col("n"))).alias("_k"),
        F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("_a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("_b"))
    far = F.greatest("_a", "_b")
    score = F.when((F.col("_k") > 1) & F.col("_b").isNotNull() & (far > 0), (F.col("_b") - F.col("_a")) / far).otherwise(0.0)
    return each.select("entity", "cluster", score.alias("silhouette"))


def silhouette(df: DataFrame, squared: bool = False) -> DataFrame:
    """One row: the mean silhouette, 0 for a single cluster. ``squared`` takes the linear form with squared distances."""
    each = silhouette_of(df) if squared else euclidean_silhouette_of(df)
    return each.agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))


# --- density clusters --------------------------------------------------------------------------

KEYED = 3         # dimensions by which cells find the ones around them
SLAB = 64         # points compared at once with another pack before looking whether one is near


def _around(cells: DataFrame, width: int) -> DataFrame:
    """(cell, other): occupied cells of (cell, at) that may hold points within the radius of each other, both ways.

    Cells are eps / sqrt(width) wide, so a neighbour is at most ``reach`` cells away in each dimension. Blocks of ``reach``
    cells along the first dimensions meet the blocks beside them; the gap in all dimensions decides.
    """
    reach, keyed = 1 + math.isqrt(width), min(width, KEYED)
    keys = [f"b{k}" for k in range(keyed)]
    blocks = cells.select("cell", "at", *[F.floor(F.col("at")[k] / reach).alias(b) for k, b in enumerate(keys)])
    steps = F.array(*[F.array(*[F.lit(i) for i in step]) for step in product((-1, 0, 1), repeat=keyed)])
    beside = blocks.withColumn("_o", F.explode(steps)).select(
        F.col("cell").alias("other"), F.col("at").alias("_to"), *[(F.col(b) + F.col("_o")[k]).alias(b) for k, b in enumerate(keys)])
    apart = F.zip_with("at", "_to", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)))
    gap = F.aggregate(apart, F.lit(0).cast("double"), lambda total, x: total + x.cast("double") * x)
    return blocks.join(beside, keys).where(gap <= width).select("cell", "other")


def _other(packs: DataFrame) -> DataFrame:
    return packs.select(F.col("cell").alias("other"), F.col("ids").alias("other_ids"), F.col("x").alias("other_x"))


def _count_near(eps: float) -> Callable:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                near = _distances(_matrix(r.x, len(r.ids)), _matrix(r.other_x, len(r.other_ids))) <= eps
                yield pd.DataFrame({"entity": np.asarray(r.ids), "n": near.sum(axis=1).astype("int64")})
    return count


def _touch(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether a point of one pack is within ``eps`` of one of the other; stops at the first such pair.

    Only points within ``eps`` of the other pack's box can be; those nearest to it are tried first.
    """
    def off(points: np.ndarray, box: np.ndarray) -> np.ndarray:
        return _distances(np.maximum(np.maximum(box.min(0) - points, points - box.max(0)), 0), np.zeros((1, points.shape[1])))[:, 0]

    far = off(x, y)
    x = x[np.argsort(far, kind="stable")][:int((far <= eps).sum())]
    if not len(x):
        return False
    y = y[off(y, x) <= eps]
    return any((_distances(x[k:k + SLAB], y) <= eps).any() for k in range(0, len(x), SLAB)) if len(y) else False


def _linked(eps: float) -> Callable:
    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            touch = [_touch(_matrix(r.x, len(r.ids)), _matrix(r.other_x, len(r.other_ids)), eps) for r in pdf.itertuples(index=False)]
            yield pdf.loc[touch, ["cell", "other"]]
    return link


def _links(packs: DataFrame, around: DataFrame, eps: float) -> DataFrame:
    """(cell, other): pairs of cells with points within ``eps`` of each other.

    One pack of each cell is tried first. All packs meet only for the pairs left open, where a cell has more than one.
    """
    ahead = around.where("cell < other")
    per_cell = packs.groupBy("cell").agg(F.min_by(F.struct("ids", "x"), F.col("ids")[0]).alias("p"), F.count(F.lit(1)).alias("k"))
    one = checkpointed(per_cell.select("cell", "p.*", "k"))

    def met(a: DataFrame, pairs: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(pairs, "cell").join(_other(b), "other").mapInPandas(_linked(eps), "cell string, other string")

    first = checkpointed(met(one.drop("k"), ahead, one))
    left = ahead.join(first, ["cell", "other"], "left_anti").join(one.select("cell", "k"), "cell").join(
        one.select(F.col("cell").alias("other"), F.col("k").alias("j")), "other").where("k > 1 or j > 1").select("cell", "other")
    return first.unionByName(met(packs, left, packs).distinct())


def _nearest(eps: float) -> Callable:
    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                near = _distances(_matrix(r.x, len(r.ids)), _matrix(r.other_x, len(r.other_ids))).min(axis=1)
                yield pd.DataFrame({"entity": np.asarray(r.ids), "dist": near, "other": r.other})[near <= eps]
    return nearest


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with edges (a, b): every node points to the least node it reaches.

    Alternates two steps that hang neighbours onto smaller nodes; the number of rounds grows with
    the logarithm of the longest path. Each round is a table of its own, the driver sees two numbers.
    """
    spark, path = edges.sparkSession, None
    hung = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct()
    seen = None
    while True:
        both = hung.unionByName(hung.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        wide = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("m").alias("root"))
        wide = wide.where("node <> root").distinct()
        least = wide.groupBy("node").agg(F.min("root").alias("m"))
        down = wide.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root")
        before, path = path, scratch_path(spark, "links")
        hung = written(down.unionByName(least.select("node", F.col("m").alias("root"))).distinct(), path)
        if before:
            remove(spark, before)
        state = tuple(hung.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).head())
        if state == seen:
            return hung
        seen = state


def dbscan(df: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Density clusters of points of any number of dimensions: (entity, cluster), null for noise.

    Points of one cell are neighbours. A cell with ``min_samples`` points holds only cores, which all share a cluster; so
    neighbours are counted for thinly filled cells only, and clusters are components of the graph of cells. A border
    point joins its nearest core. The label is the least entity of the cluster. Many dimensions leave few points in a
    cell, so reduce them first where there are more than a few.
    """
    width = (df.select(F.size("features")).head() or [2])[0]
    side = eps / math.sqrt(width)
    pts = df.select("entity", "features", F.transform("features", lambda x: F.floor(x / side)).alias("at"))
    pts = checkpointed(pts.withColumn("cell", F.concat_ws(":", F.col("at").cast("array<string>"))))
    kind = pts.schema["entity"].dataType.simpleString()
    filled = checkpointed(pts.groupBy("cell").agg(F.first("at").alias("at"), F.count(F.lit(1)).alias("_n")))
    around = checkpointed(_around(filled, width))
    pts = pts.drop("at")
    thin = pts.join(filled.where(F.col("_n") < min_samples), "cell", "left_semi")
    thick = pts.join(filled.where(F.col("_n") >= min_samples), "cell", "left_semi")
    counted = _packed(thin, ["cell"]).join(around, "cell").join(_other(_packed(pts, ["cell"])), "other").mapInPandas(
        _count_near(eps), f"entity {kind}, n bigint").groupBy("entity").agg(F.sum("n").alias("n"))
    thin_core = checkpointed(counted.where(F.col("n") >= min_samples).select("entity"))
    core = checkpointed(thick.unionByName(thin.join(thin_core, "entity", "left_semi")))
    core_packs = checkpointed(_packed(core, ["cell"]))
    links = _links(core_packs, around, eps)
    roots = checkpointed(components(links.select(F.col("cell").alias("a"), F.col("other").alias("b"))))
    placed = core.select("entity", F.col("cell").alias("node"))
    border = thin.join(thin_core, "entity", "left_anti")
    joined = _packed(border, ["cell"]).join(around, "cell").join(_other(core_packs), "other").mapInPandas(
        _nearest(eps), f"entity {kind}, dist double, other string")
    joined = joined.groupBy("entity").agg(F.min_by("other", F.struct("dist", "other")).alias("node"))
    members = placed.unionByName(joined).join(roots, "node", "left").select("entity", F.coalesce("root", "node").alias("root"))
    names = members.groupBy("root").agg(F.min("entity").alias("cluster"))
    labels = members.join(names, "root").select("entity", F.col("cluster").cast("string").alias("cluster"))
    return df.select("entity").join(labels, "entity", "left")


# --- single linkage ----------------------------------------------------------------------------

_BESIDE = [(i, j) for i in range(-1, 2) for j in range(-1, 2)]


def _shortest(radius: float) -> Callable:
    """Per pair of components in two packs: the shortest edge within the radius, ties by identifiers."""
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                x, y = _matrix(r.x, len(r.ids)), _matrix(r.other_x, len(r.other_ids))
                far = np.subtract.outer(x[:, 0], y[:, 0]) ** 2 + np.subtract.outer(x[:, 1], y[:, 1]) ** 2
                own, other = np.asarray(r.comp), np.asarray(r.other_comp)
                i, j = np.nonzero((far <= radius * radius) & (own[:, None] < other[None, :]))
                a, b = np.asarray(r.ids)[i], np.asarray(r.other_ids)[j]
                d = pd.DataFrame({"ca": own[i], "cb": other[j], "d": far[i, j], "a": np.minimum(a, b), "b": np.maximum(a, b)})
                yield d.sort_values(["d", "a", "b"]).drop_duplicates(["ca", "cb"])
    return find


def _spanning(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The least spanning forest of (ca, cb, d, a, b), in rounds: every component takes its shortest edge.

    Returns its edges and (comp, root) of the components that grew."""
    best, roots = F.min(F.struct("d", "a", "b", "ca", "cb")), None
    spark, path = edges.sparkSession, None
    taken = []
    while edges.take(1):
        both = edges.select(F.col("ca").alias("comp"), "*").unionByName(edges.select(F.col("cb").alias("comp"), "*"))
        round_ = written(both.groupBy("comp").agg(best.alias("e")).select("e.*").distinct(), scratch_path(spark, "shortest"))
        taken.append(round_.select("d", "a", "b"))
        grown = components(round_.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), "root")
        roots = grown if roots is None else written(roots.join(
            grown.select(F.col("comp").alias("root"), F.col("root").alias("_r")), "root", "left").select(
            "comp", F.coalesce("_r", "root").alias("root")).unionByName(grown.join(roots, "comp", "left_anti")), scratch_path(spark, "roots"))
        for end in ("ca", "cb"):
            to = grown.select(F.col("comp").alias(end), F.col("root").alias("_r"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
        edges = edges.where("ca <> cb").select(
            F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "d", "a", "b")
        before, path = path, scratch_path(spark, "edges")
        edges = written(edges.groupBy("ca", "cb").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("ca", "cb", "e.*"), path)
        if before:
            remove(spark, before)
    return (reduce(DataFrame.unionByName, taken) if taken else None), roots


def spanning_edges(df: DataFrame, parts: int) -> DataFrame:
    """(d, a, b): the least spanning forest of two-dimensional points that leaves at most ``parts`` components; ``d`` is the
    squared length, ties are broken by the identifiers.

    Edges are found within a radius that doubles. Only points in cells with another component beside them are looked at
    again, so the inside of what has grown together costs nothing.
    """
    kind = df.schema["entity"].dataType.simpleString()
    pts = checkpointed(df.select("entity", "features", F.col("entity").alias("comp")))
    box = pts.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("features")[i]).alias(f"{m}{i}") for i in (0, 1)
                                                  for m, f in (("lo", F.min), ("hi", F.max))]).first()
    spark, path = df.sparkSession, None
    forest = spark.createDataFrame([], f"d double, a {kind}, b {kind}")
    if not box["n"]:
        return forest
    extent = max(box["hi0"] - box["lo0"], box["hi1"] - box["lo1"])
    radius = 2 * extent / math.sqrt(box["n"]) or 1.0
    left = box["n"]
    while left > parts:
        cells = pts.withColumns({"cx": F.floor(F.col("features")[0] / radius), "cy": F.floor(F.col("features")[1] / radius)})
        # cells with more than one component in them or beside them
        names = cells.groupBy("cx", "cy").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _BESIDE])
        around = names.withColumn("_o", F.explode(steps)).groupBy(
            (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy")).agg(
            F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2")
        packs = checkpointed(_packed(cells.join(around, ["cx", "cy"], "left_semi"), ["cx", "cy"], ["comp"]))
        beside = packs.withColumn("_o", F.explode(steps)).select(
            (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy"), F.col("ids").alias("other_ids"),
            F.col("x").alias("other_x"), F.col("comp").alias("other_comp"))
        found = packs.join(beside, ["cx", "cy"]).mapInPandas(_shortest(radius), f"ca {kind}, cb {kind}, d double, a {kind}, b {kind}")
        nearest = scratch_path(spark, "nearest")
        found = written(found.groupBy("ca", "cb").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("ca", "cb", "e.*"), nearest)
        edges, roots = _spanning(found)
        if edges is not None:
            forest = written(forest.unionByName(edges), scratch_path(spark, "forest"))
            moved = pts.join(roots, "comp", "left").select("entity", "features", F.coalesce("root", "comp").alias("comp"))
            before, path = path, scratch_path(spark, "points")
            pts = written(moved, path)
            if before:
                remove(spark, before)
            left = pts.agg(F.count_distinct("comp")).first()[0]
        remove(spark, nearest)
        radius *= 2
    return forest


def hierarchical(df: DataFrame, k: int | None = None) -> DataFrame:
    """Single linkage of two-dimensional points, cut into ``k`` clusters named by their least entity.

    The clusters are what is left of the least spanning tree without its ``k - 1`` longest edges.
    """
    df = checkpointed(df)
    parts, n = k or N_CLUSTERS, df.count()
    forest = checkpointed(spanning_edges(df, parts))
    spare = parts - (n - forest.count())  # a forest of fewer parts loses its longest edges
    if n and spare > 0:
        longest = forest.orderBy(F.col("d").desc(), F.col("a").desc(), F.col("b").desc()).limit(spare)
        forest = forest.join(longest, ["d", "a", "b"], "left_anti")
    roots = components(forest.select("a", "b")).select(F.col("node").alias("entity"), "root")
    return df.join(roots, "entity", "left").withColumn("cluster", F.coalesce("root", "entity").cast("string")).drop("root")


# --- choices -----------------------------------------------------------------------------------

def pick_clustering(df: DataFrame, k: int | None = None, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> tuple[DataFrame, dict]:
    """The candidate with the best silhouette, earlier ones winning ties, and a report of all scores.

    Below four entities everything is cluster 0 with scores of 0. Density clusters score -1 if there
    is noise or only one cluster.
    """
    df = checkpointed(df)
    n = df.count()
    report: dict[str, object] = {}
    if n < MIN_ENTITIES:
        report = {"reason": f"only {n} entities", "kmeans": 0.0, "hierarchical": 0.0, "dbscan": 0.0, "chosen": None}
        return df.withColumn("cluster", F.lit("0")), report
    best, best_score = None, -math.inf
    for name, labelled in (("kmeans", kmeans(df, k)), ("hierarchical", hierarchical(df, k)),
                           ("dbscan", dbscan(df, eps, min_samples).join(df, "entity"))):
        labelled = checkpointed(labelled)
        shape = labelled.agg(F.count_distinct("cluster").alias("c"), F.count_if(F.col("cluster").isNull()).alias("noise")).head()
        if shape["c"] > 1 and not shape["noise"]:
            score = silhouette(labelled).head()[0]
        else:
            score = -1.0 if name == "dbscan" else 0.0
        report[name] = score
        if score > best_score:
            best, best_score = labelled, score
            report["chosen"] = name
    report["score"] = best_score
    return best, report


def pick_reduction(df: DataFrame, k: int | None = None) -> tuple[DataFrame | None, dict]:
    """Components of the plain or of the standardised columns, by the silhouette of their clusters.

    Too few entities or columns give no result and a reason instead of invented rows.
    """
    df = checkpointed(df)
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("w")).head()
    if shape["n"] < MIN_ENTITIES:
        return None, {"reason": f"only {shape['n']} entities", "chosen": None}
    if shape["w"] < 2:
        return None, {"reason": f"only {shape['w']} columns", "chosen": None}
    report: dict[str, object] = {}
    best, best_score = None, -math.inf
    for name, scale in (("pca", False), ("scaled_pca", True)):
        reduced = pca(df, scale=scale)
        labelled = checkpointed(kmeans(as_points(reduced), min(k or N_CLUSTERS, shape["n"])))
        score = silhouette(labelled).head()[0]
        report[name] = score
        if score > best_score:
            best, best_score = labelled, score
            report["chosen"] = name
    return best.select("entity", F.col("features")[0].alias("dim1"), F.col("features")[1].alias("dim2"), "cluster"), report
