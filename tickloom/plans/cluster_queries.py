"""M1-M7: reduction and clustering queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.functions.dates import day_text
from tickloom.operators import cluster as C
from tickloom.operators import quality as Q
from tickloom.plans.registry import query, r, rnd
from tickloom.plans.views import bars_day, points, using
from tickloom.session import checkpointed


def features(spark, sf):
    return points(spark, sf).select("entity", F.col("cluster").cast("string").alias("cluster"),
                                    F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _directions(turns: int) -> list[float]:
    """A fixed direction over all 64 components, spread so that the default radius separates some of the points."""
    return [round(20 * math.sqrt(2 / 64) * math.cos(2 * math.pi * turns * i / 64 + turns), 6) for i in range(64)]


def plane(spark, sf, turns=(1, 3)):
    """All components of the points, projected onto fixed directions."""
    def along(turn: int):
        weights = F.array(*[F.lit(w) for w in _directions(turn)])
        return F.round(F.aggregate(F.zip_with("features", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 9)
    return features(spark, sf).select("entity", F.array(*[along(t) for t in turns]).alias("features"))


def ticker_matrix(spark, sf):
    recent = Q.restrict_recent_days(bars_day(spark, sf), 60)
    cells = checkpointed(Q.to_cells(recent).withColumn("d", day_text(F.col("ts"))).drop("ts"))
    return C.entity_rows(Q.standard_scale(Q.fill_sparse(Q.drop_sparse(cells, 0.3))), value="scaled")


@query("m1_pca")
def m1(spark, sf):
    return C.pca(features(spark, sf)).select("entity", rnd("dim1").alias("dim1"), rnd("dim2").alias("dim2"))


@query("m1_pca_rules", """SELECT count(*) AS entities, CAST(0 AS DOUBLE) AS mean1, CAST(0 AS DOUBLE) AS mean2, CAST(0 AS DOUBLE) AS covariance,
  true AS first_is_widest, true AS no_wider_than_total FROM embeddings""")
def m1_rules(spark, sf):
    """What components must satisfy: centred, uncorrelated, in order of variance, none above the total variance."""
    d = features(spark, sf)
    total = d.select(F.posexplode("features").alias("k", "v")).groupBy("k").agg(F.var_samp("v").alias("v")).agg(F.sum("v")).scalar()
    small = lambda c: F.round(c, 6) + 0.0  # noqa: E731  (no minus zero)
    return C.pca(d).agg(
        F.count(F.lit(1)).alias("entities"), small(F.avg("dim1")).alias("mean1"), small(F.avg("dim2")).alias("mean2"),
        small(F.covar_samp("dim1", "dim2")).alias("covariance"), (F.var_samp("dim1") >= F.var_samp("dim2")).alias("first_is_widest"),
        (F.var_samp("dim1") + F.var_samp("dim2")).alias("_v")).withColumn(
        "no_wider_than_total", F.col("_v") <= total * 1.000001).drop("_v")


@query("m1_pca_tickers")
def m1_tickers(spark, sf):
    return C.pca(ticker_matrix(spark, sf)).select("entity", rnd("dim1").alias("dim1"), rnd("dim2").alias("dim2"))


@query("m2_kmeans")
def m2(spark, sf):
    return C.kmeans(C.as_points(C.pca(features(spark, sf)))).select("entity", "cluster")


@query("m2_kmeans_rules", """SELECT count(*) AS entities, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS nearer_to_another FROM embeddings""")
def m2_rules(spark, sf):
    """Every point of a settled clustering is nearest to the mean of its own cluster (up to the last move of the means)."""
    d = checkpointed(C.kmeans(C.as_points(C.pca(features(spark, sf)))))
    x, y = F.col("features")[0], F.col("features")[1]
    means = d.groupBy("cluster").agg(F.avg(x).alias("mx"), F.avg(y).alias("my")).collect()  # four rows
    far = {r["cluster"]: (x - r["mx"]) ** 2 + (y - r["my"]) ** 2 for r in means}
    own = F.coalesce(*[F.when(F.col("cluster") == c, e) for c, e in far.items()])
    return d.agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("cluster").alias("clusters"),
                 F.count_if(own > F.least(*far.values()) * 1.05 + 1e-3).alias("nearer_to_another"))


_DIST_FORM = """pts AS (SELECT entity, cluster, CAST(embedding AS DOUBLE[]) AS e FROM points),
  d AS (SELECT a.entity, a.cluster AS own, b.cluster, sum(list_distance(a.e, b.e){power}) AS total, count(*) AS n FROM pts a, pts b GROUP BY ALL),
  ab AS (SELECT entity, own, max(CASE WHEN own = cluster THEN n END) AS k, max(CASE WHEN own = cluster AND n > 1 THEN total / (n - 1) END) AS a,
  min(CASE WHEN own <> cluster THEN total / n END) AS b FROM d GROUP BY ALL),
  s AS (SELECT entity, CAST(own AS VARCHAR) AS cluster, CASE WHEN k > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM ab)"""
_DIST, _SQUARED = _DIST_FORM.format(power=""), _DIST_FORM.format(power=" ** 2")


@query("m3_silhouette", using("points", f"SELECT {r('avg(s)', 5)} AS silhouette FROM s", _DIST))
def m3(spark, sf):
    return C.silhouette(features(spark, sf)).select(rnd("silhouette", 5).alias("silhouette"))


@query("m3_silhouette_each", using("points", f"SELECT entity, cluster, {r('s', 5)} AS silhouette FROM s", _DIST))
def m3_each(spark, sf):
    return C.euclidean_silhouette_of(features(spark, sf)).select("entity", "cluster", rnd("silhouette", 5).alias("silhouette"))


@query("m3_silhouette_squared", using("points", f"SELECT entity, cluster, {r('s', 5)} AS silhouette FROM s", _SQUARED))
def m3_squared(spark, sf):
    return C.silhouette_of(features(spark, sf)).select("entity", "cluster", rnd("silhouette", 5).alias("silhouette"))


def _projected(*turns: int) -> str:
    """The points of ``plane`` as pt(entity, x, y, ...)."""
    return "pt AS (SELECT entity, " + ", ".join(
        f"round(list_inner_product(CAST(embedding AS DOUBLE[]), {_directions(k)}::DOUBLE[]), 9) AS {n}" for n, k in zip("xyz", turns)) + " FROM points)"


_PLANE = _projected(1, 3)


def density_sql(pt: str, far: str) -> str:
    """Every point with its least reachable one, null for points without another one within 0.5."""
    return using("points", """SELECT p.entity, CASE WHEN c.root IS NOT NULL AND EXISTS (SELECT 1 FROM near n WHERE n.a = p.entity AND n.b <> p.entity) THEN CAST(c.root AS VARCHAR) END AS cluster
  FROM pt p LEFT JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) c ON c.a = p.entity""",
        pt, f"near AS (SELECT a.entity AS a, b.entity AS b FROM pt a JOIN pt b ON sqrt({far}) <= 0.5)",
        "reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)", recursive=True)


@query("m4_dbscan", density_sql(_PLANE, "(a.x - b.x) ** 2 + (a.y - b.y) ** 2"))
def m4(spark, sf):
    return C.dbscan(plane(spark, sf))


@query("m4_dbscan_space", density_sql(_projected(1, 3, 5), "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"))
def m4_space(spark, sf):
    return C.dbscan(plane(spark, sf, (1, 3, 5)))


@query("m5_pick_clustering")
def m5(spark, sf):
    best, report = C.pick_clustering(C.as_points(C.pca(features(spark, sf))))
    return best.select("entity", "cluster", F.lit(report["chosen"]).alias("method"), rnd(F.lit(report["score"])).alias("score"))


# edges that no third point is nearer to both ends of hold the least spanning tree; joined in order of length until four parts are left
@query("m6_hierarchical", using("points", """SELECT entity, CAST(labels[i] AS VARCHAR) AS cluster FROM num, (SELECT labels FROM joined WHERE merges = (SELECT count(*) FROM pt) - 4 LIMIT 1)""",
  _PLANE, "num AS (SELECT entity, row_number() OVER (ORDER BY entity) AS i FROM pt)",
  "dist AS MATERIALIZED (SELECT a.entity AS a, b.entity AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM pt a JOIN pt b ON a.entity <> b.entity)",
  """lean AS (SELECT * FROM dist e WHERE a < b AND NOT EXISTS (SELECT 1 FROM dist p JOIN dist q ON q.a = e.b AND q.b = p.b WHERE p.a = e.a AND p.d < e.d AND q.d < e.d))""",
  "edges AS MATERIALIZED (SELECT x.i AS i, y.i AS j, row_number() OVER (ORDER BY d, a, b) AS k FROM lean JOIN num x ON x.entity = a JOIN num y ON y.entity = b)",
  """joined AS (SELECT 0 AS k, 0 AS merges, (SELECT list(entity ORDER BY i) FROM num) AS labels UNION ALL
  SELECT e.k, merges + CASE WHEN labels[e.i] <> labels[e.j] THEN 1 ELSE 0 END,
  list_transform(labels, lambda l: CASE WHEN l = greatest(labels[e.i], labels[e.j]) THEN least(labels[e.i], labels[e.j]) ELSE l END)
  FROM joined s JOIN edges e ON e.k = s.k + 1 WHERE merges < (SELECT count(*) FROM pt) - 4)""", recursive=True))
def m6(spark, sf):
    return C.hierarchical(plane(spark, sf)).select("entity", "cluster")


@query("m7_pick_reduction")
def m7(spark, sf):
    best, report = C.pick_reduction(ticker_matrix(spark, sf))
    if best is None:
        return spark.createDataFrame([], "entity string, dim1 double, dim2 double, cluster string, method string")
    return best.select("entity", rnd("dim1").alias("dim1"), rnd("dim2").alias("dim2"), "cluster", F.lit(report["chosen"]).alias("method"))
