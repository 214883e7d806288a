"""Fits per match."""

from pyspark.sql import functions as F

from touchline.operators import fits, teams as tm
from touchline.operators.scans import frame_bucket
from touchline.plans.registry import query

GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
CLUSTERS = f"""vecs AS (SELECT match_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors),
dims AS (SELECT match_id, vec_id, unnest(range(1, len(e) + 1)) AS dim, unnest(e) AS x FROM vecs),
mean AS (SELECT match_id, list(x ORDER BY dim) AS m FROM (SELECT match_id, dim, avg(x) AS x FROM dims GROUP BY ALL) a GROUP BY match_id),
far0 AS (SELECT match_id, arg_max(e, {{'d': {GAP.format(a="e", b="m")}, 'back': -vec_id}}) AS c0 FROM vecs JOIN mean USING (match_id) GROUP BY match_id),
far1 AS (SELECT match_id, any_value(c0) AS c0, arg_max(e, {{'d': {GAP.format(a="e", b="c0")}, 'back': -vec_id}}) AS c1 FROM vecs JOIN far0 USING (match_id) GROUP BY match_id),
lloyd AS (SELECT match_id, 0 AS turn, c0, c1 FROM far1
UNION ALL SELECT match_id, turn + 1, coalesce(list(x ORDER BY dim) FILTER (cluster = 0), any_value(c0)), coalesce(list(x ORDER BY dim) FILTER (cluster = 1), any_value(c1))
FROM (SELECT match_id, turn, cluster, dim, avg(x) AS x, any_value(c0) AS c0, any_value(c1) AS c1 FROM
 (SELECT l.match_id, l.turn, c0, c1, CASE WHEN {GAP.format(a="e", b="c1")} < {GAP.format(a="e", b="c0")} THEN 1 ELSE 0 END AS cluster, unnest(range(1, len(e) + 1)) AS dim, unnest(e) AS x FROM lloyd l JOIN vecs v ON v.match_id = l.match_id WHERE turn < 25) s
 GROUP BY match_id, turn, cluster, dim) a GROUP BY match_id, turn),
final AS (SELECT * FROM lloyd WHERE turn = 25),
placed AS (SELECT match_id, vec_id, CASE WHEN {GAP.format(a="e", b="c1")} < {GAP.format(a="e", b="c0")} THEN 1 ELSE 0 END AS cluster FROM vecs JOIN final USING (match_id))"""


def clusters(fx):
    return fits.match_clusters(fx.vectors.select("match_id", "vec_id", "embedding"), "vec_id")


@query("d17_match_clusters", f"WITH {CLUSTERS} SELECT match_id, vec_id, cluster FROM placed")
def d17_matches(fx):
    """Two clusters of every match."""
    return clusters(fx)


@query("d18_match_predictions", f"""WITH {CLUSTERS}, means AS (SELECT match_id, cluster, dim, avg(x) AS x FROM placed JOIN dims USING (match_id, vec_id) GROUP BY ALL),
gaps AS (SELECT c.match_id, c.vec_id, m.cluster, sum((c.x - m.x) * (c.x - m.x)) AS d FROM dims c JOIN means m ON m.match_id = c.match_id AND m.dim = c.dim WHERE c.vec_id % 3 = 0 GROUP BY ALL)
SELECT match_id, vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY match_id, vec_id ORDER BY d, cluster) AS rn FROM gaps) g WHERE rn = 1""")
def d18_matches(fx):
    """New crops by the clusters of their own match."""
    crops = fx.vectors.select("match_id", "vec_id", "embedding")
    labelled = crops.join(clusters(fx), ["match_id", "vec_id"])
    return tm.nearest_centroid(crops.filter("vec_id % 3 = 0"), tm.centroids(labelled)).select("match_id", "vec_id", "cluster")


def axes(fx, features):
    return fits.match_components(fits.moments(features, frame_bucket("vec_id", 64), "x"))


# the axes have no plain SQL, so it states what they must be: the query measures it on the rows themselves
@query("d25_match_components", """WITH dims AS (SELECT match_id, unnest(range(1, len(embedding) + 1)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM fx_vectors)
SELECT match_id, (SELECT count(*) FROM fx_vectors v WHERE v.match_id = s.match_id) AS n, round(sum(v), 6) AS total_variance, true AS orthonormal, true AS uncorrelated, true AS shares_fit
FROM (SELECT match_id, dim, var_samp(x) AS v FROM dims GROUP BY ALL) s GROUP BY match_id""")
def d25_matches(fx):
    """Principal axes of every match; orthonormal, with uncorrelated projections whose variances are the stated ones."""
    features = fx.vectors.select("match_id", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    found = axes(fx, features)
    on = fits.project(features, ["match_id", "vec_id"], found, "x").select("match_id", F.col("components")[0].alias("p"), F.col("components")[1].alias("q"))
    held = on.groupBy("match_id").agg(F.var_samp("p").alias("vp"), F.var_samp("q").alias("vq"), F.covar_samp("p", "q").alias("pq"))

    def product(i, j):
        return F.aggregate(F.zip_with(F.col("axes")[i], F.col("axes")[j], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    near = lambda a, b: F.abs(a - b) < 1e-9 * (1 + F.col("total_variance"))
    v = F.col("variances")
    return found.join(held, "match_id").select(
        "match_id",
        "n",
        F.round("total_variance", 6).alias("total_variance"),
        (near(product(0, 0), F.lit(1)) & near(product(1, 1), F.lit(1)) & near(product(0, 1), F.lit(0))).alias("orthonormal"),
        near(F.col("pq"), F.lit(0)).alias("uncorrelated"),
        (near(F.col("vp"), v[0]) & near(F.col("vq"), v[1]) & (v[0] >= v[1]) & (v[0] + v[1] <= F.col("total_variance"))).alias("shares_fit"),
    )
