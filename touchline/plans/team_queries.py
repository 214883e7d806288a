"""Teams and colours."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from touchline.operators import teams as tm
from touchline.operators.joins import dealt
from touchline.operators.scans import frame_bucket, minute_bucket
from touchline.plans.registry import query
from touchline.plans.scalar_queries import rgb_sql

HIST = """slots AS (SELECT match_id, frame_idx, track_id, 'hue' AS channel, CAST(floor(hue * 64 / 180e0) AS INT) AS bin FROM fx_pixels
 UNION ALL SELECT match_id, frame_idx, track_id, 'sat', CAST(floor(sat * 32 / 256e0) AS INT) FROM fx_pixels),
shares AS (SELECT match_id, frame_idx, track_id, channel, bin, count(*) / 72e0 AS share FROM slots GROUP BY ALL)"""


@query("d21_colour_histogram", f"WITH {HIST} SELECT match_id, frame_idx, track_id, channel, bin, round(share, 9) AS share FROM shares")
def d21(fx):
    """Colour histogram of every crop."""
    return tm.histogram(fx.pixels).withColumn("share", F.round("share", 9))


@query("d23_dominant_hue", f"""WITH {HIST} SELECT match_id, frame_idx, track_id, bin, bin * 2.8125e0 AS hue FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx, track_id ORDER BY share DESC, bin) AS rn
 FROM shares WHERE channel = 'hue') x WHERE rn = 1""")
def d23(fx):
    """Fullest hue bin of every crop."""
    return tm.dominant_hue(tm.histogram(fx.pixels))


@query("d24_mean_histogram", f"""WITH {HIST}, sizes AS (SELECT match_id, CAST(track_id % 2 AS INT) AS cluster, count(*) AS n FROM (SELECT DISTINCT match_id, frame_idx, track_id FROM fx_pixels) c GROUP BY ALL)
SELECT s.match_id, z.cluster, channel, bin, round(sum(share) / max(n), 9) AS share FROM shares s JOIN sizes z ON z.match_id = s.match_id AND z.cluster = s.track_id % 2 GROUP BY s.match_id, z.cluster, channel, bin""")
def d24(fx):
    """Mean histogram per cluster."""
    crops = fx.frames.select("match_id", "frame_idx", F.col("holder").alias("track_id"), (F.col("holder") % 2).cast("int").alias("cluster"))
    return tm.mean_histogram(tm.histogram(fx.pixels), crops).withColumn("share", F.round("share", 9))


MEAN = """core AS (SELECT * FROM fx_pixels WHERE px >= 1 AND px < 5 AND py >= 1 AND py < 5),
sums AS (SELECT {key}, sum(sat * sin(hue * (pi() / 90))) AS s, sum(sat * cos(hue * (pi() / 90))) AS c, avg(sat) AS sat, avg(val) AS val FROM core {join} GROUP BY ALL),
means AS (SELECT *, (atan2(s, c) * 90 / pi() + 360) % 180 AS hue FROM sums)"""


@query("d22_mean_colour", "WITH " + MEAN.format(key="match_id, frame_idx, track_id", join="") + """ SELECT match_id, frame_idx, track_id, round(sat * cos(hue * (pi() / 90)), 5) + 0e0 AS a, round(sat * sin(hue * (pi() / 90)), 5) + 0e0 AS b, round(val, 5) AS v FROM means""")
def d22(fx):
    """Mean colour of the middle of every crop."""
    m = tm.mean_colour(tm.centre_pixels(fx.pixels), tm.CROP)
    return m.select(*tm.CROP, (F.round("vec.a", 5) + 0.0).alias("a"), (F.round("vec.b", 5) + 0.0).alias("b"), F.round("vec.v", 5).alias("v"))


def spec_tables(first, second):
    """Reference vectors of two colour columns for the checking engine."""
    both = f"sides AS (SELECT match_id, 0 AS side, {first} AS colour FROM fx_matches UNION ALL SELECT match_id, 1, {second} FROM fx_matches), "
    return both + rgb_sql("sides", "colour", "match_id, side") + f""", vecs AS (SELECT match_id, side, s * cos(h * (pi() / 90)) AS a, s * sin(h * (pi() / 90)) AS b, v FROM hsv WHERE h IS NOT NULL),
specs AS (SELECT p.match_id, p.a AS a0, p.b AS b0, p.v AS v0, q.a AS a1, q.b AS b1, q.v AS v1 FROM vecs p JOIN vecs q ON q.match_id = p.match_id WHERE p.side = 0 AND q.side = 1)"""


@query("c2_goalkeepers", "WITH " + spec_tables("team_a_gk_colour", "team_b_gk_colour") + """,
d AS (SELECT p.match_id, p.frame_idx, p.track_id, t.side AS side, sqrt(pow(ca - CASE t.side WHEN 0 THEN a0 ELSE a1 END, 2) + pow(cb - CASE t.side WHEN 0 THEN b0 ELSE b1 END, 2) + pow(cv - CASE t.side WHEN 0 THEN v0 ELSE v1 END, 2)) AS dist
 FROM fx_player_colours p JOIN specs s ON s.match_id = p.match_id CROSS JOIN (VALUES (0), (1)) t(side) WHERE ca IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx, side ORDER BY dist, track_id) AS rn FROM d) r WHERE rn = 1 AND dist < 60)
SELECT match_id, frame_idx, track_id, CAST(max(side) AS INT) AS team_id FROM n GROUP BY match_id, frame_idx, track_id""")
def c2(fx):
    """Goalkeepers by colour."""
    return tm.goalkeepers(fx.player_colours, fx.matches)


@query("c13_cluster_to_team", "WITH " + spec_tables("team_a_colour", "team_b_colour") + ", " + MEAN.format(key="match_id, track_id % 2 AS cluster", join="") + """,
cl AS (SELECT match_id, cluster, sat * cos(hue * (pi() / 90)) AS a, sat * sin(hue * (pi() / 90)) AS b, val AS v FROM means),
cost AS (SELECT s.match_id, coalesce(sqrt(pow(x.a - a0, 2) + pow(x.b - b0, 2) + pow(x.v - v0, 2)), 1e9) + coalesce(sqrt(pow(y.a - a1, 2) + pow(y.b - b1, 2) + pow(y.v - v1, 2)), 1e9) AS straight,
 coalesce(sqrt(pow(x.a - a1, 2) + pow(x.b - b1, 2) + pow(x.v - v1, 2)), 1e9) + coalesce(sqrt(pow(y.a - a0, 2) + pow(y.b - b0, 2) + pow(y.v - v0, 2)), 1e9) AS swapped
 FROM specs s LEFT JOIN cl x ON x.match_id = s.match_id AND x.cluster = 0 LEFT JOIN cl y ON y.match_id = s.match_id AND y.cluster = 1)
SELECT match_id, round(straight, 4) AS straight, round(swapped, 4) AS swapped, CASE WHEN straight <= swapped THEN 0 ELSE 1 END AS team_a_cluster_id FROM cost""")
def c13(fx):
    """Which cluster is team a."""
    pixels = fx.pixels.withColumn("cluster", F.col("track_id") % 2)
    colours = tm.mean_colour(tm.centre_pixels(pixels), ["match_id", "cluster"])
    out = tm.resolve_clusters(colours, fx.matches)
    return out.withColumns({"straight": F.round("straight", 4), "swapped": F.round("swapped", 4)})


def labelled(fx):
    return fx.vectors.withColumnRenamed("team_id", "cluster")


@query("d17_team_clusters")
def d17(fx):
    """Two clusters over all embeddings, and their sizes."""
    model = tm.fit_clusters(fx.vectors, column="embedding")
    return tm.predict_clusters(model, fx.vectors, "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


@query("d18_nearest_cluster", """WITH dims AS (SELECT match_id, team_id AS cluster, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding) AS x FROM fx_vectors),
centre AS (SELECT match_id, cluster, dim, avg(CAST(x AS DOUBLE)) AS x FROM dims GROUP BY ALL),
crops AS (SELECT match_id, vec_id, embedding FROM fx_vectors WHERE 20 + vec_id % 50 >= 32),
gaps AS (SELECT c.match_id, c.vec_id, m.cluster, sum((CAST(c.embedding[m.dim] AS DOUBLE) - m.x) * (CAST(c.embedding[m.dim] AS DOUBLE) - m.x)) AS d FROM crops c JOIN centre m ON m.match_id = c.match_id GROUP BY ALL)
SELECT match_id, vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY match_id, vec_id ORDER BY d, cluster) AS rn FROM gaps) g WHERE rn = 1""")
def d18(fx):
    """Cluster of every crop that is large enough."""
    crops = fx.vectors.filter(20 + F.col("vec_id") % 50 >= 32).select("match_id", "vec_id", "embedding")
    return tm.nearest_centroid(crops, tm.centroids(labelled(fx))).select("match_id", "vec_id", "cluster")


@query("f10_even_sample", """WITH n AS (SELECT match_id, count(*) AS n FROM fx_vectors GROUP BY match_id),
i AS (SELECT match_id, CAST(floor(t.i * ((n - 1) / 29e0)) AS BIGINT) AS at FROM n CROSS JOIN (SELECT unnest(range(0, 29)) AS i) t UNION SELECT match_id, n - 1 FROM n),
p AS (SELECT match_id, vec_id, row_number() OVER (PARTITION BY match_id ORDER BY vec_id) - 1 AS at FROM fx_vectors)
SELECT p.match_id, p.vec_id FROM p JOIN i ON i.match_id = p.match_id AND i.at = p.at""")
def f10(fx):
    """30 evenly spaced rows per match (the sampling operator)."""
    return tm.evenly_spaced(fx.vectors.select("match_id", "vec_id"), ["match_id"], frame_bucket("vec_id"), ["vec_id"], 30)


@query("d19_silhouette", """WITH d AS (SELECT a.match_id, a.vec_id, a.team_id AS own, b.team_id AS other, sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
 FROM fx_vectors a JOIN fx_vectors b ON b.match_id = a.match_id AND b.vec_id <> a.vec_id),
m AS (SELECT match_id, vec_id, own, avg(d) FILTER (other = own) AS a, avg(d) FILTER (other <> own) AS b FROM d GROUP BY ALL)
SELECT match_id, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) END AS score, CASE WHEN count(*) < 10 THEN 'too_few' ELSE 'ok' END AS status FROM m GROUP BY match_id""")
def d19(fx):
    """How well two teams separate, per match."""
    rows = labelled(fx).select("match_id", "vec_id", "cluster", "embedding")
    sample = tm.evenly_spaced(rows, ["match_id"], frame_bucket("vec_id"), ["vec_id"], tm.SILHOUETTE_SAMPLE)
    return tm.silhouette(sample).withColumn("score", F.round("score", 6))


SCORES = "SELECT match_id, half, minute, CASE WHEN (first_frame + mno * 2) % 7 < 4 THEN 1e-1 ELSE 25e-2 END AS score FROM fx_processed"


@query("d20_fit_decisions", f"""WITH s AS ({SCORES}), p AS (SELECT *, row_number() OVER w - 1 AS clip_no, lag(score) OVER w AS before FROM s WINDOW w AS (PARTITION BY match_id ORDER BY half, minute)),
d AS (SELECT *, CASE WHEN clip_no = 0 THEN CASE WHEN score >= 2e-1 THEN 'fit' ELSE 'refit' END WHEN clip_no = 1 AND before < 2e-1 THEN CASE WHEN score >= 2e-1 THEN 'refit_ok' ELSE 'refit_forced' END ELSE 'kept' END AS decision FROM p)
SELECT match_id, half, minute, clip_no, decision, CASE WHEN decision = 'refit' THEN 'refit' ELSE 'ok' END AS fit_status FROM d""")
def d20(fx):
    """When a team fit is kept, repeated or forced."""
    return tm.fit_decisions(fx.sql(SCORES), minute_bucket(), ["half", "minute"]).select("match_id", "half", "minute", "clip_no", "decision", "fit_status")


@query("d25_principal_components")
def d25(fx):
    """Two principal components of the colour histograms."""
    features = tm.histogram_vectors(tm.histogram(fx.pixels))
    rows, shares = tm.principal_components(features, tm.CROP)
    xy = vector_to_array("components")
    return rows.select(*tm.CROP, xy[0].alias("pc1"), xy[1].alias("pc2"), F.lit(float(shares[0])).alias("explained1"), F.lit(float(shares[1])).alias("explained2"))


@query("f9_cluster_sample", """SELECT match_id, frame_idx, track_id, cluster FROM (SELECT match_id, frame_idx, track_id, team_id AS cluster,
 row_number() OVER (PARTITION BY match_id, team_id ORDER BY md5(concat_ws(':', '0', match_id, CAST(frame_idx AS VARCHAR), CAST(track_id AS VARCHAR))), match_id, frame_idx, track_id) AS rn FROM fx_crops) r WHERE rn <= 30""")
def f9(fx):
    """at most 30 crops per cluster (the sampling operator)."""
    crops = fx.crops.select("match_id", "frame_idx", "track_id", F.col("team_id").alias("cluster"))
    return tm.sample_per_cluster(crops)


@query("g2_fit_set", "SELECT match_id, frame_idx, track_id, minute FROM fx_crops JOIN fx_frames USING (match_id, frame_idx) WHERE half = 1 AND minute IN (1, 2)")
def g2(fx):
    """Crops of the first clip together with those of the second."""
    crops = fx.crops.select("match_id", "frame_idx", "track_id").join(dealt(fx.frames.select("match_id", "frame_idx", "half", "minute")), ["match_id", "frame_idx"])
    first, second = crops.filter("half = 1 AND minute = 1"), crops.filter("half = 1 AND minute = 2")
    return first.unionByName(second).select("match_id", "frame_idx", "track_id", "minute")
