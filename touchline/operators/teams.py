"""Team and goalkeeper assignment from colour and embedding features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import colours as col, geometry as geo
from touchline.operators.joins import dealt
from touchline.operators.scans import number_rows, previous, running_sum, scan
from touchline.session import durable

# fixed values: channel, bins, upper end of the range
HUE_SAT = [("hue", 64, 180), ("sat", 32, 256)]
HUE_SAT_VAL = [("hue", 36, 180), ("sat", 32, 256), ("val", 16, 256)]
# fixed values
SILHOUETTE_MIN, SILHOUETTE_SAMPLE, MIN_CROPS = 0.20, 600, 10
CROPS_PER_CLUSTER, SAMPLE_SEED, NO_COLOUR_COST = 30, 0, 1e9
CROP = ["match_id", "frame_idx", "track_id"]


def histogram(pixels: DataFrame, key: list[str] = CROP, bins=HUE_SAT) -> DataFrame:
    """Share of each channel bin per crop: rows (key, channel, bin, share).

    All channels together sum to 1. Empty bins have no row.
    """
    # dealt once by crop: counting, the sum of a crop and joins by crop then need no further shuffle
    placed = pixels.select(*key, *[F.floor(F.col(name) * n / F.lit(top)).cast("int").alias(name) for name, n, top in bins]).repartition(*key)
    slots = [F.struct(F.lit(name).alias("channel"), F.col(name).alias("bin")) for name, _, _ in bins]
    counts = placed.select(*key, F.explode(F.array(*slots)).alias("s")).groupBy(*key, "s.channel", "s.bin").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*key))
    return counts.select(*key, "channel", "bin", (F.col("n") / whole).alias("share"))


def histogram_vectors(shares: DataFrame, key: list[str] = CROP, bins=HUE_SAT) -> DataFrame:
    """Histogram rows as one array per crop, channels one after another."""
    base, at = F.when(F.lit(False), 0), 0
    for name, n, _ in bins:
        base, at = base.when(F.col("channel") == name, at), at + n
    entries = F.map_from_entries(F.collect_list(F.struct((base + F.col("bin")).cast("int"), "share")))
    feature = F.transform(F.sequence(F.lit(0), F.lit(at - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return shares.groupBy(*key).agg(entries.alias("m")).select(*key, feature.alias("features"))


def dominant_hue(shares: DataFrame, key: list[str] = CROP, n_bins: int = 64) -> DataFrame:
    """Fullest hue bin, the first on ties, and its hue."""
    hues = shares.filter(F.col("channel") == "hue")
    best = hues.groupBy(*key).agg(F.max_by("bin", F.struct("share", -F.col("bin"))).alias("bin"))
    return best.withColumn("hue", F.col("bin") * F.lit(180.0 / n_bins))


def mean_histogram(shares: DataFrame, clusters: DataFrame, key: list[str] = CROP) -> DataFrame:
    """Mean share of every bin per (match, cluster); crops without a bin count as 0.

    ``clusters`` gives ``cluster`` per crop.
    """
    sizes = clusters.groupBy("match_id", "cluster").agg(F.count("*").alias("crops"))
    sums = shares.join(dealt(clusters), key).groupBy("match_id", "cluster", "channel", "bin").agg(F.sum("share").alias("total"))
    return sums.join(sizes, ["match_id", "cluster"]).select(
        "match_id", "cluster", "channel", "bin", (F.col("total") / F.col("crops")).alias("share")
    )


def centre_pixels(pixels: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Pixels of the middle ``ratio`` of each crop."""
    mx, my = geo.centre_margin(F.col("crop_w"), ratio), geo.centre_margin(F.col("crop_h"), ratio)
    inside = (F.col("px") >= mx) & (F.col("px") < F.col("crop_w") - mx) & (F.col("py") >= my) & (F.col("py") < F.col("crop_h") - my)
    return pixels.filter(inside)


def mean_colour(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Mean colour per key as ``vec``; hue is a circular mean weighted by saturation."""
    angle = col.hue_angle(F.col("hue"))
    sums = pixels.groupBy(*key).agg(
        F.sum(F.col("sat") * F.sin(angle)).alias("s"),
        F.sum(F.col("sat") * F.cos(angle)).alias("c"),
        F.avg("sat").alias("sat"),
        F.avg("val").alias("val"),
    )
    hue = F.pmod(F.atan2("s", "c") * F.lit(90.0 / np.pi), F.lit(180.0))
    return sums.select(*key, hue.alias("hue"), "sat", "val", col.colour_vector(hue, F.col("sat"), F.col("val")).alias("vec"))


def goalkeepers(players: DataFrame, references: DataFrame, max_dist: Column | float = 60.0) -> DataFrame:
    """Goalkeeper rows (match_id, frame_idx, track_id, team_id).

    ``players`` has colour columns ca, cb, cv (null without a crop); ``references`` one row
    per match with the colour texts of both keepers. Each reference takes its nearest
    player if closer than ``max_dist``; a player taken by both belongs to team 1.
    """
    refs = references.select(
        "match_id", col.text_vector(F.col("team_a_gk_colour")).alias("r0"), col.text_vector(F.col("team_b_gk_colour")).alias("r1")
    ).filter("r0 IS NOT NULL AND r1 IS NOT NULL")
    # written, so that their size is known and the players are not taken for the smaller side
    refs = durable(refs, "references")
    vec = F.struct(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("cv").alias("v"))
    seen = players.filter(F.col("ca").isNotNull()).join(refs, "match_id")
    dist = {f"d{t}": col.colour_distance(vec, F.col(f"r{t}")) for t in (0, 1)}
    best = (
        seen.withColumns(dist)
        .groupBy("match_id", "frame_idx")
        .agg(*[F.min(F.struct(f"d{t}", "track_id")).alias(f"n{t}") for t in (0, 1)])
    )
    near = [F.col(f"n{t}.d{t}") < F.lit(max_dist) for t in (0, 1)]
    one = F.when(near[1], F.struct(F.col("n1.track_id").alias("track_id"), F.lit(1).alias("team_id")))
    taken = F.coalesce(near[1] & (F.col("n0.track_id") == F.col("n1.track_id")), F.lit(False))
    zero = F.when(near[0] & ~taken, F.struct(F.col("n0.track_id").alias("track_id"), F.lit(0).alias("team_id")))
    return best.select("match_id", "frame_idx", F.explode(F.array_compact(F.array(zero, one))).alias("g")).select("match_id", "frame_idx", "g.*")


def resolve_clusters(cluster_colours: DataFrame, matches: DataFrame) -> DataFrame:
    """Cluster that is team a, per match: the cheaper of both one-to-one mappings.

    ``cluster_colours``: match_id, cluster (0 or 1), vec. A tie keeps the straight mapping;
    a cluster without colour costs a fixed amount either way.
    """
    vecs = cluster_colours.groupBy("match_id").agg(*[F.max_by("vec", F.when(F.col("cluster") == c, 1)).alias(f"c{c}") for c in (0, 1)])
    specs = matches.select("match_id", col.text_vector(F.col("team_a_colour")).alias("s0"), col.text_vector(F.col("team_b_colour")).alias("s1"))
    both = specs.filter("s0 IS NOT NULL AND s1 IS NOT NULL").join(vecs, "match_id", "left")

    def cost(c: int, s: int) -> Column:
        return F.coalesce(col.colour_distance(F.col(f"c{c}"), F.col(f"s{s}")), F.lit(NO_COLOUR_COST))

    straight, swapped = cost(0, 0) + cost(1, 1), cost(0, 1) + cost(1, 0)
    return both.select(
        "match_id", straight.alias("straight"), swapped.alias("swapped"), F.when(straight <= swapped, 0).otherwise(1).alias("team_a_cluster_id")
    )


def smallest(rows: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """``rows`` without those that have ``n`` smaller values of ``by`` beside them in one Arrow batch, of the same ``keys``.

    All of the ``n`` smallest of every group stay, with those equal to the last, so a rank filter that follows sorts few rows.
    """

    def keep(batches):
        for batch in batches:
            at = batch.select([*keys, by]).to_pandas()
            rank = at.groupby(keys, dropna=False)[by].rank(method="min")
            yield batch.filter(pa.array((rank <= n).to_numpy()))

    return rows.mapInArrow(keep, rows.schema)


def sample_per_cluster(crops: DataFrame, n: int = CROPS_PER_CLUSTER, seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``n`` crops per (match, cluster), those with the smallest md5 of the seed and their own key.

    Every batch of rows drops those that cannot be among them by the first 60 bits, so no task sorts the crops it reads;
    a large cluster sends ``n`` rows per task.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in CROP]))
    first = crops.withColumn("_first", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    w = Window.partitionBy("match_id", "cluster").orderBy(key, *CROP)
    ranked = smallest(first, ["match_id", "cluster"], "_first", n).withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") <= n).drop("_rank", "_first")


def evenly_spaced(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], n: int) -> DataFrame:
    """``n`` rows per group at the whole parts of equal steps from first to last.

    Whether a row is one of them follows from its position and the size of its group.
    """
    placed = number_rows(rows, keys, bucket, order, "_at")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    step = (F.col("_size") - 1) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    guess = F.floor(F.col("_at") / step)
    hit = F.col("_at") == F.col("_size") - 1
    for shift in (-1, 0, 1, 2):
        i = guess + shift
        hit = hit | ((i >= 0) & (i < n - 1) & (F.floor(i * step) == F.col("_at")))
    if n == 1:
        hit = F.col("_at") == 0
    return placed.join(sizes, keys).filter((F.col("_size") <= n) | hit).drop("_at", "_size")


def fit_clusters(features: DataFrame, k: int = 2, seed: int = 42, n_init: int = 3, column: str = "features") -> KMeansModel:
    """Best of ``n_init`` k-means fits."""
    rows = features.select(array_to_vector(F.col(column).cast("array<double>")).alias("features")).persist()
    try:
        fits = [KMeans(k=k, seed=seed + i, maxIter=300).fit(rows) for i in range(n_init)]
        return min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()


def predict_clusters(model: KMeansModel, rows: DataFrame, column: str = "features") -> DataFrame:
    vectors = rows.withColumn("_vec", array_to_vector(F.col(column).cast("array<double>")))
    return model.setFeaturesCol("_vec").setPredictionCol("cluster").transform(vectors).drop("_vec")


def centroids(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Mean vector per (match, cluster)."""
    dims = rows.select("match_id", "cluster", F.posexplode(column).alias("dim", "x"))
    means = dims.groupBy("match_id", "cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return means.groupBy("match_id", "cluster").agg(ordered.alias("centroid"))


def nearest_centroid(rows: DataFrame, centres: DataFrame, column: str = "embedding") -> DataFrame:
    """Cluster of the nearest centroid of the same match, the lower one on ties."""
    pair = centres.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("_centres"))

    def gap(c: Column) -> Column:
        squares = F.zip_with(F.col(column), c["centroid"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
        return F.struct(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x).alias("d"), c["cluster"].alias("cluster"))

    best = F.array_min(F.transform("_centres", gap))
    return rows.join(pair, "match_id").withColumn("cluster", best["cluster"]).drop("_centres")


def silhouette(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Mean Euclidean silhouette per match over a sample of at most 600 rows.

    ``rows``: match_id, cluster, vector, already sampled by ``evenly_spaced``; the sample
    bounds the group. One cluster gives -1. ``status`` is ``ok``, ``too_few`` for fewer than ten rows and ``not_sampled``
    for more than the sample; the score of those is null and the other matches are not affected. A
    row as far from its own cluster as from the next one, equal vectors included, counts as 0.
    """

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        if not MIN_CROPS <= len(pdf) <= SILHOUETTE_SAMPLE:
            status = "too_few" if len(pdf) < MIN_CROPS else "not_sampled"
            return pd.DataFrame({"match_id": [pdf["match_id"].iloc[0]], "n": [len(pdf)], "score": [None], "status": [status]})
        x, labels = np.stack(pdf[column].to_numpy()).astype(float), pdf["cluster"].to_numpy()
        names, sizes = np.unique(labels, return_counts=True)
        value = -1.0
        if len(names) > 1:
            sq = (x * x).sum(axis=1)
            dist = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2.0 * x @ x.T, 0.0))
            np.fill_diagonal(dist, 0.0)
            sums = np.stack([dist[:, labels == c].sum(axis=1) for c in names], axis=1)
            own = np.searchsorted(names, labels)
            at = np.arange(len(x))
            inner = sums[at, own] / np.maximum(sizes[own] - 1, 1)
            means = sums / sizes
            means[at, own] = np.inf
            outer = means.min(axis=1)
            widest = np.maximum(outer, inner)
            s = np.where((sizes[own] > 1) & (widest > 0), (outer - inner) / np.where(widest > 0, widest, 1.0), 0.0)
            value = float(s.mean())
        return pd.DataFrame({"match_id": [pdf["match_id"].iloc[0]], "n": [len(pdf)], "score": [value], "status": ["ok"]})

    return rows.select("match_id", "cluster", column).groupBy("match_id").applyInPandas(score, "match_id string, n bigint, score double, status string")


def fit_decisions(fits: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Fit status after every clip of a match, from its score.

    A poor first fit is used but done again on the next clip with both samples; that
    second fit is committed whatever its score.
    """
    counted = {"clip_no": running_sum(F.lit(1).cast("long")), "_first": previous(F.col("score"))}
    seen = scan(fits, ["match_id"], bucket, order, counted).withColumn("clip_no", (F.col("clip_no") - F.lit(1)).cast("long"))
    good = F.col("score") >= SILHOUETTE_MIN
    poor_before = F.coalesce(F.col("_first") < SILHOUETTE_MIN, F.lit(False))
    decision = (
        F.when(F.col("clip_no") == 0, F.when(good, "fit").otherwise("refit"))
        .when((F.col("clip_no") == 1) & poor_before, F.when(good, "refit_ok").otherwise("refit_forced"))
        .otherwise("kept")
    )
    status = F.when(decision == "refit", "refit").otherwise("ok")
    return seen.withColumns({"decision": decision, "fit_status": status}).drop("_first")


def principal_components(features: DataFrame, key: list[str], k: int = 2, column: str = "features") -> tuple[DataFrame, list[float]]:
    """Rows projected on ``k`` components, and the variance each explains."""
    # the fit reads its rows several times, the projection once more
    rows = durable(features, "features").withColumn("_vec", array_to_vector(F.col(column).cast("array<double>")))
    model = PCA(k=k, inputCol="_vec", outputCol="components").fit(rows)
    return model.transform(rows).select(*key, "components"), list(model.explainedVariance)
