"""Fits of every match at once: two clusters by grouped rounds, principal components from mergeable moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import durable

#: groups that the rows of a match are dealt over
SALTS = 32
MAX_ROUNDS = 300
#: groups of moments merged in one step
FAN_IN = 256


def _sum_of(a: Column, b: Column, of) -> Column:
    return F.aggregate(F.zip_with(a, b, of), F.lit(0.0), lambda s, x: s + x)


def gap(a: Column, b: Column) -> Column:
    """Squared distance of two vectors."""
    return _sum_of(a, b, lambda x, y: (x - y) * (x - y))


def _means(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Mean of ``x`` by ``keys``: one sum per dimension, so a group shrinks to one row per task before it is shuffled."""
    return rows.groupBy(*keys).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"))


def _with(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Join one row per match to rows dealt by (match_id, _salt)."""
    served = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(served, ["match_id", "_salt"])


def match_clusters(features: DataFrame, row: str, column: str = "embedding", rounds: int = MAX_ROUNDS) -> DataFrame:
    """Two clusters of the vectors of every match: match_id, ``row``, cluster.

    Centres start at the vector farthest from the match's mean and at the one farthest from that, ties to the smaller
    ``row``; then all matches take rounds together, each until its members stay as they are. Vectors of one match have one length;
    a match of equal vectors has cluster 0 alone. The rows of a match are dealt over ``SALTS`` groups, and only sums and
    centres, two per match, are gathered.
    """
    x = F.col(column).cast("array<double>")
    rows = features.select("match_id", row, x.alias("x"), F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int").alias("_salt"))
    rows = durable(rows.repartition("match_id", "_salt"), "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    start = _means(rows, ["match_id"], width)
    for name, origin in (("c0", "mean"), ("c1", "c0")):
        far = _with(rows, start).groupBy("match_id").agg(F.max_by("x", F.struct(gap(F.col("x"), F.col(origin)), -F.col(row))).alias("far"))
        start = durable(start.join(far.withColumnRenamed("far", name), "match_id"), "start")
    centres = start.select("match_id", F.array("c0", "c1").alias("centres"), F.lit("").alias("members"))
    done = None
    for _ in range(rounds):
        own = F.when(gap(F.col("x"), F.col("centres")[1]) < gap(F.col("x"), F.col("centres")[0]), 1).otherwise(0)
        placed = _with(rows, centres).withColumn("cluster", own)
        sums = placed.groupBy("match_id", "cluster").agg(
            F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"), F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("sign")
        )
        # a cluster that lost all its members keeps its centre
        found = sums.groupBy("match_id").agg(
            F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"),
            F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws(":", "cluster", "n", "sign")))).alias("now"),
        )
        moved = [F.coalesce(F.try_element_at("means", F.lit(c)), F.col("centres")[c]) for c in (0, 1)]
        step = centres.join(found, "match_id").select("match_id", F.array(*moved).alias("centres"), F.col("now").alias("members"), (F.col("now") == F.col("members")).alias("_still"))
        step = durable(step, "centres")
        still = step.where("_still").select("match_id", "centres")
        done = still if done is None else done.unionByName(still)
        centres = step.where("NOT _still").drop("_still")
        if centres.isEmpty():
            break
    final = done.unionByName(centres.select("match_id", "centres"))
    own = F.when(gap(F.col("x"), F.col("centres")[1]) < gap(F.col("x"), F.col("centres")[0]), 1).otherwise(0)
    return _with(rows, final).select("match_id", row, own.alias("cluster"))


MOMENTS = "n bigint, total array<double>, products array<double>"


def _merged(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    return int(pdf["n"].sum()), np.sum(np.stack(pdf["total"].to_list()), axis=0), np.sum(np.stack(pdf["products"].to_list()), axis=0)


def moments(features: DataFrame, bucket: Column, column: str = "features") -> DataFrame:
    """Number, sum and products of the vectors of every match, merged from groups of one bucket: match_id and ``MOMENTS``."""

    def gathered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_list()).astype(float)
        return pd.DataFrame({"match_id": [key[0]], "_part": [key[1]], "n": [len(x)], "total": [x.sum(axis=0).tolist()], "products": [(x.T @ x).ravel().tolist()]})

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, total, products = _merged(pdf)
        return pd.DataFrame({"match_id": [key[0]], "_part": [key[1]], "n": [n], "total": [total.tolist()], "products": [products.tolist()]})

    schema = f"match_id string, _part bigint, {MOMENTS}"
    parts = features.select("match_id", F.col(column).alias("x"), bucket.cast("long").alias("_part")).groupBy("match_id", "_part").applyInPandas(gathered, schema)
    some = parts.withColumn("_part", F.floor(F.col("_part") / FAN_IN)).groupBy("match_id", "_part").applyInPandas(merged, schema)
    return some.withColumn("_part", F.lit(0).cast("long")).groupBy("match_id", "_part").applyInPandas(merged, schema).drop("_part")


AXES = "n bigint, mean array<double>, axes array<array<double>>, variances array<double>, total_variance double"


def match_components(found: DataFrame, k: int = 2) -> DataFrame:
    """First ``k`` principal axes of every match from its ``moments``: match_id and ``AXES``.

    Each axis points so that its largest entry, the first of equal ones, is positive. With fewer than two rows all variances are 0.
    """

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total, products = _merged(pdf)
        d = len(total)
        mean = total / n
        spread = (products.reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
        values, vectors = np.linalg.eigh((spread + spread.T) / 2)
        top = np.argsort(values)[::-1][:k]
        axes = vectors[:, top].T
        axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame({"match_id": [pdf["match_id"].iloc[0]], "n": [n], "mean": [mean.tolist()], "axes": [axes.tolist()], "variances": [np.maximum(values[top], 0.0).tolist()], "total_variance": [float(np.trace(spread))]})

    return found.groupBy("match_id").applyInPandas(solved, f"match_id string, {AXES}")


def project(features: DataFrame, key: list[str], axes: DataFrame, column: str = "features") -> DataFrame:
    """Rows of every match on its own axes: ``key`` and ``components``."""
    salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    rows = _with(features.withColumn("_salt", salt), axes.select("match_id", "mean", "axes"))
    centred = F.zip_with(F.col(column), "mean", lambda x, m: x - m)
    return rows.select(*key, F.transform("axes", lambda a: _sum_of(centred, a, lambda x, y: x * y)).alias("components"))
