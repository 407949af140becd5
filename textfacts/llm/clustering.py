"""Centroid clustering in whole numbers: plain Lloyd rounds.

Each round broadcasts the centroids, mapInPandas takes integer squared differences to each of them and the least, and
gives out a partition's counts and sums, which a groupBy merges. The centroids are few and of one dimension, so only
they pass through the driver. Sums of integers are the same in any order, so the result doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Scaled components beyond this have squared distances that 64 bits don't hold.
MOST = 1 << 27


def kept(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the scaled integer components, of the usable rows. Infinite components are beyond MOST as well."""
    v = embeddings.select(F.col("vec_id").cast("long"), F.transform(F.col("embedding").cast("array<double>"), lambda c: c * scale).alias("v"))
    usable = f"size(v) = {dimensions} and forall(v, c -> c is not null and not isnan(c) and c >= -{MOST} and c < {MOST})"
    return v.where(usable).select("vec_id", F.transform("v", lambda c: F.floor(c).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, n: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The n vectors whose ids have the least hashes, fewer if there aren't as many."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    found = rows.select(key.alias("h"), "x").orderBy("h", "x").limit(n).collect()
    return np.array([r["x"] for r in found], dtype=np.int64)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the lowest, and its squared distance."""
    squares = np.empty((len(x), len(centroids)), dtype=np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        squares[:, k] = np.einsum("ij,ij->i", d, d)
    near = squares.argmin(axis=1)
    return near, squares[np.arange(len(x)), near]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_list()).astype(np.int64).reshape(len(column), -1)


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds: floors of the means of what is nearest to each; one that is nearest to nothing stays."""
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value  # noqa: B023  run before the next round
            count, total = np.zeros(len(own), dtype=np.int64), np.zeros(own.shape, dtype=np.int64)
            for f in frames:
                if len(f):
                    x = _matrix(f["x"])
                    near, _ = assign(x, own)
                    count += np.bincount(near, minlength=len(own))
                    np.add.at(total, near, x)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "total": list(total[some])})

        parts = rows.select("x").mapInPandas(sums, "cluster int, n long, total array<long>")
        merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(centroids.shape[1])))
        moved = centroids.copy()
        for cluster, n, *total in merged.collect():
            moved[cluster] = [s // n for s in total]
        centroids = moved
    return centroids


def clusters(embeddings: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster and distance (squared) of each usable vector, cluster_inertia and inertia (distances summed over its cluster and over all), and centroid, its final centroid.

    Rows whose vector is null, of other dimensions, or holds null, NaN, infinite or larger components than MOST / scale are left out;
    null ids are hashed as `null`. Repeated rows are vectors each. Fewer vectors than n give as many centroids. No vectors give no rows.
    """
    spark = embeddings.sparkSession
    rows = stored(kept(embeddings, dimensions, scale))
    first = first_centroids(rows, n, seed)
    final = lloyd(rows, first, rounds) if len(first) else np.zeros((1, dimensions), dtype=np.int64)
    shared = spark.sparkContext.broadcast(final)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near, square = assign(_matrix(f["x"]), shared.value) if len(f) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "cluster": near.astype(np.int32), "distance": square.astype(np.int64)})

    placed = stored(rows.mapInPandas(nearest, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shown = [(k, int(sums[k]), int(sum(sums.values())), c.tolist()) for k, c in enumerate(final) if k in sums]
    about = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(placed: DataFrame) -> DataFrame:
    """The rows of clusters() with the sha256 of the centroid's components instead of them."""
    shown = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return placed.withColumn("centroid_sha256", shown).drop("centroid")
