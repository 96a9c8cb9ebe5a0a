"""Centroid clustering of integer vectors by exact distances, with a LAESA pivot table.

``PIVOTS`` fixed vectors are pivots. The distance of every vector to every pivot
is computed once and stored beside the vector. In each round the driver
computes the distances of the few centroids to the pivots; by the triangle
inequality the largest difference of a vector's and a centroid's pivot
distances is a lower bound of their distance. Centroids are tried by rising
bound, and only those whose bound does not exceed the best distance so far get
an exact integer distance. Bounds are floating point with a margin far above
their rounding, so no centroid that could win or tie is left out.

Scale: vectors never move. A round is one scan of the staged table; a task
returns sums and counts per centroid and component, Spark adds them up, and the
driver reads clusters * dimensions numbers. Sums are exact decimals and divided
as Python integers, so the result does not depend on order or partitions.

Defined results: vectors of another length, null vectors and vectors with a null
or non-finite component are left out. Repeated rows count and return each on
their own. Starts are ordered by hash, rows of one id by their components; a
null id hashes as the empty string. With fewer vectors than clusters every
vector starts one; without vectors there are no rows. A component beyond
``LARGEST`` / scale fails the job, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import small_table
from scribemill.session import stage

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
PIVOTS = 16
# Components are below this, so that 64 squared differences stay below 2^62.
LARGEST = 1 << 27
# Bounds count as lower by this share of the distances they come from.
MARGIN = 1e-9


def integer_components(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component; null unless there are ``dimensions`` finite ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    too_large = F.exists(scaled, lambda x: F.abs(x) >= LARGEST)
    whole = F.when(too_large, F.raise_error(F.lit("a vector component is too large for exact distances")).cast("array<int>")).otherwise(
        F.transform(scaled, lambda x: F.floor(x).cast("int"))
    )
    return F.when((F.size(vector) == dimensions) & finite, whole)


def _matrix(column: pa.ListArray, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, centroid_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of every row, and the number of exact distances computed. Ties go to the smaller number."""
    bounds = np.zeros((len(vectors), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bounds, np.abs(table[:, p, None] - centroid_table[None, :, p]), out=bounds)
    bounds -= MARGIN * (1.0 + table.max(axis=1, initial=0.0)[:, None] + centroid_table.max(initial=0.0))
    order = np.argsort(bounds, axis=1, kind="stable")
    cluster = order[:, 0]
    best = squared(vectors, centroids[cluster])
    computed = len(vectors)
    for rank in range(1, len(centroids)):
        other = order[:, rank]
        alive = np.flatnonzero(np.take_along_axis(bounds, other[:, None], axis=1)[:, 0] <= np.sqrt(best.astype(np.float64)))
        found, number = squared(vectors[alive], centroids[other[alive]]), other[alive]
        computed += len(alive)
        better = (found < best[alive]) | ((found == best[alive]) & (number < cluster[alive]))
        best[alive[better]], cluster[alive[better]] = found[better], number[better]
    return cluster, best, computed


def with_pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` (id, x) with the distances to the pivots as ``to_pivots``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pivot_distances(_matrix(batch.column(1), pivots.shape[1], np.int64), pivots)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(pivots), pa.int32())
            stored = pa.ListArray.from_arrays(ends, pa.array(rows.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stored], names=["id", "x", "to_pivots"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(add, f"id {kind}, x array<int>, to_pivots array<double>")


def _assigner(centroids: np.ndarray, pivots: np.ndarray):
    centroid_table = pivot_distances(centroids, pivots)

    def assign(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = _matrix(batch.column(at), centroids.shape[1], np.int64)
        cluster, distance, _ = nearest(vectors, _matrix(batch.column(at + 1), len(pivots), np.float64), centroids, centroid_table)
        return vectors, cluster, distance

    return assign


def moved_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: assign every vector and take the floor of the mean; empty clusters stay."""
    assign, shape = _assigner(centroids, pivots), centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, dtype=np.int64), np.zeros(shape[0], dtype=np.int64)
        for batch in batches:
            vectors, cluster, _ = assign(batch, 0)
            for c in np.unique(cluster):
                own = vectors[cluster == c]
                total[c] += own.sum(axis=0)
                count[c] += len(own)
        cells = [np.repeat(np.arange(shape[0]), shape[1]), np.tile(np.arange(shape[1]), shape[0]), total.ravel(), np.repeat(count, shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["cluster", "place", "total", "n"])

    cells = table.select("x", "to_pivots").mapInArrow(sums, "cluster long, place long, total long, n long")
    added = cells.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for row in added.where("n > 0").collect():
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return out


def cluster_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> DataFrame:
    """One row per kept vector: its id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_column).alias("id"), integer_components(F.col(vector), dimensions, scale).alias("x")).where("x is not null")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # As many rows as there are clusters and pivots, both arguments.
    first = [row["x"] for row in whole.orderBy(rank, "x").limit(max(clusters, pivots)).collect()]
    start = np.array(first, dtype=np.int64).reshape(-1, dimensions)
    fixed, centroids = start[:pivots], start[:clusters]
    schema = f"id {whole.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if len(centroids):
        table = stage(with_pivot_table(whole, fixed), "pivot_table")
        for _ in range(rounds):
            centroids = moved_centroids(table, centroids, fixed)
        assign = _assigner(centroids, fixed)

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, cluster, distance = assign(batch, 1)
                columns = [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

        labelled = stage(table.mapInArrow(label, schema), "clusters")
    else:
        labelled = spark.createDataFrame([], schema)
    sums = {row["cluster"]: int(row["total"]) for row in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, total, sum(sums.values()), digests[c]) for c, total in sorted(sums.items())]
    totals = F.broadcast(small_table(spark, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return labelled.join(totals, "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
