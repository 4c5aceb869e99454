"""Centroid clustering of integer vectors, with PCA-rotated filtering of the centroids.

Once: vectors become integers, their mean and covariance are summed over all of them, and a written table
keeps, for each vector, its integers, its LEAD leading coordinates in the axes of the covariance, and the norm
of all other coordinates (the residual norm). For a vector x and a centroid c the squared distance of
the leading coordinates plus the squared difference of the residual norms is at most |x - c|^2, since
two vectors of norms r and s are at least |r - s| apart.

Each round: a task takes a batch of the table and all centroids. The centroid of least bound is compared
first, in integers; every other centroid whose bound is not above that distance survives and is compared in
integers as well. Bounds are lowered by a margin for rounding, so the result is that of comparing all.
Tasks return one sum per cluster and component, so a round shuffles no vectors, however many of them are in
one cluster, and only the k x d sums of the centroids and the d x d sums of the covariance reach the driver.

Defined cases: vectors that are null, that have another number of components, or null or non-finite
components, are left out, as are those with a component beyond 2 ** RANGE_BITS after scaling (its squared
distances would not fit a long). Repeated rows are vectors of their own, also as first centroids; a null id is
drawn as an empty one; equal draws go by the vectors' components. With fewer than k vectors each is a
centroid. An empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.base import written

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
RANGE_BITS = 27
# Leading coordinates that the filter compares.
LEAD = 24
# Bounds are lowered by this share of the squared lengths, far more than double rounding adds.
MARGIN = 1e-9
# Vectors compared at a time.
BLOCK = 4_096


@dataclass
class Rotation:
    """Mean and principal axes, the axis of the greatest variance first."""

    mean: np.ndarray
    axes: np.ndarray
    lead: int

    def apply(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms. The residual is summed, not subtracted, so it keeps its digits."""
        turned = (vectors - self.mean) @ self.axes
        return turned[:, : self.lead], np.sqrt(np.square(turned[:, self.lead :]).sum(axis=1))


def integer_vectors(frame: DataFrame, vec_id: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors of exactly ``dims`` finite components; x holds floor(scale * component)."""
    scaled = F.transform(F.col("v"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) <= F.lit(float(2**RANGE_BITS // scale)), F.lit(False)) & ~F.isnan(c.cast("double")))
    kept = frame.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where((F.size("v") == dims) & fine)
    return kept.select("vec_id", scaled.cast("array<int>").alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


def rotation_of(vectors: DataFrame, lead: int = LEAD) -> Rotation | None:
    """Principal axes of all vectors, from sums that the tasks fold: count, components and their products."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x = _matrix(frame["x"]).astype(np.float64)
                one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = one.T @ one + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rows = vectors.select("x").mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if not len(rows):
        return None
    size = int(rows["i"].max()) + 1
    total = np.zeros((size, size))
    total[rows["i"], rows["j"]] = rows["s"]
    mean = total[0, 1:] / total[0, 0]
    _, axes = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), min(lead, size - 1))


def rotated(vectors: DataFrame, rotation: Rotation) -> DataFrame:
    """``vectors`` with (lead, residual), as a written table."""

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                lead, residual = rotation.apply(_matrix(frame["x"]).astype(np.float64))
                yield frame.assign(lead=list(lead), residual=residual)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return written(vectors.mapInPandas(turn, f"vec_id {kind}, x array<int>, lead array<double>, residual double"))


def nearest(x: np.ndarray, lead: np.ndarray, residual: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many pairs were compared in integers."""
    c_lead, c_residual = rotation.apply(centroids.astype(np.float64))
    gap = lead[:, None, :] - c_lead[None, :, :]
    bound = np.square(gap).sum(axis=2) + np.square(residual[:, None] - c_residual[None, :])
    size = np.square(lead).sum(axis=1)[:, None] + np.square(residual)[:, None] + (np.square(c_lead).sum(axis=1) + np.square(c_residual))[None, :]
    bound -= MARGIN * size + MARGIN
    guess = bound.argmin(axis=1)
    best = np.square(x - centroids[guess]).sum(axis=1)
    row, other = np.nonzero((bound <= best[:, None]) & (np.arange(len(centroids))[None, :] != guess[:, None]))
    exact = np.square(x[row] - centroids[other]).sum(axis=1)
    cluster = guess.copy()
    # By vector, distance, number: the first pair of each vector is its best among the survivors.
    order = np.lexsort((other, exact, row))
    row, other, exact = row[order], other[order], exact[order]
    head = np.flatnonzero(np.diff(row, prepend=-1))
    at, number, distance = row[head], other[head], exact[head]
    better = (distance < best[at]) | ((distance == best[at]) & (number < guess[at]))
    cluster[at[better]], best[at[better]] = number[better], distance[better]
    return cluster, best, len(x) + len(row)


def _assigner(centroids: np.ndarray, rotation: Rotation) -> Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]]:
    def assign(frame: pd.DataFrame):
        for at in range(0, len(frame), BLOCK):
            part = frame.iloc[at : at + BLOCK]
            x = _matrix(part["x"]).astype(np.int64)
            cluster, distance, _ = nearest(x, _matrix(part["lead"]), part["residual"].to_numpy(), centroids, rotation)
            yield part, x, cluster, distance

    return assign


def moved(table: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors; empty ones stay."""
    assign, k = _assigner(centroids, rotation), len(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, 1 + centroids.shape[1]), np.int64)
        for frame in frames:
            for _, x, cluster, _ in assign(frame):
                for c in np.unique(cluster):
                    own = x[cluster == c]
                    total[c, 0] += len(own)
                    total[c, 1:] += own.sum(axis=0)
        c, j = np.indices(total.shape)
        some = total[c, 0] > 0
        yield pd.DataFrame({"c": c[some], "j": j[some], "s": total[some]})

    rows = table.select("x", "lead", "residual").mapInPandas(sums, "c int, j int, s long").groupBy("c", "j").agg(F.sum("s").alias("s")).collect()
    found = {(r["c"], r["j"]): r["s"] for r in rows}
    after = centroids.copy()
    for c in {c for c, _ in found}:
        # Python's integers: floor division, also of negative sums.
        after[c] = [found[c, j + 1] // found[c, 0] for j in range(centroids.shape[1])]
    return after


def centroid_clusters(frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector as a written table, and the final centroids."""
    vectors = integer_vectors(frame, vec_id, vector, dims, scale)
    rotation = rotation_of(vectors, lead)
    if rotation is None:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    table = rotated(vectors, rotation)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = table.select("x", draw.alias("draw")).orderBy("draw", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(table, centroids, rotation)
    assign, kind = _assigner(centroids, rotation), table.schema["vec_id"].dataType.simpleString()

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _, cluster, distance in assign(frame):
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cluster": cluster, "distance": distance})

    return written(table.mapInPandas(label, f"vec_id {kind}, cluster int, distance long")), centroids


def cluster_report(frame: DataFrame) -> DataFrame:
    """The contract's columns: a vector's cluster and distance, both inertias, the digest of its centroid."""
    labels, centroids = centroid_clusters(frame)
    spark = frame.sparkSession
    # Sums of 128 bits; only a sum beyond a long gives null.
    by_cluster = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = by_cluster.agg(F.sum("s").try_cast("long")).scalar()
    texts = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    digest = F.element_at(F.create_map(*[F.lit(v) for i, t in texts for v in (i, t)]), F.col("cluster")) if texts else F.lit("")
    # One row a cluster, k rows at most.
    sums = by_cluster.select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.sha2(digest, 256).alias("centroid_sha256"))
    return labels.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
