"""Centroid clustering over whole numbers, with a distance matrix that is updated, not recomputed.

Each vector's dot products with all centroids are stored with it, exactly. When centroids have
moved, a vector's products change by what the moved components contribute and nothing else; the
nearest centroid follows from them and the centroids' own squares. Tables of the rounds hold the
vector, its square and its products; centroids (few) go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpair.llm.tables import column, drop_written, written

SCALE = 64
MAX_CENTROIDS = 1_024  # all of them travel to every task
_LIMIT = 1 << 62  # sums of products stay below; what does not is an error, never a wrong number

_STATE = "id bigint, x array<bigint>, square bigint, dots array<bigint>"


def whole_vectors(vectors: DataFrame, dim: int = 64, scale: int = SCALE, id_col: str = "vec_id", value_col: str = "embedding") -> DataFrame:
    """`id, x`: the vectors of exactly `dim` components, none null or non-finite, each component
    the floor of `scale` times it (as a double). A component beyond 62 bits is an error."""
    rows = vectors.select(column(id_col).cast("bigint").alias("id"), column(value_col).cast("array<double>").alias("v"))
    infinite = float("inf")
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    rows = rows.filter((F.size("v") == dim) & F.coalesce(usable, F.lit(False)))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The k vectors of smallest SHA-256 of `seed:id` in hexadecimal, in that order (fewer if there
    are fewer). Rows of one id are ordered by their components; a null id counts as empty."""
    if not 1 <= k <= MAX_CENTROIDS:
        raise ValueError(f"the number of centroids lies in 1..{MAX_CENTROIDS}, got {k}")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    picked = vectors.select("x", F.sha2(name, 256).alias("h")).orderBy("h", "x").limit(k)
    return np.array([r["x"] for r in picked.select("x").collect()], np.int64)


def _numbers(array: pa.Array, width: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _checked(x: np.ndarray, centroids: np.ndarray) -> None:
    """Products and squared distances of these numbers fit 63 bits."""
    largest = [max(int(a.max()), -int(a.min())) if a.size else 0 for a in (x, centroids)]
    if x.shape[1] * sum(largest) ** 2 >= _LIMIT:
        raise OverflowError(f"components up to {max(largest)}: their squared distances do not fit 63 bits")


def started(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`id, x, square, dots`: the vectors with their squares and products with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column("x"), centroids.shape[1])
            _checked(x, centroids)
            columns = [batch.column("id"), batch.column("x"), pa.array((x * x).sum(axis=1)), _lists(x @ centroids.T)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "square", "dots"])

    return vectors.mapInArrow(run, _STATE)


def moved(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids moved: products change by the moved components only."""
    steps = [(k, np.flatnonzero(new[k] != old[k])) for k in range(len(old))]
    steps = [(k, at, new[k, at] - old[k, at]) for k, at in steps if len(at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dots = _numbers(batch.column("x"), new.shape[1]), _numbers(batch.column("dots"), len(new)).copy()
            _checked(x, new)
            for k, at, by in steps:
                dots[:, k] += x[:, at] @ by
            yield batch.set_column(batch.schema.get_field_index("dots"), "dots", _lists(dots))

    return state.mapInArrow(run, _STATE)


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
    dots = _numbers(batch.column("dots"), len(centroids))
    far = batch.column("square").to_numpy()[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(best)), best]


def cluster_sums(state: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its size and componentwise sum, exactly; a row per cluster and batch is
    shuffled, and one per cluster comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _ = _nearest(batch, centroids)
            x = _numbers(batch.column("x"), centroids.shape[1])
            found = np.unique(best)
            # sums of a batch fit: components are below 2**31 (checked), rows of a batch too
            sums = np.array([x[best == k].sum(axis=0) for k in found], np.int64).reshape(-1, x.shape[1])
            counts = np.bincount(best, minlength=len(centroids))[found]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts.astype(np.int64)), _lists(sums)], ["cluster", "n", "sums"])

    parts = state.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(centroids.shape[1])]) for r in rows}


def next_centroids(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Floors of the clusters' means; an empty cluster keeps its centroid."""
    out = centroids.copy()
    for k, (n, total) in sums.items():
        out[k] = [s // n for s in total]
    return out


def assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`id, cluster, distance` (squared) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = _nearest(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return state.mapInArrow(run, "id bigint, cluster int, distance bigint")


def centroid_clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = SCALE, seed: str = "1", id_col: str = "vec_id", value_col: str = "embedding"
) -> DataFrame:
    """`id, cluster, distance, cluster_inertia, inertia, centroid_sha256` of each usable vector.

    `rounds` times the vectors go to their nearest centroid (ties: the smaller number) and
    non-empty centroids become the floors of their vectors' means; then the vectors are assigned
    once more. Vectors of another length, or with a null or non-finite component, are left out;
    null and repeated ids are kept, a row each. No usable vector, no row. A round reads and
    writes the table once; the table of the round before is deleted. Sums are taken within
    batches first, so frequent vectors cost nothing more.
    """
    spark = vectors.sparkSession
    x = whole_vectors(vectors, dim, scale, id_col, value_col)
    centroids = first_centroids(x, k, seed)
    if not len(centroids):
        empty = "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    state = written(started(x, centroids), "distances")
    for _ in range(rounds):
        later = next_centroids(centroids, cluster_sums(state, centroids))
        if (later == centroids).all():
            break
        before, state = state, written(moved(state, centroids, later), "distances")
        drop_written(before)
        centroids = later
    found = written(assigned(state, centroids), "clusters")
    drop_written(state)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = F.array(*[F.struct(F.lit(inertia.get(i, 0)).cast("bigint").alias("d"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    own = F.get(per_cluster, F.col("cluster"))
    return found.select(
        "id", "cluster", "distance", own["d"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), own["n"].alias("centroid_sha256")
    )
