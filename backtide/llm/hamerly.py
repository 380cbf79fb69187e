"""K-means over integer vectors with Hamerly's bounds, exact to the last tie.

Every vector keeps an upper bound of its distance to its centroid and a lower bound of that to the second-nearest one,
in blocks that are written to the shared folder after each round. When centroids move, the bounds are loosened by how
far. A vector whose upper bound lies below its lower one, or below half the way from its centroid to the next, stays
where it is; of the others the distance to their own centroid is found, and those that are still ambiguous get a full
scan in integers. Bounds are rounded outwards, so that floating point never decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash
from .vectors import blocks, matrix

_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_PART = "parts array<struct<cluster:int,members:long,spread:long,total:array<long>>>"
_STATE = f"dims int, data binary, ids array<long>, cluster binary, upper binary, lower binary, scanned long, {_PART}"


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a centroid (or to a row of their own each), in integers."""
    apart = x - centre
    return np.einsum("ij,ij->i", apart, apart)


def full_scan(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, of equal ones the first; its bound from above; the second's from below)."""
    all_ = np.stack([squared(x, c) for c in centres], 1)
    own = all_.argmin(1)
    best = all_[np.arange(len(x)), own]
    all_[np.arange(len(x)), own] = np.iinfo("i8").max
    second = np.sqrt(all_.min(1).astype("f8")) * _DOWN if len(centres) > 1 else np.full(len(x), np.inf)
    return own.astype("i4"), np.sqrt(best.astype("f8")) * _UP, second


def reassign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have moved from `before`, and how many rows had a full scan."""
    moved = np.sqrt(squared(centres, before).astype("f8")) * _UP
    furthest = np.array([np.delete(moved, i).max(initial=0) for i in range(len(centres))])
    apart = np.array([np.delete(squared(centres, c), i).min(initial=np.iinfo("i8").max) for i, c in enumerate(centres)])
    half = np.sqrt(apart.astype("f8")) / 2 * _DOWN if len(centres) > 1 else np.array([np.inf])
    own, upper = own.copy(), (upper + moved[own]) * _UP
    lower = lower - furthest[own] * _UP - np.where(np.isfinite(lower), np.abs(lower), 0) * 1e-12
    limit = np.maximum(lower, half[own])
    open_ = np.flatnonzero(~(upper < limit))
    upper[open_] = np.sqrt(squared(x[open_], centres[own[open_]]).astype("f8")) * _UP
    open_ = open_[~(upper[open_] < limit[open_])]
    own[open_], upper[open_], lower[open_] = full_scan(x[open_], centres)
    return own, upper, lower, len(open_)


def _round(state: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Each block with its vectors assigned anew and the sums over each of its clusters."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = matrix(row["data"], row["dims"])
                if before is None:
                    (own, upper, lower), scanned = full_scan(x, centres), len(x)
                else:
                    own, upper, lower, scanned = reassign(x, *[np.frombuffer(row[c], t) for c, t in (("cluster", "i4"), ("upper", "f8"), ("lower", "f8"))], centres, before)
                spread, parts = squared(x, centres[own]), []
                for c in np.unique(own):
                    here = own == c
                    parts.append({"cluster": int(c), "members": int(here.sum()), "spread": int(spread[here].sum()), "total": x[here].sum(0).tolist()})
                row |= {"cluster": own.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "scanned": scanned, "parts": parts}
                row.pop("block", None)
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([
        ("dims", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64()),
        ("parts", pa.list_(pa.struct([("cluster", pa.int32()), ("members", pa.int64()), ("spread", pa.int64()), ("total", pa.list_(pa.int64()))]))),
    ])
    return stash(state.mapInArrow(assign, _STATE), "kmeans")


def _clusters(state: DataFrame, dims: int) -> dict[int, tuple[int, int, list[int]]]:
    """Of every cluster that is not empty: members, summed distances, summed components. One row for each."""
    parts = state.select(F.explode("parts").alias("p")).select("p.*").groupBy("cluster")
    sums = parts.agg(F.sum("members").alias("n"), F.sum("spread").alias("spread"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
    return {r["cluster"]: (r["n"], r["spread"], r["total"]) for r in sums.collect()}


def cluster(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, factor: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """One row (key, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_scans) for each vector with
    exactly `dims` components, none of them null or not finite, as integers floor(factor * x).

    Centroids start as the `clusters` vectors with the smallest SHA-256 of "seed:key" (of equal keys the smaller vector
    first; null keys last). Each round assigns every vector to the nearest centroid (squared Euclidean distance; of
    equally near ones the smaller number) and replaces centroids by the floor of their vectors' mean; empty ones stay.
    Then vectors are assigned once more. Rows that repeat a key or a vector are vectors of their own and null keys are
    kept; other columns are left out. Fewer vectors than `clusters` make fewer centroids; without any there are no rows.
    The driver sees sums over each cluster only, clusters x dims numbers.
    """
    packed = blocks(vectors, key, vector, factor, dims=dims)
    state = stash(packed, "vectors")
    usable = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    starts = usable.orderBy(name.asc_nulls_last(), "vector").limit(clusters).collect()
    centres = np.floor(np.array([r["vector"] for r in starts], "f8").reshape(-1, dims) * factor).astype("i8")
    before = None
    for step in range(rounds + 1):
        if len(centres):
            after = _round(state, centres, before)
            drop_stash(state)
            state, sums = after, _clusters(after, dims)
        if len(centres) and step < rounds:
            before = centres
            centres = np.array([[t // sums[i][0] for t in sums[i][2]] if i in sums else old for i, old in enumerate(before.tolist())], "i8")
    if not len(centres):
        return state.select(F.explode("ids").alias(key)).select(
            key, *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["cluster"], "i4")
                far = squared(matrix(row["data"], row["dims"]), centres[own])
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own), pa.array(far)], names=[key, "cluster", "distance"])

    total = sum(x[1] for x in sums.values())
    about = [(i, sums[i][1], total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist()) if i in sums]
    known = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("dims", "data", "ids", "cluster").mapInArrow(rows, f"`{key}` long, cluster int, distance long")
    return found.join(F.broadcast(known), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
