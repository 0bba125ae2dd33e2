"""Centroid clustering with a LAESA pivot table.

Vectors become fixed-point integers. The first centroids are a repeatable draw of vectors; some of
them, far from each other, are the pivots. The distance of every vector to every pivot is written
once. In a round the driver knows how far each centroid is from each pivot, so that the triangle
inequality bounds a vector's distance to each centroid from below without touching the vector:
|d(vector, pivot) - d(centroid, pivot)| for the worst pivot. Centroids are tried in the order of
that bound, and those whose bound exceeds the best distance found so far are never measured. The
others receive exact integer distances, so clusters equal those of a full comparison.

A round is one pass over the written table without a shuffle of vectors: each task sends one row of
component sums per centroid. The driver holds ``k * dims`` integers, whatever the table holds.

Defined results: vectors with another number of components, with a null or a component that isn't
finite give no row; components beyond ``LIMIT`` after scaling count as ``LIMIT``, which keeps every
distance within 64 bits, and inertias stop at the greatest 64-bit integer; a null id is drawn last;
repeated rows and ids are vectors of their own; fewer vectors than ``k`` give as many centroids as
there are vectors; a centroid that loses all its vectors stays where it is; an empty table gives an
empty table; all input columns of any name stay, apart from the vector and those that a result
column of the same name replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylink.functions.frames import metadata_frame
from keylink.llm import textarrays as ta
from keylink.sources.workspace import Workspace

LIMIT = 1 << 27
_LARGEST = (1 << 63) - 1
# Entries of a block of lower bounds, which is what a task holds beside its batch.
_BLOCK = 1 << 21


def fixed_point(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    apart = left - right
    return np.einsum("ij,ij->i", apart, apart)


def _to_each(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances (not squared) of all rows of ``x`` to all ``points``."""
    if not len(points):
        return np.zeros((len(x), 0))
    return np.sqrt(np.stack([_squares(x, p[None, :]) for p in points], axis=1).astype(np.float64))


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``points``, each the one with the greatest sum of distances to those before."""
    total, chosen = np.zeros(len(points)), []
    for _ in range(min(n, len(points))):
        total[chosen] = -1.0
        chosen.append(int(total.argmax()))
        total += _to_each(points, points[chosen[-1:]])[:, 0]
    return points[chosen]


def nearest(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, reach: np.ndarray):
    """Number of the nearest centroid, squared distance, and how many distances were measured.

    ``far`` and ``reach`` are the distances of the vectors and of the centroids to the pivots.
    """
    low = np.zeros((len(x), len(centroids)))
    for j in range(far.shape[1]):
        np.maximum(low, np.abs(far[:, j, None] - reach[None, :, j]), out=low)
    # Room for the rounding of roots: a bound may be too low, never too high.
    low -= 1e-9 * (max(far.max(initial=0.0), reach.max(initial=0.0)) + 1.0)
    order = np.argsort(low, axis=1, kind="stable")
    cluster = order[:, 0].copy()
    best = _squares(x, centroids[cluster])
    measured = np.ones(len(x), dtype=np.int32)
    open_rows = np.arange(len(x))
    for step in range(1, len(centroids)):
        tried = order[open_rows, step]
        still = low[open_rows, tried] <= np.sqrt(best[open_rows].astype(np.float64)) * (1 + 1e-12)
        open_rows, tried = open_rows[still], tried[still]
        if not len(open_rows):
            break
        distance = _squares(x[open_rows], centroids[tried])
        measured[open_rows] += 1
        old = best[open_rows]
        better = (distance < old) | ((distance == old) & (tried < cluster[open_rows]))
        best[open_rows[better]] = distance[better]
        cluster[open_rows[better]] = tried[better]
    return cluster, best, measured


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten()).astype(dtype).reshape(len(column), width)


def _with_pivots(batches, pivots: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    dims = pivots.shape[1]
    for batch in batches:
        x = fixed_point(_matrix(batch.column(batch.num_columns - 1), dims, np.float64), scale)
        far = _to_each(x, pivots)
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        cols.append(ta.lists(x.astype(np.int32).ravel(), np.full(len(x), dims), pa.int32()))
        cols.append(ta.lists(far.ravel(), np.full(len(x), len(pivots)), pa.float64()))
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "_x", "_far"])


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, reach: np.ndarray):
    """Blocks (first row, vectors, cluster, distance, measured) of a batch that ends in _x, _far."""
    x = _matrix(batch.column(batch.num_columns - 2), centroids.shape[1], np.int64)
    far = _matrix(batch.column(batch.num_columns - 1), reach.shape[1], np.float64)
    rows = max(1, _BLOCK // len(centroids))
    for lo in range(0, len(x), rows):
        part = x[lo : lo + rows]
        yield part, *nearest(part, far[lo : lo + rows], centroids, reach)


def _sums(batches, centroids: np.ndarray, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per centroid and task: sums of components, then the number of vectors."""
    k, dims = centroids.shape
    total = np.zeros((k, dims + 1), dtype=np.int64)
    for batch in batches:
        for x, cluster, _, _ in _assigned(batch, centroids, reach):
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            if len(present):
                total[present, :dims] += np.add.reduceat(x[order], first, axis=0)
            total[:, dims] += np.bincount(cluster, minlength=k)
    used = np.flatnonzero(total[:, dims])
    sums = ta.lists(total[used].ravel(), np.full(len(used), dims + 1), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), sums], ["_cluster", "_sums"])


def _labels(batches, centroids: np.ndarray, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [found[1:] for found in _assigned(batch, centroids, reach)]
        cluster, distance, measured = (
            np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3)
        )
        cols = [batch.column(i) for i in range(batch.num_columns - 2)]
        cols += [
            pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()),
            pa.array(measured, pa.int32()),
        ]
        names = [*batch.schema.names[:-2], "cluster", "distance", "n_measured"]
        yield pa.RecordBatch.from_arrays(cols, names)


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round; exact sums, whichever way the table is cut into tasks."""
    run = partial(_sums, centroids=centroids, reach=_to_each(centroids, pivots))
    sums = (
        table.select("_x", "_far").mapInArrow(run, "_cluster int, _sums array<long>")
        .select("_cluster", F.posexplode("_sums").alias("_at", "_part"))
        .groupBy("_cluster", "_at")
        .agg(F.sum(F.col("_part").cast("decimal(20,0)")).alias("_sum"))
        .collect()
    )
    dims = centroids.shape[1]
    total = {(row["_cluster"], row["_at"]): int(row["_sum"]) for row in sums}
    moved = centroids.copy()
    for c in {cluster for cluster, _ in total}:
        moved[c] = [total[c, at] // total[c, dims] for at in range(dims)]
    return moved


def _usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    n_pivots: int = 8,
    id_column: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
    space: Workspace | None = None,
) -> DataFrame:
    """Every usable vector with its cluster, squared distance, inertias and its centroid's hash.

    ``n_measured`` is the number of centroids whose exact distance was taken in the last pass.
    """
    out = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_measured")
    own = [c for c in vectors.columns if c != vector and c not in out]
    space = space or Workspace(vectors.sparkSession)
    # the columns travel under numbers, so that no name of theirs can clash with a name used here
    plain = vectors.filter(_usable(F.col(f"`{vector}`"), dims)).select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.col(f"`{vector}`").cast("array<double>").alias("_v"),
    )
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")), 256)
    drawn = (
        vectors.select(key.alias("_key"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
        .filter(_usable(F.col("_v"), dims)).orderBy(F.asc_nulls_last("_key"), "_v").limit(k).collect()
    )
    centroids = fixed_point(np.array([row["_v"] for row in drawn]).reshape(len(drawn), dims), scale)
    pivots = choose_pivots(centroids, n_pivots)
    ahead = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    table = plain.mapInArrow(
        partial(_with_pivots, pivots=pivots, scale=scale), f"{ahead}_x array<int>, _far array<double>"
    )
    if len(drawn):
        table = space.save(table, "pivots")
        for _ in range(rounds):
            centroids = _moved(table, centroids, pivots)
    run = partial(_labels, centroids=centroids, reach=_to_each(centroids, pivots))
    labelled = space.save(
        table.mapInArrow(run, f"{ahead}cluster int, distance long, n_measured int"), "clusters"
    )
    space.drop(table)
    total = F.sum(F.col("distance").cast("decimal(20,0)")).alias("_sum")
    inertia = {row["cluster"]: int(row["_sum"]) for row in labelled.groupBy("cluster").agg(total).collect()}
    whole = min(sum(inertia.values()), _LARGEST)
    facts = metadata_frame(
        vectors.sparkSession,
        [
            (c, min(inertia[c], _LARGEST), whole,
             hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c in sorted(inertia)
        ],
        "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row per centroid, so this side stays small however many vectors there are
    joined = labelled.join(F.broadcast(facts), F.col("cluster") == F.col("_cluster"))
    return joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *out)
