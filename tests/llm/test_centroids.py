import hashlib
import math
import random

import numpy as np
from checks.compare import compare, database
from keylink.llm.centroids import LIMIT, choose_pivots, cluster_vectors, nearest
from keylink.llm import centroids as module

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, _x int, `a.b` string"


def brute(rows, k, rounds, dims, scale):
    """(id, cluster, distance) of usable rows, the final centroids' hashes and the inertias."""
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v):
            kept.append((vec_id, [max(-LIMIT, min(LIMIT, math.floor(float(np.float32(e)) * scale))) for e in v], v))
    key = lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "x"
    points = [r[1] for r in sorted(kept, key=lambda r: (key(r), r[2]))[:k]]

    def assign():
        return [
            min((sum((a - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(points))
            for _, x, _ in kept
        ]

    for _ in range(rounds):
        found = assign()
        for c in range(len(points)):
            own = [x for (_, x, _), (_, at) in zip(kept, found) if at == c]
            if own:
                points[c] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    shas = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    total = sum(d for d, _ in found)
    by = {c: sum(d for d, at in found if at == c) for c in range(len(points))}
    return sorted(
        (r[0] is not None, r[0] or 0, c, d, by[c], total, shas[c]) for r, (d, c) in zip(kept, found)
    )


def result(frame):
    return sorted(
        (r["vec_id"] is not None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"],
         r["inertia"], r["centroid_sha256"])
        for r in frame.collect()
    )


def rows(n=150, dims=5, seed=3):
    rng = random.Random(seed)
    clash = (1, "own", 9, "dot")
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        v = [e + rng.gauss(0, 0.05) for e in c]
        out.append((i, v if rng.random() < 0.9 else list(c), *clash))
    hot = (n, [0.5] * dims, *clash)
    out += [hot] * 60 + [(n + 1, [0.5] * dims, *clash)]
    out += [(None, [0.1] * dims, *clash), (None, [0.2] * dims, *clash)]
    out += [
        (900, None, *clash), (901, [], *clash), (902, [1.0] * (dims + 1), *clash),
        (903, [None] + [1.0] * (dims - 1), *clash), (904, [float("nan")] * dims, *clash),
        (905, [float("inf")] + [0.0] * (dims - 1), *clash),
    ]
    rng.shuffle(out)
    return out


def test_equals_full_comparison_with_awkward_rows(spark):
    data = rows()
    got = cluster_vectors(spark.createDataFrame(data, SCHEMA), k=6, dims=5, n_pivots=3)
    assert result(got) == brute(data, 6, 3, 5, 64)
    assert got.columns == ["vec_id", "label", "_x", "a.b", "cluster", "distance", "cluster_inertia",
                           "inertia", "centroid_sha256", "n_measured"]
    assert {(r["label"], r["_x"], r["a.b"]) for r in got.collect()} == {(1, 9, "dot")}


def test_pruning_leaves_out_centroids(spark):
    data = [r for r in rows(400)]
    got = cluster_vectors(spark.createDataFrame(data, SCHEMA), k=12, dims=5, n_pivots=4, scale=10_000)
    assert result(got) == brute(data, 12, 3, 5, 10_000)
    measured = [r["n_measured"] for r in got.collect()]
    assert sum(measured) < 0.6 * 12 * len(measured)


def test_few_and_no_vectors(spark):
    clash = (1, "own", 9, "dot")
    few = [(3, [0.0, 1.0], *clash), (4, [1.0, 0.0], *clash)]
    got = cluster_vectors(spark.createDataFrame(few, SCHEMA), k=16, dims=2)
    assert result(got) == brute(few, 16, 3, 2, 64)
    assert all(r["inertia"] == 0 for r in got.collect())
    none = cluster_vectors(spark.createDataFrame([], SCHEMA), dims=2)
    assert none.collect() == [] and none.schema["distance"].dataType.simpleString() == "bigint"
    bad = cluster_vectors(spark.createDataFrame([(1, [None, 1.0], *clash)], SCHEMA), dims=2)
    assert bad.collect() == []


def test_equal_vectors_take_the_smaller_number_and_empty_centroids_stay(spark):
    clash = (1, "own", 9, "dot")
    data = [(i, [0.25, 0.25], *clash) for i in range(40)]
    got = cluster_vectors(spark.createDataFrame(data, SCHEMA), k=3, dims=2)
    assert {r["cluster"] for r in got.collect()} == {0}
    assert result(got) == brute(data, 3, 3, 2, 64)


def test_huge_components_stop_at_the_limit(spark):
    clash = (1, "own", 9, "dot")
    data = [(i, [1e38 if i % 2 else -1e38, float(i)], *clash) for i in range(20)]
    got = cluster_vectors(spark.createDataFrame(data, SCHEMA), k=1, dims=2)
    assert result(got) == brute(data, 1, 3, 2, 64)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    for spread in (3, 1000, LIMIT):
        x = rng.integers(-spread, spread + 1, (300, 8))
        points = rng.integers(-spread, spread + 1, (20, 8))
        pivots = choose_pivots(points, 6)
        cluster, best, measured = nearest(x, module._to_each(x, pivots), points, module._to_each(points, pivots))
        full = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (best == full.min(axis=1)).all() and (cluster == full.argmin(axis=1)).all()
        assert measured.min() >= 1


def test_same_result_whatever_the_partitions(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    once = result(cluster_vectors(frame.coalesce(1), k=6, dims=5))
    assert once == result(cluster_vectors(frame.repartition(7), k=6, dims=5))


def test_query_equals_sql(spark, sample):
    same, count, note = compare(spark, database(sample), sample, "op11_laesa_clusters")
    assert same and count > 0, note
