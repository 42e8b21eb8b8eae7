"""Centroid clustering against plain Python integers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidewheel.llm import centroids as ce


def brute(rows, clusters=8, rounds=10):
    kept = [(i, [max(-ce.LARGEST, min(ce.LARGEST, math.floor(1024 * float(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((square(v, x), k) for k, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else old for k, old in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {k: sum(d for _, q, d in found if q == k) for k in range(len(c))}
    return sorted(((i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in found), key=str)


def clusters_of(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 7, 1) for r in rows], "vec_id long, embedding array<float>, cluster int, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ce.op12_centroid_clusters(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def f32(values):
    return [float(x) for x in np.asarray(values, np.float32)]


def test_query_equals_plain_integers_with_odd_vectors_and_ties(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, f32(rng.normal(i % 5, 1, 64))) for i in range(90)]
    rows += [(200 + i, f32(np.full(64, 0.5))) for i in range(30)] + [(300 + i, f32(np.round(rng.normal(0, 2, 64)))) for i in range(30)]
    bad = f32(rng.normal(0, 1, 64))
    rows += [(400, None), (401, []), (402, bad[:63]), (403, [*bad, 1.0]), (404, [None, *bad[1:]]), (405, [float("nan"), *bad[1:]]), (406, [float("-inf"), *bad[1:]])]
    rows += [(None, f32(rng.normal(0, 1, 64))), (7, f32(rng.normal(3, 1, 64))), (7, rows[7][1]), (500, f32(np.full(64, 3e38))), (501, f32(np.full(64, -0.0)))]
    assert clusters_of(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 3])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    rows = [(i, f32(np.full(64, i * 0.25))) for i in range(n)]
    assert clusters_of(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("size", [3, 40, 3000, 2**20, 2**26])
def test_screening_never_loses_the_nearest_even_where_float32_cannot_tell(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size + 1, (12, 64))
    c[3], c[5] = c[1], c[2] + (np.arange(64) == 9)  # one repeated, one a single step away
    x = np.concatenate([c, c + rng.integers(-1, 2, c.shape), rng.integers(-size, size + 1, (200, 64)), (c[:6] + c[6:]) // 2])
    found, distance, left = ce.nearest(x, c)
    square = ((x[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert found.tolist() == [min(range(12), key=lambda k: (row[k], k)) for row in square]
    assert distance.tolist() == square.min(axis=1).tolist()
    assert 0 < left < len(x) or size <= 3


def test_sql_of_the_query_follows_negative_means():
    con = duckdb.connect()
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.normal(-1, 1, 64))) for i in range(60)]
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", rows)
    got = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({ce.ORACLE_OP12})").fetchall()
    assert sorted(got, key=str) == brute(rows)
