"""Centroid clustering of integer vectors, exact at the price of float32.

A matrix product in float32 gives each squared distance with an interval that surely holds it: the product's rounding error is bounded by
gamma * |x| * |c|, whatever the order of its sums. Centroids whose intervals reach the least upper end are a row's shortlist. A shortlist of
one is the nearest centroid; others are recomputed in 64-bit integers, and equal distances go to the lowest number. A round is one pass over
the vectors, which sends a row of sums for each cluster and task; only the centroids themselves come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
#: A component x becomes floor(SCALE * x).
SCALE = 1024
SEED = "3:"
#: Components beyond this are cut to it, so that squared distances of 64 components fit 64 bits. It stands for |x| of 131,072.
LARGEST = 2**27
#: Cells of a matrix that a product makes, about; they bound the rows that a worker takes at once.
CELLS = 2**19
#: Half the distance from 1 to the next float32.
UNIT = 2.0**-24


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly `dimensions` components, none null or non-finite, as integers."""
    x, most = F.col(vector_col).cast("array<double>"), F.lit(LARGEST).cast("double")
    sound = F.coalesce((F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, most), -most)).cast("int")
    return df.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of seed and id, in that order; equal ids by their components. A null id counts as no digits."""
    by = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.orderBy(by, "v").limit(clusters).select("v").collect()], np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of integers x the number of its nearest row of c, the exact squared distance, and how many rows the screening left open."""
    n = x.shape[1]
    norm_x, norm_c = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)), np.einsum("ij,ij->i", c, c)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    # n products and sums and the two roundings of the factors; a hair more for the float64 steps below, which err by 2**-53 each.
    gamma = (n + 2) * UNIT / (1 - (n + 2) * UNIT)
    size = norm_x[:, None] * np.sqrt(norm_c.astype(np.float64))[None, :]
    middle = norm_c.astype(np.float64)[None, :] - 2 * product
    reach = 2 * gamma * size * (1 + 1e-9) + (norm_c.astype(np.float64)[None, :] + 2 * np.abs(product) + 2 * size) * 2.0**-50
    open_to = middle - reach <= (middle + reach).min(axis=1)[:, None]
    found = open_to.argmax(axis=1)
    rows = np.flatnonzero(open_to.sum(axis=1) > 1)
    if len(rows):
        row, number = np.nonzero(open_to[rows])
        exact = np.full((len(rows), len(c)), np.iinfo(np.int64).max)
        exact[row, number] = ((x[rows[row]] - c[number]) ** 2).sum(axis=1)
        found[rows] = exact.argmin(axis=1)
    return found, ((x - c[found]) ** 2).sum(axis=1), len(rows)


def _matrices(batches: Iterator[pa.RecordBatch], clusters: int, dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    rows = max(1, CELLS // max(clusters, dimensions))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part.column("vec_id"), part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def next_centroids(vectors: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k, n = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, n), np.int64), np.zeros(k, np.int64)
        for _, x in _matrices(batches, k, n):
            found, _, _ = nearest(x, c)
            order = np.argsort(found, kind="stable")
            own, begin = np.unique(found[order], return_index=True)
            sums[own] += np.add.reduceat(x[order], begin, axis=0)
            counts += np.bincount(found, minlength=k)
        own = np.flatnonzero(counts)
        cells = np.column_stack([counts, sums])[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n + 1)), pa.array(np.tile(np.arange(n + 1), len(own))), pa.array(cells.ravel())], ["cluster", "place", "total"])

    # Each task sends a row for each cluster and component; place 0 counts the vectors.
    parts = vectors.select("vec_id", "v").mapInArrow(run, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    out, found = c.copy(), {(r.cluster, r.place): r.total for r in parts.collect()}
    for k in {k for k, _ in found}:
        out[k] = [found[k, i + 1] // found[k, 0] for i in range(n)]
    return out


def assigned(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    k, n = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, k, n):
            found, distance, _ = nearest(x, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of all sound vectors after `rounds` rounds, as a table, and the final centroids.

    Fewer vectors than clusters give as many centroids as vectors; without any there are no rows.
    """
    vectors = written(integer_vectors(df, id_col, vector_col, dimensions, scale), "vectors")
    c = first_centroids(vectors, clusters, seed)
    if not len(c):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c.reshape(0, dimensions)
    for _ in range(rounds):
        c = next_centroids(vectors, c)
    found = written(assigned(vectors, c), "clusters")
    drop_written(vectors)
    return found, c


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sound vector's cluster and squared distance, the sums of those by cluster and of all, and a digest of its centroid.

    Vectors that are null, of another length or with null or non-finite components have no row; components beyond LARGEST are cut to it. Repeated
    vectors and ids keep a row each, a null id among them. An empty table gives no rows; further columns are not read.
    """
    found, c = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # A row a cluster, CLUSTERS at most, comes to the driver and goes back to each row of its cluster.
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    about = [(i, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist()) if i in sums]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds as chained CTEs. Vectors stay lists; a distance is a list expression, sums are by component."""
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, vec_id, v, cluster, distance FROM (
            SELECT x.row, x.vec_id, x.v, c.cluster, {square} AS distance FROM kept x, c{r} c) QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT cluster, list(CAST(floor_mean AS BIGINT) ORDER BY place) AS v FROM (
                SELECT cluster, place, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
                    SELECT cluster, place, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY cluster, place)) GROUP BY cluster)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    steps_sql = ",\n".join(steps)
    return f"""
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor({SCALE} * CAST(x AS DOUBLE)), -{LARGEST}), {LARGEST}) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIMENSIONS}
),
kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, v FROM sound),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})),
{steps_sql},
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, s.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM sums) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN sums s USING (cluster) JOIN c{ROUNDS} c USING (cluster)
"""


ORACLE_OP12 = _oracle()
