"""Centroid clustering in integers, candidates filtered in leading rotated coordinates.

*Vectors.*  Each component x is the integer floor(1024 * x); everything that counts (distances, sums, centroids) is computed from these
integers exactly, so results don't depend on partitions, order or rounding.

*Filter.*  The covariance of all vectors is summed over the cluster; its eigenvectors rotate them.
Each vector is written once with its ``LEADING`` first rotated coordinates and the norm of what is left.
For a centroid, the squared distance of the leading coordinates plus the squared difference of both residual norms is at most the
squared distance.  Each vector's exact distance to the centroid of the least bound refutes all centroids whose bound
(less a slack above any rounding) is larger; those that survive are verified in integers, ties going to the smaller number.

*Rounds.*  Tasks sum their vectors by cluster; the sums travel as limbs of 32 bits, so they are exact whatever their size, and the
driver sees a few numbers per cluster and component.  Vectors with components from 2^26 on (by
size) are compared in Python's integers, all the others in numpy's.

Defined results: rows whose vector is null, of another length, or holds a null or non-finite component are left out; with fewer rows
than centroids wanted there are as many as rows; a null vec_id counts as the empty string in the hash; of rows of one vec_id
(or hash) the one with the smaller vector is the earlier; repeated rows count each; a distance or inertia
beyond a long is the largest long; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Rotated coordinates kept.
LEADING = 16
#: Components below this (by size) are compared in 64-bit integers: 64 squared differences stay below 2^62.
SMALL = 1 << 26
#: Part of both squared norms that a bound must lie above a distance by; rounding is far below.
SLACK = 1e-9
#: Vectors compared at once.
ROWS = 4096
LONGEST = (1 << 63) - 1
_LIMB = 32


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, x) of the rows that count."""
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(usable)


def _integer(x: float) -> int:
    """floor(SCALE * x), exact where the product would overflow too."""
    scaled = x * SCALE
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * SCALE


def integers(x: np.ndarray) -> np.ndarray:
    """Rows of vectors as int64, or as Python's integers if one is too large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([[_integer(v) for v in row] for row in x.tolist()], dtype=object)


def _doubles(v: np.ndarray) -> np.ndarray:
    return v.astype(np.float64)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _summed(partial: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Exact totals of (keys, limb, value) rows; one for each key."""
    totals: dict[tuple, int] = {}
    for *key, limb, value in partial.groupBy(*keys, "limb").agg(F.sum("value").alias("value")).collect():
        totals[tuple(key)] = totals.get(tuple(key), 0) + (value << (_LIMB * limb))
    return totals


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(limb, value): the last one has the sign."""
    limb = 0
    while not -(1 << _LIMB) < total < (1 << _LIMB):
        yield limb, total & ((1 << _LIMB) - 1)
        total >>= _LIMB
        limb += 1
    yield limb, total


def rotation(kept: DataFrame, leading: int = LEADING, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading eigenvectors (as columns) of the covariance of all rows; only the filter's strength depends on it."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            # very long vectors would swamp the others (or overflow); their direction says little of those
            x = np.clip(_rows(batch.column(0), dimensions), -1e6, 1e6)
            x = np.c_[x, np.ones(len(x))]
            total += x.T @ x
        i, j = np.indices(total.shape)
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    summed = kept.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("value")).collect()
    moments = np.zeros((dimensions + 1, dimensions + 1))
    for i, j, value in summed:
        moments[i, j] = value
    rows = max(moments[-1, -1], 1.0)
    mean = moments[-1, :-1] / rows
    return np.linalg.eigh(moments[:-1, :-1] / rows - np.outer(mean, mean))[1][:, ::-1][:, :leading]


def rotated(kept: DataFrame, axes: np.ndarray) -> DataFrame:
    """(vec_id, x, lead, rest): each vector, its leading coordinates and the norm of what is left, of its integers."""
    dimensions = len(axes)
    schema = T.StructType([*kept.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = _split(np.floor(np.clip(_rows(batch.column(1), dimensions), -1e100, 1e100) * SCALE), axes)
            lead = pa.array(list(lead), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lead, pa.array(rest)], names=schema.names)

    return kept.mapInArrow(run, schema)


def _split(v: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = v @ axes
    return lead, np.sqrt(np.maximum((v * v).sum(1) - (lead * lead).sum(1), 0.0))


def _exact(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    off = v - centroid
    return (off * off).sum(1)


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids verified) of each row of integers."""
    n, k = len(v), len(centroids)
    verified = np.zeros(n, np.int32)
    if v.dtype == object or centroids.dtype == object:
        distance = np.array([[sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids.tolist()] for row in v.tolist()], dtype=object).reshape(n, k)
        cluster = np.array([min(range(k), key=lambda j: (row[j], j)) for row in distance], np.int32)
        return cluster, distance[np.arange(n), cluster], verified + k
    c_lead, c_rest = _split(_doubles(centroids), axes)
    norms = (lead * lead).sum(1) + rest * rest
    bound = np.stack([((lead - c_lead[j]) ** 2).sum(1) + (rest - c_rest[j]) ** 2 - SLACK * (norms + (c_lead[j] ** 2).sum() + c_rest[j] ** 2) for j in range(k)], 1)
    cluster = bound.argmin(1)
    distance = _exact(v, centroids[cluster])
    tried = cluster.copy()
    verified += 1
    for j in range(k):
        at = np.flatnonzero((bound[:, j] <= distance) & (tried != j))
        if not len(at):
            continue
        d = _exact(v[at], centroids[j])
        verified[at] += 1
        better = (d < distance[at]) | ((d == distance[at]) & (j < cluster[at]))
        cluster[at[better]], distance[at[better]] = j, d[better]
    return cluster.astype(np.int32), distance, verified


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray) -> Iterator[tuple]:
    """(rows, integers, cluster, distance, verified) of blocks of at most ROWS rows."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            v = integers(_rows(batch.column(1), len(axes)))
            yield batch, v, *nearest(v, _rows(batch.column(2), axes.shape[1]), batch.column(3).to_numpy(), centroids, axes)


def cluster_sums(rows: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> dict[tuple, int]:
    """Exact sums by (cluster, component); behind the components stand the number of vectors and the sum of distances."""
    dimensions = len(axes)
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("component", T.IntegerType()), T.StructField("limb", T.IntegerType()), T.StructField("value", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, int] = {}
        for _, v, cluster, distance, _ in _assigned(batches, centroids, axes):
            for j in np.unique(cluster).tolist():
                mine = cluster == j
                # a block's distances are summed in Python: numpy's might wrap
                found = [*v[mine].sum(0).tolist(), int(mine.sum()), sum(distance[mine].tolist())]
                for i, value in enumerate(found):
                    totals[j, i] = totals.get((j, i), 0) + value
        out = [(*key, *limb) for key, total in totals.items() for limb in _limbs(total)]
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int32()] * 3 + [pa.int64()])], names=schema.names)

    assert dimensions == centroids.shape[1]
    return _summed(rows.mapInArrow(run, schema), ["cluster", "component"])


def _array(centroids: list[list[int]]) -> np.ndarray:
    small = all(-SMALL < x < SMALL for row in centroids for x in row)
    return np.array(centroids, dtype=np.int64 if small else object)


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes, as integers."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return _array([[_integer(v) for v in r["x"]] for r in kept.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()])


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, leading: int = LEADING, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, verified) of the vectors kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, verified int"
    kept = kept_vectors(vectors, dimensions)
    axes = rotation(kept, leading, dimensions)
    rows = written(rotated(kept, axes), "kmeans-rotated")
    centroids = first_centroids(rows.select("vec_id", "x"), k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        sums = cluster_sums(rows, centroids, axes)
        moved = centroids.tolist()
        for j in range(len(moved)):
            if (j, dimensions) in sums:
                moved[j] = [sums[j, i] // sums[j, dimensions] for i in range(dimensions)]
        centroids = _array(moved)
    sums = cluster_sums(rows, centroids, axes)
    inertia = [sums.get((j, dimensions + 1), 0) for j in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = min(sum(inertia), LONGEST)
        for batch, _, cluster, distance, verified in _assigned(batches, centroids, axes):
            of = cluster.tolist()
            longs = pa.array([min(d, LONGEST) for d in distance.tolist()], pa.int64())
            mine = pa.array([min(inertia[j], LONGEST) for j in of], pa.int64())
            marked = pa.array([marks[j] for j in of], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32()), longs, mine, pa.array([total] * len(of), pa.int64()), marked, pa.array(verified)], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def digest(vectors: DataFrame) -> DataFrame:
    """Rows of op13."""
    return clustered(vectors).drop("verified")


def _oracle() -> str:
    """The same rounds as one query: vectors and centroids in long form, a pair of steps a round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT rid, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIMENSIONS + 1}) AS r(i))",
        f"""c0 AS MATERIALIZED (SELECT k, i, x AS c FROM v JOIN (
  SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS k FROM kept) USING (rid) WHERE k < {CENTROIDS})""",
    ]
    for t in range(ROUNDS + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (SELECT rid, k, d FROM (
  SELECT rid, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM v JOIN c{t} USING (i) GROUP BY rid, k)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
        )
        if t < ROUNDS:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
  FROM c{t} LEFT JOIN (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{t} USING (rid) GROUP BY k, i) USING (k, i))"""
            )
    last = ROUNDS
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (rid) JOIN (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k) USING (k)
"""
    )


#: Rows of op13, without how many centroids were verified.
ORACLE = _oracle()
