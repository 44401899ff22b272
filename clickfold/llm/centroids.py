"""Centroid clustering over vectors in Hilbert order, with zone maps.

Vectors are sorted along a Hilbert curve and cut into blocks, each with its smallest and
largest value per dimension: its box. Bounds over the box say which centroids can be the
nearest of any vector in the block; only those are compared with the block's vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch
from clickfold.llm.whole_vectors import exact_type, is_whole, largest, matrix, scaled

DIMENSION = 64
CENTROIDS = 40
ROUNDS = 5
SALT = 2
#: Vectors in a block.
BLOCK = 256
#: The curve runs through the space of the main directions in which the first centroids lie
#: apart, with so many bits per direction; boxes have all dimensions.
AXES = 8
BITS = 6


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points with ``bits``-bit coordinates, as rows of bytes
    whose order is the curve's.

    Skilling's method: the highest bits decide how the lower ones of a sub-cube are turned
    (exchanged with, or inverted in, the first coordinate), then the coordinates' bits are read
    across in Gray code.
    """
    x = cells.T.astype(np.uint32)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for axis in range(len(x)):
            upper = (x[axis] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low).astype(np.uint32)
            x[0] ^= np.where(upper, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        set_ = (x[-1] >> np.uint32(level)) & np.uint32(1) == 1
        turn ^= np.where(set_, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def possible_nearest(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some point of the box, ascending.

    ``best`` is the centroid nearest to the middle of the box. For any other one, the difference
    of the two squared distances is linear in each component, so its smallest value over the box
    is a sum of smallest values per dimension; where that is above zero, ``best`` is nearer
    everywhere in the box. Whole numbers, so the bound is exact.
    """
    low, high, c = (a.astype(np.int64) for a in (low, high, centroids))
    best = int(np.square(2 * c - (low + high)).sum(axis=1).argmin())
    slope = 2 * (c[best] - c)
    least = np.where(slope > 0, slope * low, slope * high) + c * c - c[best] * c[best]
    return np.flatnonzero(least.sum(axis=1) <= 0)


def assign(x: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the candidate centroids and its squared distance; ties to the smaller number."""
    c = centroids[candidates]
    kind = exact_type(x.shape[1] * (largest(x) + largest(c)) ** 2)
    x, c = x.astype(kind), c.astype(kind)
    away = np.square(x).sum(axis=1)[:, None] - 2 * (x @ c.T) + np.square(c).sum(axis=1)
    nearest = away.argmin(axis=1)
    return candidates[nearest], away[np.arange(len(x)), nearest].astype(np.int64)


def directions(centroids: np.ndarray, axes: int = AXES) -> np.ndarray:
    """The main directions of the centroids' differences, as columns."""
    x = centroids.astype(np.float64)
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:axes].T


def curve_keys(x: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Keys of vectors on the curve. The grid spans the centroids; what lies outside counts as
    on its edge. The order only decides how tight the boxes are, never a result."""
    corners = centroids @ turn
    low = corners.min(axis=0)
    wide = np.maximum(corners.max(axis=0) - low, 1.0)
    cells = np.clip((x @ turn - low) / wide * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.uint32))


def _keyed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, q, key): the vectors with their place on the curve."""
    turn = directions(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("q"))
            if not len(x):
                continue
            keys = pa.array([k.tobytes() for k in curve_keys(x, centroids, turn)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["vec_id", "q", "key"])

    return vectors.mapInArrow(run, "vec_id long, q array<int>, key binary")


_BLOCKS = "ids array<long>, q array<int>, low array<int>, high array<int>"


def _blocks(size: int):
    def block_rows(ids: pa.ChunkedArray, x: np.ndarray) -> pa.RecordBatch:
        cuts = range(0, len(x), size)
        parts = [x[i : i + size] for i in cuts]
        columns = [
            pa.array([ids[i : i + size].to_pylist() for i in cuts], pa.list_(pa.int64())),
            pa.array([p.ravel() for p in parts], pa.list_(pa.int32())),
            pa.array([p.min(axis=0) for p in parts], pa.list_(pa.int32())),
            pa.array([p.max(axis=0) for p in parts], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "q", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            ids, x = batch.column("vec_id"), matrix(batch.column("q"))
            if kept is not None:
                ids, x = pa.concat_arrays([kept[0], ids]), np.concatenate([kept[1], x])
            whole = len(x) - len(x) % size
            if whole:
                yield block_rows(ids[:whole], x[:whole])
            kept = (ids[whole:], x[whole:]) if whole < len(x) else None
        if kept is not None:
            yield block_rows(*kept)

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """(ids, vectors, cluster, distance) of every block."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, q, low, high = (batch.column(i)[row].values for i in range(4))
            x = q.to_numpy().reshape(len(ids), -1)
            candidates = possible_nearest(low.to_numpy(), high.to_numpy(), centroids)
            yield ids, x, *assign(x, centroids, candidates)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Vectors and componentwise sums per cluster: added up per task, then by Spark; what
    reaches the driver is one number per centroid and dimension."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids):
            for c in np.unique(cluster):
                mine = x[cluster == c]
                total[c, :-1] += mine.sum(axis=0, dtype=np.int64)
                total[c, -1] += len(mine)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width + 1), pa.int32()),
                pa.array(np.tile(np.arange(width + 1), len(used)), pa.int32()),
                pa.array(total[used].ravel(), pa.int64()),
            ],
            ["cluster", "at", "total"],
        )

    parts = blocks.mapInArrow(run, "cluster int, at int, total long")
    found: dict[int, list[int]] = {}
    for row in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():
        found.setdefault(row.cluster, [0] * (width + 1))[row["at"]] = row.total
    return {c: (sums[-1], sums[:-1]) for c, sums in found.items()}


def cluster_vectors(
    embeddings: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    salt: int = SALT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector of ``dimension`` components, none null or non-finite: its id,
    ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``.

    Components count as floor(256 * x); one of 2^19 or more is refused, since distances would
    not fit in a long. The first centroids are the vectors with the smallest SHA-256 of
    ``salt:id``, those without an id last, equal ids by their components; fewer vectors give
    fewer centroids. Repeated rows are vectors of their own, other rows give no row, an empty
    table gives an empty result, and other columns are not read.

    Vectors are sorted once, by range over the curve; copies of one vector are dealt to several
    ranges. The blocks are written, and every round reads them and returns one sum per centroid
    and dimension. Broadcast are the centroids alone.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "centroids")
    wanted = is_whole(F.col(vector_col)) & (F.size(vector_col) == dimension)
    vectors = embeddings.filter(wanted).select(
        F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("q")
    )
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = (
        vectors.select(hashed.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(centroids)
    )
    # At most ``centroids`` rows.
    current = np.array([r.q for r in first.collect()], np.int64).reshape(-1, dimension)
    if not len(current):
        return spark.createDataFrame([], _RESULT)
    keyed = _keyed(vectors, current.copy())
    # The mix deals out copies of one vector, which have one place on the curve.
    mixed = keyed.withColumn("mix", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    ordered = mixed.repartitionByRange("key", "mix").sortWithinPartitions("key", "mix")
    blocks = scratch.put(ordered.select("vec_id", "q").mapInArrow(_blocks(BLOCK), _BLOCKS), "blocks")

    for _ in range(rounds):
        for number, (count, sums) in _sums(blocks, current).items():
            current[number] = [s // count for s in sums]

    final = current

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assigned(batches, final):
            columns = [ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    placed = scratch.put(
        blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed"
    )
    # One row per centroid.
    inertia = {
        r.cluster: int(r.total)
        for r in placed.groupBy("cluster")
        .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
        .collect()
    }
    clusters = [
        (
            number,
            own,
            sum(inertia.values()),
            hashlib.sha256(",".join(map(str, final[number])).encode()).hexdigest(),
        )
        for number, own in inertia.items()
    ]
    told = spark.createDataFrame(
        clusters, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return placed.join(F.broadcast(told), "cluster").select(
        F.col("vec_id").alias(id_col),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        "centroid_sha256",
    )


_RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
    "centroid_sha256 string"
)


def _sql() -> str:
    """The rounds one after the other; whole numbers in doubles, which hold them exactly."""
    parts = [
        f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMENSION}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS cluster, q AS c
  FROM v ORDER BY cluster LIMIT {CENTROIDS}
)"""
    ]
    for turn in range(ROUNDS + 1):
        parts.append(
            f"""
, a{turn} AS (
  SELECT vec_id, any_value(q) AS q,
         min(struct_pack(d := list_dot_product(q, q) - 2 * list_dot_product(q, c)
                              + list_dot_product(c, c), k := cluster)) AS best
  FROM v CROSS JOIN c{turn} GROUP BY vec_id
)"""
        )
        if turn < ROUNDS:
            parts.append(
                f"""
, s{turn} AS (
  SELECT best.k AS cluster, i, floor(sum(q[i]) / count(*)) AS m
  FROM a{turn} CROSS JOIN (SELECT unnest(range(1, {DIMENSION + 1})) AS i) GROUP BY 1, 2
), c{turn + 1} AS (
  SELECT c{turn}.cluster, coalesce(n.c, c{turn}.c) AS c
  FROM c{turn} LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS c FROM s{turn} GROUP BY 1
  ) AS n ON n.cluster = c{turn}.cluster
)"""
            )
    parts.append(
        f"""
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.k
"""
    )
    return "".join(parts)


SQL = _sql()
