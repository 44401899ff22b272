"""Centroid clustering against plain loops."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from clickfold.llm import centroids as ce
from tests.llm.tables import CLASHES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5, width=64):
    kept = [
        (i, [math.floor(256 * v) for v in x])
        for i, x, _ in rows
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)
    ]
    if not kept:
        return []
    order = sorted(
        kept,
        key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]),
    )
    current = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(current))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for n, members in groups.items():
            current[n] = [sum(v) // len(members) for v in zip(*members)]
    placed = [(i, *nearest(x)) for i, x in kept]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in current]
    own = {}
    for _, d, n in placed:
        own[n] = own.get(n, 0) + d
    out = [(i, n, d, own[n], sum(own.values()), shas[n]) for i, d, n in placed]
    return sorted(out, key=str)


def clustered(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = [*CLASHES, "q", "key", "mix", "ids", "low", "high", "cluster", "distance"]
    table = table.withColumns(
        {c: F.lit("clash") for c in names if c not in ("label", "embedding", "vec_id")}
    )
    return sorted(map(tuple, ce.cluster_vectors(table, **options).collect()), key=str)


def some_rows(seed, n, width=64):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    # As single-precision values, which the tables hold.
    return [
        (i, [float(np.float32(draw.gauss(m, 0.05))) for m in draw.choice(middle)], 0)
        for i in range(n)
    ]


def test_equals_brute_force(spark):
    rows = some_rows(1, 900)
    # A third of all rows are one vector, and some vectors lie far off.
    rows += [(10_000 + i, rows[0][1], 1) for i in range(450)]
    rows += [(20_000 + i, [100.0 * i] * 64, 1) for i in range(3)]
    got = clustered(spark, rows)
    assert len(got) == len(rows) and got == brute(rows)


def test_awkward_rows(spark):
    rows = some_rows(2, 90)
    rows += [
        (None, [0.125] * 64, 1),
        (None, [0.125] * 64, 1),
        (500, None, 1),
        (501, [0.1] * 63, 1),
        (502, [0.1] * 65, None),
        (503, [], 1),
        (504, [0.1] * 63 + [None], 1),
        (505, [0.1] * 63 + [float("nan")], 1),
        (506, [-float("inf")] * 64, 1),
        (507, [0.0] * 64, None),
        (-8, [-0.25] * 64, None),
    ]
    rows += rows[:5]
    assert clustered(spark, rows) == brute(rows)


def test_few_vectors_and_ties(spark):
    assert clustered(spark, []) == []
    assert clustered(spark, [(1, None, 0)]) == []
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(6)]
    got = clustered(spark, rows)
    assert got == brute(rows)
    # Equal centroids: the smaller number takes all, the others stay empty.
    assert len({r[1] for r in got}) == 2
    small = some_rows(3, 50, width=5)
    assert clustered(spark, small, centroids=4, rounds=2, dimension=5) == brute(small, 4, 2, 5)


def test_the_curve_visits_neighbours():
    for axes, bits in ((2, 3), (2, 5), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = [k.tobytes() for k in ce.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[np.argsort(np.array(keys, object), kind="stable")]
        steps = np.abs(np.diff(walk, axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_boxes_keep_every_nearest_centroid():
    draw = np.random.default_rng(4)
    for _ in range(200):
        spread = int(draw.integers(1, 60))
        x = draw.integers(-40, 40, 4) + draw.integers(-spread, spread + 1, (30, 4))
        c = draw.integers(-60, 60, (12, 4))
        c[5] = c[3]
        kept = ce.possible_nearest(x.min(axis=0), x.max(axis=0), c)
        away = np.square(x[:, None] - c[None]).sum(axis=2)
        assert set(away.argmin(axis=1)) <= set(kept)
        cluster, distance = ce.assign(x, c, kept)
        assert (cluster == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()


def test_tight_blocks_meet_few_centroids():
    rows = some_rows(5, 4000)
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    centroids = x[:40]
    keys = ce.curve_keys(x, centroids, ce.directions(centroids))
    order = np.argsort(np.array([k.tobytes() for k in keys], object))
    met = [
        len(ce.possible_nearest(b.min(axis=0), b.max(axis=0), centroids))
        for b in np.array_split(x[order], 4000 // 64)
    ]
    assert np.mean(met) < 16


def test_large_components_are_exact(spark):
    draw = random.Random(6)
    rows = [(i, [draw.uniform(-5e5, 5e5) for _ in range(64)], 0) for i in range(60)]
    rows = [(i, [float(np.float32(v)) for v in x], n) for i, x, n in rows]
    assert clustered(spark, rows) == brute(rows)
