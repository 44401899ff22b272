"""Embedding near-duplicates against all cosines."""

import numpy as np
import pytest

from clickfold.llm import near_vectors

CLASH = "row given v id first_id size links found top component key pair own block".split()


def table(spark, rows, kind="float"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def by_hand(rows, kind):
    def usable(v):
        return v is not None and None not in v and np.isfinite(v).all() and any(v)

    cast = np.float32 if kind == "float" else np.float64
    vectors = [np.array(v, cast).astype(float) if usable(v) else None for _, v, _ in rows]
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                    links[i].append(j)
                    links[j].append(i)
    root = list(range(n))
    for i in range(n):
        for j in links[i]:
            if root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if root[k] == root[i] and rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((vec, len(links[i]), least, None if vec is None or least is None else vec == least))
    return out


def clustered(n, dimension, seed, spread=0.12):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n // 12 + 1, dimension))
    rows = []
    for i in range(n):
        v = centres[random.integers(len(centres))]
        v = v + spread * random.normal(size=dimension) * random.choice([0.0, 0.5, 1.0])
        rows.append((i, [float(x) for x in v], 0))
    return rows


def collected(df):
    got = [tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()]
    return sorted(got, key=str)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0),
        (6, [None, 1.0], 0), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0),
        (9, [1.0, 2.0, 0.0], 0), (None, [1.0, 2.0], 0), (None, [-5.0, 1.0], 0), (10, [3.0], 0),
        (11, [0.1], 0), (12, [-1.0], 0), (13, [0.0, -0.0, 7.0], 0), (14, [-0.0, 0.0, 7.0], 0),
    ]
    for kind in ("float", "double"):
        got = collected(near_vectors.near_vectors(table(spark, rows, kind)))
        assert got == sorted(by_hand(rows, kind), key=str)


@pytest.mark.parametrize("block", [2000, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = clustered(400, 24, 1)
    got = collected(near_vectors.near_vectors(table(spark, rows)))
    want = sorted(by_hand(rows, "float"), key=str)
    links, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert true > 500
    assert 0.97 * true <= links <= true
    if links == true:
        assert got == want


def test_recall_is_high_with_more_hashes(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "FILL", 0.02)
    rows = clustered(500, 64, 2, spread=0.2)
    got = collected(near_vectors.near_vectors(table(spark, rows)))
    want = {r[0]: r[1] for r in by_hand(rows, "float")}
    assert all(r[1] <= want[r[0]] for r in got)
    assert sum(r[1] for r in got) >= 0.9 * sum(want.values()) > 0


@pytest.mark.parametrize("hashes", [1, 3, 4, 5])
def test_recall_per_number_of_hashes(hashes):
    """Pairs at the threshold itself that share a bucket in some table."""
    random = np.random.default_rng(hashes)
    x = random.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = random.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    hasher = near_vectors.CrossPolytope(64, hashes)
    a, b = hasher.buckets(x), hasher.buckets(z)
    meets = (b == a[:, :, :1]).any(axis=2) | (a == b[:, :, :1]).any(axis=2)
    assert meets.any(axis=1).mean() >= 0.95


def test_a_bucket_of_ten_blocks(spark, monkeypatch):
    """One bucket ten times the block: runs hold two blocks, and all links are found."""
    monkeypatch.setattr(near_vectors, "BLOCK", 40)
    random = np.random.default_rng(4)
    centre = random.normal(size=16)
    rows = [(i, [float(v) for v in centre + 0.02 * random.normal(size=16)], 0) for i in range(400)]
    got = collected(near_vectors.near_vectors(table(spark, rows)))
    assert got == sorted(by_hand(rows, "float"), key=str)
    asked = spark.createDataFrame([(7, i) for i in range(400)] + [(8, 1)], "key long, id long")
    large = spark.createDataFrame([(7, 10)], "key long, blocks long")
    runs = near_vectors._block_pairs(asked, large).groupBy("key", "pair").count().collect()
    assert max(r["count"] for r in runs) <= 3 * 40 and len(runs) == 55 + 1
    assert sum(r["count"] for r in runs) == 400 * 10 + 1


def test_large_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.5, 0.25], 0) for i in range(3000)] + [(5000, [1.0, 0.5, 0.26], 0)]
    got = collected(near_vectors.near_vectors(table(spark, rows)))
    assert {r[1:3] for r in got} == {(3000, 0)}


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = near_vectors.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(near_vectors.hadamard(y), x)


def test_buckets_do_not_depend_on_the_batch():
    hasher = near_vectors.CrossPolytope(10, 2)
    x = np.random.default_rng(3).normal(size=(50, 10))
    whole = hasher.buckets(x)
    assert (np.concatenate([hasher.buckets(x[i : i + 7]) for i in range(0, 50, 7)]) == whole).all()
    assert all(len(set(row)) == near_vectors.PROBES for row in whole.reshape(-1, near_vectors.PROBES))


def test_empty_table(spark):
    assert near_vectors.near_vectors(table(spark, []).limit(0)).count() == 0
