"""Hard negatives against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickfold.llm import hard_negatives as hn
from clickfold.llm.whole_vectors import LIMIT, exact_type
from tests.llm.tables import CLASHES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, row by row; rows are (vec_id, vector, label)."""
    kept = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None:
            continue
        if any(v is None or not math.isfinite(v) for v in x):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * v) for v in x], label))
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted(
            (-sum(p * q for p, q in zip(x, y)), i, other)
            for b, (i, y, other) in enumerate(kept)
            if b != a
        )
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * score >= 100 * s[0] >= 100 * score]
            for rank, (other, negative, _) in enumerate(fits[:5], 1):
                out.append((anchor, positive, rank, negative, -score, -other))
    return sorted(out)


def mined(spark, rows, clashes=True):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clashes:
        names = [*CLASHES, "anchor", "anchor_id", "negative", "strip", "probe", "windows", "q", "n"]
        table = table.withColumns(
            {c: F.lit("clash") for c in names if c not in ("label", "embedding", "vec_id")}
        )
    return sorted(map(tuple, hn.mine_hard_negatives(table).collect()))


def some_rows(seed, n, width=6, values=(-0.5, -0.25, 0.0, 0.25, 0.5), labels=3):
    draw = random.Random(seed)
    ids = draw.sample(range(-300, 3 * n), n)
    return [(i, [draw.choice(values) for _ in range(width)], draw.randrange(labels)) for i in ids]


def test_equals_brute_force_with_many_ties(spark):
    rows = some_rows(1, 600)
    # A third of all rows hold one vector.
    rows += [(5000 + i, [0.5, 0.25, 0.0, 0.5, 0.25, 0.5], i % 2) for i in range(300)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_equals_brute_force_without_ties(spark):
    draw = random.Random(2)
    base = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = [
        (i, [v + draw.gauss(0, 0.4) for v in base[i % 4]], draw.randrange(3)) for i in range(700)
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_awkward_rows(spark):
    rows = some_rows(3, 120)
    rows += [
        (None, [1.0] * 6, 1),
        (900, None, 1),
        (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
        (902, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0], 1),
        (903, [float("inf")] + [1.0] * 5, 1),
        (904, [0.5] * 6, None),
        (905, [], 1),
        (1000, [], 1),
        (1100, [0.5, 0.5], 2),
        (1200, [0.5] * 9, 0),
        (1300, [-0.5] * 6, -4),
        (1400, [0.0] * 6, 2),
    ]
    rows += rows[:10] + [(2000, [0.5] * 6, 1)] * 3
    assert mined(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 0), (2, [0.5], 1)]) == []
    assert mined(spark, [(100, [0.5], 0)]) == []
    assert mined(spark, [(100, [0.5], 0), (101, [0.5], 0)]) == []
    assert mined(spark, [(100, [0.5], 0), (101, [0.5], 1)]) == []
    # 80 * 64 = 100 * 51.2: the lower end of the window lies between whole numbers.
    rows = [(100, [1 / 32, 0.0], 0), (101, [1 / 32, 0.0], 0), (102, [7 / 256, 0.0], 1), (103, [6 / 256, 0.0], 1)]
    assert mined(spark, rows) == [(100, 101, 1, 102, 64, 56)] == brute(rows)


def test_keys_sort_as_the_scores_do():
    draw = random.Random(4)
    pairs = [
        (draw.randrange(3), 100 * draw.randrange(-2, 2), draw.random() < 0.5, draw.randrange(-3, 3) * 2**40,
         draw.randrange(-5, 5) * 2**50, draw.randrange(4))
        for _ in range(500)
    ]
    pairs.append((2, 0, True, -(2**63), -(2**63), 2**62))
    pairs.append((2, 0, False, 2**63 - 1, 2**63 - 1, 0))
    keys = sorted(hn.pack(*p) for p in pairs)
    want = sorted(pairs, key=lambda p: (p[0], p[1], -p[3], p[2], p[4], p[5]))
    assert [hn.unpack(k) for k in keys] == want


def test_windows_hold_no_list():
    keys = sorted(
        [hn.pack(1, 100, False, 1000 - i, i, i) for i in range(7)]
        + [hn.pack(1, 100, True, s, 10_000 - s, s) for s in range(700, 1100)]
    )
    out = list(hn.windows_of(iter(keys)))
    assert len(out) == 25
    for place in range(5):
        mine = [o for o in out if o[1] == place]
        assert [o[5] for o in mine] == [1000 - place - i for i in range(5)]
        assert [o[2] for o in mine] == [1, 2, 3, 4, 5]


def test_strips_send_what_matters_only():
    draw = np.random.default_rng(5)
    n = 5000
    label = draw.integers(0, 2, n)
    strip = hn.Strip(np.arange(n), np.arange(n) * 3, label, draw.integers(-4, 5, (n, 8)).astype(np.int32))
    scores = strip.scores(strip.x[:1])[0]
    tops = [int(scores.max()), int(scores.max()), 10]
    best = strip.negatives(scores, 0, tops, 5)
    assert len(best) <= 10 and (strip.label[best] == 1).all()
    assert len(strip.positives(scores, 0, int(strip.row[0]), 5)) == 5
    assert len(strip.positives(scores, 7, 0, 5)) == 0


def test_products_are_exact():
    assert exact_type(2**24 - 1) is np.float32 and exact_type(2**24) is np.float64
    assert exact_type(2**53) is np.int64
    with pytest.raises(ValueError):
        exact_type(2**63)
    x = np.array([[LIMIT - 1, 3]], np.int32)
    strip = hn.Strip(np.arange(1), np.arange(1), np.zeros(1, np.int64), x)
    assert int(strip.scores(x)[0, 0]) == (LIMIT - 1) ** 2 + 9


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="not below"):
        mined(spark, [(100, [1e30], 0)])
