from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from clickfold.functions.rates import at_least_one, fraction, percent


def exact(num, den, scale, factor):
    if not den:
        return Decimal(0)
    return (Decimal(num * factor) / Decimal(den)).quantize(
        Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP
    )


def test_ties_round_half_up(spark):
    df = spark.createDataFrame([(23, 160), (41, 160), (1, 3), (0, 7)], "n long, d long")
    rows = df.select(percent("n", "d").alias("p")).collect()
    assert [r.p for r in rows] == [Decimal(t) for t in ("14.38", "25.63", "33.33", "0.00")]


def test_empty_denominator_gives_zero(spark):
    df = spark.createDataFrame([(5, 0), (5, None)], "n long, d long")
    assert {r.r for r in df.select(fraction("n", "d").alias("r")).collect()} == {Decimal("0.0000")}


def test_serving_denominator_is_at_least_one(spark):
    df = spark.createDataFrame([(0,), (None,), (7,)], "d long")
    assert [r.d for r in df.select(at_least_one("d").alias("d")).collect()] == [1, 1, 7]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 10**13), st.integers(0, 10**13)), min_size=30, max_size=60
    )
)
def test_rates_are_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    for row in df.select("n", "d", fraction("n", "d").alias("f"), percent("n", "d").alias("p")).collect():
        assert row.f == exact(row.n, row.d, 4, 1)
        assert row.p == exact(row.n, row.d, 2, 100)


def test_small_ratios_all_exact(spark):
    grid = spark.range(400 * 59).selectExpr("id div 59 AS n", "id % 59 + 1 AS d")
    for row in grid.select("n", "d", percent("n", "d").alias("p")).collect():
        assert row.p == exact(row.n, row.d, 2, 100)
