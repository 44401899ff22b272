"""The quality classifier by held-out accuracy and by its parts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickfold.llm import quality
from tests.conftest import SF_DIR
from tests.llm.tables import TEXTS, documents, empty_documents


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return quality.score_documents(docs, labels).toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    known = scored.merge(labels, on="doc_id")
    held = known[known["held_out"]]
    assert len(held) > 100
    good, bad = (held[held["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (held[held["quality"] == 1]["predicted"] == 1).mean() > 0.98


def test_folds_and_range(scored):
    for row in scored.itertuples():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0.0 <= row.score <= 1.0
        assert row.predicted == int(row.score >= 0.5)


def test_held_out_labels_and_other_columns_do_not_matter(spark, scored):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "n_chars": F.lit(0)})
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality"))
    labels = labels.withColumn("quality", F.coalesce(turned, F.col("quality")))
    again = quality.score_documents(docs.repartition(3), labels).toPandas()
    both = scored.merge(again, on="doc_id")
    assert np.allclose(both["score_x"], both["score_y"], atol=1e-6)


def test_pooling_equals_the_minimax_formula():
    random = np.random.default_rng(0)
    for _ in range(50):
        total = random.integers(1, 5, 12).astype(float)
        good = np.array([random.integers(0, n + 1) for n in total], float)
        t, g = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(good)]
        want = [
            max(
                min((g[b + 1] - g[a]) / (t[b + 1] - t[a]) for b in range(i, 12))
                for a in range(i + 1)
            )
            for i in range(12)
        ]
        assert np.allclose(quality.pool_adjacent(total, good), want)


def test_fourier_features_approximate_the_kernel():
    zero = np.zeros(quality.STATISTICS)
    model = quality.Model(zero, zero + 1, zero, zero, zero)
    x = np.random.default_rng(1).normal(size=(40, quality.STATISTICS)) / 2
    waves = model.features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel = np.exp(-distance / (2 * quality.STATISTICS))
    assert np.abs(waves @ waves.T - kernel).max() < 0.3
    assert np.abs(waves @ waves.T - kernel).mean() < 0.06


def test_partition_sums_are_the_normal_equations(spark):
    docs = documents(spark, [(i, f"text {i} " * (i % 9 + 1) + "#" * (i % 5)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one, many = (
        quality.score_documents(docs.repartition(n), labels).toPandas().set_index("doc_id")
        for n in (1, 7)
    )
    assert np.allclose(one["score"].sort_index(), many["score"].sort_index(), atol=1e-6)


@pytest.mark.parametrize(
    "pairs", [[], [(1, 1)], [(5, 0), (5, 0)], [(None, 1), (3, None)], [(2, 1), (2, 0), (4, 0)]]
)
def test_awkward_rows_and_labels(spark, pairs):
    labels = spark.createDataFrame(pairs, "doc_id long, quality int")
    got = quality.score_documents(documents(spark), labels).collect()
    assert len(got) == len(TEXTS)
    assert all(0.0 <= r.score <= 1.0 for r in got)
    if not pairs:
        assert {r.score for r in got} == {0.5}
    kept = quality.drop_low_quality(documents(spark), labels)
    assert kept.columns == documents(spark).columns
    assert kept.count() == sum(r.predicted for r in got)


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_documents(empty_documents(spark), labels).count() == 0
    assert quality.drop_low_quality(empty_documents(spark), labels).count() == 0
