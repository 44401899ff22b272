"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Tasks turn every text into a few statistics. Random Fourier features of the standardised
statistics approximate a Gaussian kernel; each partition of the labelled rows sums its part
of the normal equations, and the sums are solved on the driver. The raw scores of labelled
rows left out of the fit are binned, and pooling adjacent bins makes them probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch

#: Labels are learned from rows whose remainder of crc32(id) by FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 3, 1
#: Of these, one in so many calibrates and the others fit.
CALIBRATION = 4
FOURIER = 256
RIDGE = 1e-3
SEED = 20240
#: Raw scores are pooled from so many bins between the two limits.
BINS, LOWEST, HIGHEST = 2000, -0.5, 1.5
#: Standardised statistics beyond this count as this.
EXTREME = 6.0

_SYMBOLS = b"#$%&*@^~<>=+\\/{}[]_`"
_QUOTES = b"\"'()-:;"


def text_statistics(text: str) -> list[float]:
    """Statistics of a whole text: lengths, shares of character classes, repetition."""
    data = text.encode()
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = seen / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    kinds, of_kind = np.unique(lengths, return_counts=True)
    distinct = len(set(words))
    lines = text.split("\n")
    held = share[share > 0]
    letters = seen[65:91].sum() + seen[97:123].sum()
    return [
        np.log1p(len(data)),
        share[97:123].sum(),
        seen[65:91].sum() / max(1, letters),
        share[48:58].sum(),
        share[128:].sum(),
        share[32],
        share[10],
        share[list(b".")].sum(),
        share[list(b",")].sum(),
        share[list(b"!?")].sum(),
        share[list(b"|")].sum(),
        share[list(_SYMBOLS)].sum(),
        share[list(_QUOTES)].sum(),
        -(held * np.log(held)).sum(),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        (lengths <= 3).mean(),
        of_kind.max() / m,
        distinct / m,
        distinct / np.sqrt(m),
        sum(map(str.__eq__, words, words[1:])) / m,
        np.log1p(len(lines)),
        len(words) / len(lines),
        len(set(lines)) / len(lines),
        len(zlib.compress(data, 1)) / n,
    ]


STATISTICS = len(text_statistics(""))


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["id"].astype("Int64"),
                    "x": [text_statistics(t) for t in batch["text"]],
                }
            )

    return slim.mapInPandas(run, "id long, x array<double>")


def _crc(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")))


def is_held_out(id_: Column) -> Column:
    """A row without an id counts as the empty id, which is not held out."""
    return _crc(id_) % FOLDS == HELD_OUT


@dataclass
class Model:
    """What scoring needs: a few kilobytes, whatever the size of the table."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -EXTREME, EXTREME)
        random = np.random.default_rng(SEED)
        turn = random.normal(0.0, np.sqrt(1.0 / STATISTICS), (STATISTICS, FOURIER))
        shift = random.uniform(0.0, 2.0 * np.pi, FOURIER)
        waves = np.sqrt(2.0 / FOURIER) * np.cos(z @ turn + shift)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(x), 0.5)
        return np.interp(self.raw_score(x), self.raw, self.probability)


def pool_adjacent(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic regression: for each bin the rate of the pool it ends up in."""
    pools: list[list[float]] = []
    for n, y in zip(total.tolist(), good.tolist()):
        pools.append([n, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, y2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + y2, pools[-1][2] + k2]
    return np.repeat([y / n for n, y, _ in pools], [int(k) for _, _, k in pools])


def _normal_equations(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FOURIER + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if len(batch):
                phi = model.features(np.stack(batch["x"].to_numpy()))
                left += phi.T @ phi
                right += phi.T @ batch["y"].to_numpy(np.float64)
        yield pd.DataFrame(
            {"i": np.arange(size), "terms": list(np.hstack([left, right[:, None]]))}
        )

    return run


def _sum_terms(group: pd.DataFrame) -> pd.DataFrame:
    # One row per partition of the labelled rows.
    return pd.DataFrame({"i": group["i"].iloc[:1], "terms": [group["terms"].sum()]})


def fit(statistics: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    """Learn from the labelled rows outside the held-out fold.

    ``statistics`` is (id, x). An id labelled more than once counts with its mean label; null
    labels do not count. Without labelled rows every score is one half.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull())
        .filter(~is_held_out(F.col("id")))
        .groupBy("id")
        .agg(F.avg("y").alias("y"))
    )
    train = statistics.join(known, "id").withColumn(
        "fits", F.floor(_crc(F.col("id")) / FOLDS) % CALIBRATION != 0
    )
    train = Scratch(statistics.sparkSession, "quality").put(train, "train")
    none = np.array([])
    fitting = train.filter("fits")
    columns = [F.col("x")[i] for i in range(STATISTICS)]
    moments = fitting.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(c).alias(f"mean{i}") for i, c in enumerate(columns)),
        *(F.stddev_pop(c).alias(f"scale{i}") for i, c in enumerate(columns)),
    ).first()
    if not moments.n:
        zero = np.zeros(STATISTICS)
        return Model(zero, zero + 1, np.zeros(FOURIER + 1), none, none)
    mean = np.array([moments[f"mean{i}"] for i in range(STATISTICS)])
    scale = np.array([moments[f"scale{i}"] for i in range(STATISTICS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), none, none, none)
    terms = fitting.select("x", "y").mapInPandas(
        _normal_equations(model), "i int, terms array<double>"
    )
    summed = terms.groupBy("i").applyInPandas(_sum_terms, "i int, terms array<double>")
    rows = np.stack([r.terms for r in summed.orderBy("i").collect()])
    left, right = rows[:, :-1], rows[:, -1]
    penalty = np.full(FOURIER + 1, RIDGE * moments.n)
    penalty[-1] = 1e-9 * moments.n
    model.weights = np.linalg.solve(left + np.diag(penalty), right)
    model.raw, model.probability = _calibrate(train, model)
    return model


def _calibrate(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the pooled bins and their rates, from the rows left out of the fit, or
    from all where none were."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = model.raw_score(np.stack(batch["x"].to_numpy()))
                place = (raw - LOWEST) / (HIGHEST - LOWEST) * BINS
                yield pd.DataFrame(
                    {
                        "bin": np.clip(place, 0, BINS - 1).astype(np.int64),
                        "fits": batch["fits"],
                        "y": batch["y"],
                    }
                )

    bins = train.mapInPandas(binned, "bin long, fits boolean, y double")
    counted = bins.groupBy("fits", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    table = counted.toPandas()
    if not table["fits"].all():
        table = table[~table["fits"].astype(bool)]
    table = table.sort_values("bin")
    total, good = table["n"].to_numpy(float), table["y"].to_numpy(float)
    centre = LOWEST + (table["bin"].to_numpy() + 0.5) * (HIGHEST - LOWEST) / BINS
    rate = pool_adjacent(total, good)
    # A pool stands at the mean of its rows' scores; between pools the score rises evenly.
    pool = np.r_[0, np.cumsum(np.diff(rate) > 0)]
    weight = np.bincount(pool, total)
    return np.bincount(pool, total * centre) / weight, np.bincount(pool, total * rate) / weight


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per input row: its id, ``held_out``, ``score`` (0 to 1, higher: the label 1 is
    likelier) and ``predicted`` (1 from one half on).

    Only the text decides a score. A null text counts as empty and is scored like any other;
    repeated rows get equal scores, an empty table gives an empty result, and other columns
    are not read. Labels: see :func:`fit`.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    statistics = scratch.put(statistics_table(docs, id_col, text_col), "statistics")
    model = fit(statistics, labels, id_col, label_col)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    return statistics.select(
        F.col("id").alias(id_col),
        is_held_out(F.col("id")).alias("held_out"),
        scored("x").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_low_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs`` without the rows predicted 0, with all columns.

    The statistics are computed once for the fit and again while filtering, so that no text
    is shuffled.
    """
    known = labels.select(F.col(id_col).cast("long").alias("known_id")).distinct()
    # Held-out rows teach nothing; a join to leave out more would move all texts.
    labelled = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    ).filter(F.col("id").isNotNull() & ~is_held_out(F.col("id").cast("long")))
    statistics = statistics_table(labelled, "id", "text").join(
        known, F.col("id") == F.col("known_id"), "left_semi"
    )
    model = fit(statistics, labels, id_col, label_col)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=bool)
        return pd.Series(model.score(np.array([text_statistics(t) for t in text])) >= 0.5)

    return docs.filter(good(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
