"""Embedding near-duplicates by cross-polytope hashing.

A random rotation (three rounds of random signs and a fast Hadamard transform) sends a vector
to its largest coordinate, the nearest vertex of the cross-polytope. A table concatenates a
few such hashes. Each vector lies in its own bucket and asks the likeliest other buckets as
well; vectors that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.components import component_roots
from clickfold.llm.scratch import Scratch

COSINE = 0.95
#: Hash tables by the number of hashes in a table: more hashes make buckets smaller and rarer
#: for a near pair to share, so that it takes more tables.
TABLES = {1: 6, 2: 6, 3: 6, 4: 8, 5: 12, 6: 20}
#: Buckets a vector asks in each table, its own included.
PROBES = 4
SEED = 7
#: Vectors a bucket holds on average at most; more vectors take one more hash per table.
FILL = 16
#: A bucket that takes in more rows than this is worked on in pairs of blocks, each of about
#: so many; a task compares two blocks at a time, however many vectors there are.
BLOCK = 2000
#: Rows compared with a whole block at a time.
STRIP = 512
PAIR_BITS = 31


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    x, width = x.copy(), 1
    while width < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, width)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1]
        pairs[:, :, 0] += b
        pairs[:, :, 1] = a - b
        width *= 2
    return x / np.sqrt(x.shape[1])


class CrossPolytope:
    """Bucket numbers of unit vectors in every table."""

    def __init__(self, dimension: int, hashes: int):
        self.size = max(2, 1 << (dimension - 1).bit_length())
        self.hashes = hashes
        self.tables = TABLES[hashes]
        random = np.random.default_rng(SEED)
        self.signs = random.choice([-1.0, 1.0], (self.tables, hashes, 3, self.size))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) bucket numbers; the first probe is the own bucket.

        The probes of a table replace one vertex by its runner-up each, those first that
        lose least, as in the usual multiprobe order.
        """
        padded = np.zeros((len(x), self.size))
        padded[:, : x.shape[1]] = x
        at = np.arange(len(x))
        out = np.empty((len(x), self.tables, PROBES), np.int64)
        kept = min(PROBES, 2 * self.size)
        for t in range(self.tables):
            own = np.zeros(len(x), np.int64)
            losses, steps = [], []
            for k in range(self.hashes):
                turned = padded
                for signs in self.signs[t, k]:
                    turned = hadamard(turned * signs)
                both = np.hstack([turned, -turned])
                best = np.argpartition(-both, kept - 1, axis=1)[:, :kept]
                value = np.take_along_axis(both, best, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                best = np.take_along_axis(best, order, axis=1)
                value = np.take_along_axis(value, order, axis=1)
                base = (2 * self.size) ** k
                own += best[:, 0] * base
                for p in range(1, kept):
                    losses.append(value[:, 0] - value[:, p])
                    steps.append((best[:, p] - best[:, 0]) * base)
            loss, step = np.stack(losses, axis=1), np.stack(steps, axis=1)
            nearest = np.argsort(loss, axis=1, kind="stable")[:, : PROBES - 1]
            out[:, t, 0] = own
            for p in range(PROBES - 1):
                column = nearest[:, min(p, nearest.shape[1] - 1)]
                out[:, t, p + 1] = own + step[at, column]
        return out


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _probe_rows(hasher: CrossPolytope):
    """(key, own, id, size, v): a row for every bucket a vector asks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            asked = hasher.buckets(_unit(batch["v"]))
            for t in range(hasher.tables):
                for p in range(PROBES):
                    key = asked[:, t, p] * hasher.tables + t
                    yield pd.DataFrame({"key": key, "own": p == 0, **batch})

    return run


def _block_pairs(asked: DataFrame, large: DataFrame | None) -> DataFrame:
    """``asked`` with ``block`` and ``pair``: a row in a large bucket goes to every pair of
    blocks that its block is in."""
    none = F.lit(0).cast("long")
    if large is None:
        return asked.withColumns({"block": none, "pair": none})
    blocks = F.coalesce("blocks", F.lit(1)).cast("long")
    told = asked.join(large, "key", "left").withColumn("blocks", blocks)
    placed = told.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = placed.withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
    high, low = F.greatest("block", "other"), F.least("block", "other")
    return met.withColumn("pair", high * F.lit(1 << PAIR_BITS) + low).drop("blocks", "other")


def _first_meeting(a: np.ndarray, b: np.ndarray, a_smaller: np.ndarray) -> np.ndarray:
    """Key of the first bucket in which each pair meets, from their asked buckets (pairs,
    tables, probes). In a table, the own bucket of the smaller id goes first."""
    tables = a.shape[1]
    own = np.where(a_smaller[:, None], a[:, :, 0], b[:, :, 0])
    own_other = np.where(a_smaller[:, None], b[:, :, 0], a[:, :, 0])
    asked = np.where(a_smaller[:, None, None], a, b)
    asked_other = np.where(a_smaller[:, None, None], b, a)
    in_own = (asked_other == own[:, :, None]).any(axis=2)
    in_other = (asked == own_other[:, :, None]).any(axis=2)
    table = (in_own | in_other).argmax(axis=1)
    row = np.arange(len(a))
    bucket = np.where(in_own[row, table], own[row, table], own_other[row, table])
    return bucket * tables + table


def _linked(hasher: CrossPolytope, cosine: float):
    """From rows sorted by (key, pair): for each vector that finds partners, its group's root
    and how many vectors the partners stand for. Every pair counts where it first meets."""

    def of_run(key, pair, own, block, ids, sizes, x) -> tuple[np.ndarray, ...] | None:
        order = np.lexsort((ids, ~own))
        block, ids, sizes, x = block[order], ids[order], sizes[order], x[order]
        high, low = divmod(int(pair[0]), 1 << PAIR_BITS)
        owns = int(own.sum())
        asked = None
        found = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for start in range(0, owns, STRIP):
            strip = slice(start, min(owns, start + STRIP))
            i, j = np.nonzero(x[strip] @ x.T >= cosine)
            i = i + start
            wanted = j > i
            if not wanted.any():
                continue
            if high != low:
                wanted &= block[i] != block[j]
            i, j = i[wanted], j[wanted]
            if asked is None:
                asked = hasher.buckets(x)
            first = _first_meeting(asked[i], asked[j], ids[i] < ids[j]) == key[0]
            i, j = i[first], j[first]
            np.add.at(found, i, sizes[j])
            np.add.at(found, j, sizes[i])
            _join(root, i, j)
        met = np.flatnonzero(found)
        return (ids[met], ids[root[met]], found[met]) if len(met) else None

    def of_runs(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        # Most runs are one vector, or hold none of their own bucket.
        owns = np.add.reduceat(columns[2].astype(np.int64), starts)
        made = [
            got
            for start, end in zip(*(x[(ends - starts > 1) & (owns > 0)] for x in (starts, ends)))
            if (got := of_run(*(c[start:end] for c in columns))) is not None
        ]
        out = [np.concatenate(c) for c in zip(*made)] or [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("id", "root", "found"), out)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("key", "pair", "own", "block", "id", "size")
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [*(batch[c].to_numpy() for c in names), _unit(batch["v"])]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            key, pair = columns[:2]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            if len(starts) > 1:
                yield of_runs(columns, starts[:-1], starts[1:])
            # The last run may go on in the next batch.
            kept = [c[starts[-1] :] for c in columns]
        if kept is not None:
            yield of_runs(kept, np.array([0]), np.array([len(kept[0])]))

    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places the smallest place they reach."""
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root[:] = root[root]
        if (root == before).all():
            return


def usable(column: str) -> Column:
    """Whether a vector can have a cosine: finite components, not all zero."""
    return (
        F.col(column).isNotNull()
        & F.coalesce(
            F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))),
            F.lit(False),
        )
        & F.coalesce(F.exists(column, lambda c: c != 0), F.lit(False))
    )


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
) -> DataFrame:
    """One row per input row: its id, ``n_links`` (other rows linked directly),
    ``component_id`` (the smallest id reachable by links, itself included) and ``kept``.

    Rows link when their cosine in double precision is ``cosine`` or more. Pairs come from
    the hash tables, so that a small share may be missed; equal vectors never are. A vector
    that is null, empty, zero or holds null or non-finite components links with nothing.
    Vectors of different lengths never link. Rows repeated in full are rows like others and
    link; a row without an id takes part, and a component of such rows alone has a null
    ``component_id`` and ``kept``. An empty table gives an empty result; other columns are not
    read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "near-vectors")
    vector = F.col(vector_col)
    if table.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    rows = scratch.put(
        table.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("given"),
            F.when(usable(vector_col), vector).alias("v"),
        ),
        "rows",
    )
    # Equal vectors are one node; its number is the first of their rows.
    nodes = scratch.put(
        rows.filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(
            F.min("row").alias("id"),
            F.min("given").alias("first_id"),
            F.count(F.lit(1)).alias("size"),
        ),
        "nodes",
    )
    links = None
    for dimension in [r[0] for r in nodes.select(F.size("v")).distinct().collect()]:
        found = _links_of(nodes.filter(F.size("v") == dimension), dimension, cosine, scratch)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "id long, root long, found long")
    links = scratch.put(links, "links")
    edges = links.select("id", "root").filter("id != root").distinct()
    roots = component_roots(edges, scratch).withColumnsRenamed({"node": "id", "root": "top"})
    counts = links.groupBy("id").agg(F.sum("found").alias("found"))
    placed = (
        nodes.join(roots, "id", "left")
        .join(counts, "id", "left")
        .withColumns({"top": F.coalesce("top", "id"), "found": F.coalesce("found", F.lit(0))})
    )
    least = placed.groupBy("top").agg(F.min("first_id").alias("component"))
    known = placed.join(least, "top").select(
        "v", "component", (F.col("found") + F.col("size") - 1).alias("links")
    )
    # Stored, so that Spark can split a hot vector in the join below.
    known = scratch.put(known, "known")
    # Rows without a usable vector stand alone, and go past the join.
    alone = rows.filter(F.col("v").isNull()).select(
        "given", F.col("given").alias("component"), F.lit(0).cast("long").alias("links")
    )
    joined = rows.join(known, "v").select("given", "component", "links").unionByName(alone)
    return joined.select(
        F.col("given").alias(id_col),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        (F.col("given") == F.col("component")).alias("kept"),
    )


def _hashes_for(total: int, dimension: int) -> int:
    hashes, per_hash = 1, 2 * max(2, 1 << (dimension - 1).bit_length())
    while (
        per_hash**hashes * FILL < total
        and hashes + 1 in TABLES
        and per_hash ** (hashes + 1) * TABLES[hashes + 1] < 1 << 62
    ):
        hashes += 1
    return hashes


def _links_of(nodes: DataFrame, dimension: int, cosine: float, scratch: Scratch) -> DataFrame:
    hasher = CrossPolytope(dimension, _hashes_for(nodes.count(), dimension))
    tables = hasher.tables

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                asked = hasher.buckets(_unit(batch["v"])) * tables
                yield pd.DataFrame({"key": (asked + np.arange(tables)[:, None]).reshape(-1)})

    counts = nodes.select("v").mapInPandas(keys, "key long").groupBy("key").count()
    large = counts.filter(F.col("count") > BLOCK).select(
        "key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")
    )
    # Stored: small where few buckets are large, and then sent to the tasks by Spark.
    large = scratch.put(large, f"large-buckets-{dimension}")
    kind = nodes.schema["v"].dataType.simpleString()
    asked = nodes.select("id", "size", "v").mapInPandas(
        _probe_rows(hasher), f"key long, own boolean, id long, size long, v {kind}"
    )
    rows = _block_pairs(asked, None if large.isEmpty() else large)
    columns = ("key", "pair", "own", "block", "id", "size", "v")
    met = rows.select(*columns).repartition("key", "pair").sortWithinPartitions("key", "pair")
    return met.mapInPandas(_linked(hasher, cosine), "id long, root long, found long")
