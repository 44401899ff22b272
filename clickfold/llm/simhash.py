"""SimHash near-duplicates found by one-wildcard segment variants.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of one of
their two 32-bit halves. Each distinct fingerprint is indexed under both halves and under
every half with one bit masked; an equality join on these keys meets all such pairs, and
comparing the whole fingerprints verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.components import component_roots
from clickfold.llm.exact_dedup import keep_rows
from clickfold.llm.scratch import Scratch

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HALF = 32
#: A variant held by more fingerprints than this is worked on in pairs of blocks, each of about
#: so many; a task compares two blocks at a time, however many fingerprints there are.
BLOCK = 4096

_LOW = np.uint64(0xFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """SimHash over repeated 3-word shingles; words end at ASCII white space, A-Z count as
    a-z. Fewer words are one shingle, no words give 0. Signed, as Spark stores it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", n)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["id"].astype("Int64"),
                    "fp": [fingerprint(t) for t in batch["text"]],
                    "text_hash": batch["text_hash"],
                }
            )

    return slim.mapInPandas(run, "id long, fp long, text_hash long")


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    return bits >> np.uint64(HALF), bits & _LOW


def _half_keys() -> Column:
    """Both halves of ``fp`` as (number, value) structs."""
    low = F.lit((1 << HALF) - 1)
    values = (F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(low))
    return F.array(
        *(F.struct(F.lit(n).alias("number"), v.alias("value")) for n, v in enumerate(values))
    )


def _variants(half: Column) -> Column:
    """Keys of a half: with each bit masked, and whole. A key names the half, the masked bit
    (32: none) and what is left."""

    def key(bit: int) -> Column:
        value = half["value"]
        if bit < HALF:
            value = value.bitwiseOR(F.lit(1 << bit))
        return ((half["number"] * (HALF + 1) + F.lit(bit)).cast("long") * F.lit(1 << HALF)) + value

    return F.array(*(key(bit) for bit in range(HALF + 1)))


def large_keys(distinct: DataFrame) -> DataFrame:
    """(key, blocks) of the variants held by more than :data:`BLOCK` fingerprints: added up
    from the halves, of which only those that hold enough can make up such a variant."""
    counts = (
        distinct.select(F.explode(_half_keys()).alias("half"))
        .groupBy("half")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A masked variant is two halves at most, so the larger has half of what it takes.
    some = counts.filter(F.col("n") > BLOCK // 2)
    keys = some.select(F.explode(_variants(F.col("half"))).alias("key")).distinct()
    near = counts.select(F.explode(_variants(F.col("half"))).alias("key"), "n")
    held = near.join(keys, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    return held.filter(F.col("n") > BLOCK).select(
        "key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")
    )


def indexed(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, pair, fp): every fingerprint under all its variants; under a large variant once
    for every pair of blocks that its block is in."""
    some = distinct.select(F.explode(_half_keys()).alias("half")).groupBy("half").count()
    if some.filter(F.col("count") > BLOCK // 2).isEmpty():
        large = None
    else:
        # Stored: small where few variants are large, and then sent to the tasks by Spark.
        large = scratch.put(large_keys(distinct), "large-variants")
    halves = distinct.select("fp", F.explode(_half_keys()).alias("half"))
    rows = halves.select("fp", F.explode(_variants(F.col("half"))).alias("key"))
    if large is None:
        return rows.select("key", F.lit(0).cast("long").alias("pair"), "fp")
    blocks = F.coalesce("blocks", F.lit(1)).cast("long")
    told = rows.join(large, "key", "left").select("key", "fp", blocks.alias("blocks"))
    mine = told.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    met = mine.select("key", "fp", "mine", F.explode(every).alias("other"))
    high, low = F.greatest("mine", "other"), F.least("mine", "other")
    return met.select("key", (high * (high + 1) / 2).cast("long").alias("pair"), "fp", low.alias("low")).select(
        "key", (F.col("pair") + F.col("low")).alias("pair"), "fp"
    )


def close_groups(fps: np.ndarray) -> np.ndarray:
    """For distinct fingerprints, the smallest index each reaches by links of at most three
    bits. Only what lies outside the largest group found so far is compared with all, so
    that a ball of near-copies costs few comparisons."""
    bits = fps.view(np.uint64)
    root = np.arange(len(fps))
    done = np.zeros(len(fps), bool)
    at = 0
    while True:
        near = np.bitwise_count(bits ^ bits[at]) <= MAX_BITS
        joined = np.unique(root[near])
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
        done[at] = True
        if len(joined) > 1 or at == 0:
            largest = np.bincount(root).argmax()
        rest = np.flatnonzero(~done & (root != largest))
        if not len(rest):
            return root
        at = rest[0]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) links that join up each run of equal (key, pair), from sorted rows."""

    def of_runs(key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        ends = np.r_[starts[1:], len(key)]
        links = []
        two = starts[ends - starts == 2]
        u, v = fp[two], fp[two + 1]
        near = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= MAX_BITS
        links.append(np.stack([u[near], v[near]], axis=1))
        for start, end in zip(starts, ends):
            if end - start > 2:
                run = fp[start:end]
                bit = int(key[start] >> HALF) % (HALF + 1)
                number = int(key[start] >> HALF) // (HALF + 1)
                if bit < HALF:
                    masked = (_halves(run)[number] >> np.uint64(bit)) & np.uint64(1)
                    # All of one side share the whole half, and meet under its own key.
                    if masked.min() == masked.max():
                        continue
                root = close_groups(run)
                moved = root != np.arange(len(run))
                links.append(np.stack([run[moved], run[root[moved]]], axis=1))
        out = np.concatenate(links)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    kept = None
    for batch in batches:
        columns = [batch[c].to_numpy(np.int64) for c in ("key", "pair", "fp")]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns)]
        key, pair = columns[0], columns[1]
        # The last run may go on in the next batch.
        last = np.flatnonzero((key != key[-1]) | (pair != pair[-1])) if len(key) else []
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield of_runs(*(c[:cut] for c in columns))
        kept = [c[cut:] for c in columns]
    if kept is not None and len(kept[0]):
        yield of_runs(*kept)


def close_links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links between the distinct ``fp`` values, enough to connect all that are
    connected by links of at most three bits."""
    met = indexed(distinct, scratch).repartition("key", "pair")
    return met.sortWithinPartitions("key", "pair", "fp").mapInPandas(_links, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (16 hex digits), ``component_id``,
    ``fp`` and ``text_hash``.

    Rows link when their fingerprints differ in at most three bits; ``component_id`` is the
    smallest id reachable by links, the row itself included. Rows without words have the
    fingerprint zero and link like any other. A row without an id takes part; a component
    of such rows alone has a null ``component_id``. Repeated rows give repeated results, an
    empty table an empty one, and other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, id_col, text_col), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    distinct = scratch.put(rows.select("fp").distinct(), "distinct")
    links = scratch.put(close_links(distinct, scratch).distinct(), "links")
    roots = component_roots(links, scratch).withColumnsRenamed({"node": "fp"})
    placed = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Stored, so that Spark can split a hot fingerprint in the join below.
    components = scratch.put(placed.join(least, "root").select("fp", "component_id"), "placed")
    return rows.join(components, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "fp",
        "text_hash",
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component only.

    Where components hold no id at all, one row of each fingerprint stays; rows repeated in
    full count once.
    """
    groups = near_groups(docs, id_col, text_col)
    # Rows that share the smallest id are told apart by their text.
    best = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(
        F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "text_hash")).alias("best")
    )
    return keep_rows(docs, best.select("best.id", "best.text_hash"), id_col, text_col)
