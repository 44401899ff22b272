"""Hard negatives by a secondary sort of pair scores.

Scores of an anchor with other rows are packed into byte keys whose order is (anchor,
descending score, id). ``repartitionAndSortWithinPartitions`` deals them out by anchor and sorts
them, spilling where it must; an iterator then reads each anchor's scores once, opens a window
at every positive and emits the negatives that fall into it, holding five windows and no list.

Only scores that can matter are packed. Rows are dealt into strips of bounded size; a strip
scores every anchor with all its rows and sends on its best positives, then, once an anchor's
positives are known, its best negatives of each window.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch
from clickfold.llm.whole_vectors import exact_type, is_whole, largest, matrix, scaled

ANCHORS_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this many hundredths of the positive, and at most all of it.
LEAST_SHARE = 80
#: Rows of a strip: what one task holds at a time.
STRIP = 1 << 17
#: Scores held at a time.
SCORES = 1 << 23

_KEY = ">QQQBQQ"
_SIGN = 1 << 63
_SCORED = "anchor long, anchor_id long, negative boolean, score long, vec_id long, row long"


# --- scores within a strip ---------------------------------------------------------------


class Strip:
    """Rows in the order (label, vec_id, row), so that a label is one slice and, within it, an
    earlier place wins a tie."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((row, vec_id, label))
        self.row, self.vec_id, self.label = row[order], vec_id[order], label[order]
        self.x, self.largest = x[order], largest(x)
        self.cast: dict[type, np.ndarray] = {}

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, (anchors, rows); missing components count as zero."""
        width = min(anchors.shape[1], self.x.shape[1])
        kind = exact_type(width * self.largest * largest(anchors))
        if kind not in self.cast:
            self.cast = {kind: self.x.astype(kind)}
        return anchors[:, :width].astype(kind) @ self.cast[kind][:, :width].T

    def _first(self, scores: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """The n places with the highest scores, smaller (vec_id, row) first on a tie."""
        if len(places) > n:
            cut = np.partition(scores[places], len(places) - n)[len(places) - n]
            above, tied = places[scores[places] > cut], places[scores[places] == cut]
            if len(tied) > n:
                tied = tied[np.lexsort((self.row[tied], self.vec_id[tied]))[: n - len(above)]]
            places = np.concatenate([above, tied])
        order = np.lexsort((self.row[places], self.vec_id[places], -scores[places].astype(np.int64)))
        return places[order[:n]]

    def positives(self, scores: np.ndarray, label: int, row: int, n: int) -> np.ndarray:
        """Places of the n best rows of the label other than the anchor's own."""
        places = np.arange(*np.searchsorted(self.label, [label, label + 1]))
        return self._first(scores, places[self.row[places] != row], n)

    def negatives(self, scores: np.ndarray, label: int, windows: Iterable[int], n: int) -> np.ndarray:
        """Places that are among the n best of another label in any of the windows, each given
        by its positive's score."""
        begin, end = np.searchsorted(self.label, [label, label + 1])
        found = []
        for top in sorted(set(windows)):
            # 80 p <= 100 s, in whole numbers; scores are exact in any type.
            least = -(-LEAST_SHARE * top // 100)
            if least > top:
                continue
            inside = np.flatnonzero((scores >= least) & (scores <= top))
            found.append(self._first(scores, inside[(inside < begin) | (inside >= end)], n))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _columns(batch: pa.RecordBatch, at: slice) -> list[np.ndarray]:
    part = batch.slice(at.start, at.stop - at.start)
    numbers = [part.column(c).to_numpy() for c in ("row", "vec_id", "label")]
    return [*numbers, matrix(part.column("q"))]


def _stack(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    width = max(p[3].shape[1] for p in parts)
    parts = [[*p[:3], np.pad(p[3], ((0, 0), (0, width - p[3].shape[1])))] for p in parts]
    return [np.concatenate(c) for c in zip(*parts)]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, slice]]:
    """(strip, whether anchors, slice) of the runs in a sorted batch."""
    strip, probe = batch.column("strip").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, (strip[1:] != strip[:-1]) | (probe[1:] != probe[:-1])])
    for a, b in zip(starts, [*starts[1:], len(strip)]):
        yield strip[a], bool(probe[a]), slice(a, b)


def _score_strips(windowed: bool):
    """Per strip, its rows and then all anchors stream by; the best pairs come out."""

    def of_anchors(strip: Strip, batch: pa.RecordBatch, at: slice) -> Iterator[pa.RecordBatch]:
        row, vec_id, label, x = _columns(batch, at)
        windows = batch.column("windows").slice(at.start, at.stop - at.start).to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        step = max(1, SCORES // len(strip.row))
        for start in range(0, len(row), step):
            for i, scores in enumerate(strip.scores(x[start : start + step]), start):
                if windowed:
                    places = strip.negatives(scores, label[i], windows[i], NEGATIVES)
                else:
                    places = strip.positives(scores, label[i], row[i], POSITIVES)
                out[0].append(np.full(len(places), row[i]))
                out[1].append(np.full(len(places), vec_id[i]))
                out[2].append(scores[places].astype(np.int64))
                out[3].append(strip.vec_id[places])
                out[4].append(strip.row[places])
        anchor, anchor_id, score, other, other_row = (pa.array(np.concatenate(o), pa.int64()) for o in out)
        kind = pa.array(np.full(len(anchor), windowed))
        yield pa.RecordBatch.from_arrays(
            [anchor, anchor_id, kind, score, other, other_row],
            [c.split()[0] for c in _SCORED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, strip = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for now, probe, at in _runs(batch):
                if now != number:
                    held, number, strip = [], now, None
                if not probe:
                    held.append(_columns(batch, at))
                elif held or strip:
                    if strip is None:
                        strip, held = Strip(*_stack(held)), []
                    yield from of_anchors(strip, batch, at)

    return run


# --- the secondary sort --------------------------------------------------------------------


def pack(anchor: int, anchor_id: int, negative: bool, score: int, vec_id: int, row: int) -> bytes:
    """A key whose byte order is (anchor, score descending, positives first, id)."""
    return struct.pack(
        _KEY, anchor, anchor_id + _SIGN, _SIGN - 1 - score, negative, vec_id + _SIGN, row
    )


def unpack(key: bytes) -> tuple[int, int, bool, int, int, int]:
    anchor, anchor_id, score, negative, vec_id, row = struct.unpack(_KEY, key)
    return anchor, anchor_id - _SIGN, bool(negative), _SIGN - 1 - score, vec_id - _SIGN, row


def windows_of(keys: Iterable[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from sorted
    keys. Held are the open windows of one anchor: [positive id, its score, negatives so far]."""
    now, opened, windows = None, 0, []
    for key in keys:
        anchor, anchor_id, negative, score, vec_id, _ = unpack(key)
        if anchor != now:
            now, opened, windows = anchor, 0, []
        if not negative:
            if opened < POSITIVES:
                opened += 1
                windows.append([vec_id, score, 0])
            continue
        # Scores only fall, so a window that this one is below, or that is full, is done.
        windows = [w for w in windows if w[2] < NEGATIVES and LEAST_SHARE * w[1] <= 100 * score]
        for window in windows:
            if score <= window[1]:
                window[2] += 1
                yield anchor_id, window[0], window[2], vec_id, window[1], score


def _anchor_partition(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine_hard_negatives(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by 100, scores whole inner products of
    floor(256 * x). A null id, label or vector, or a null or non-finite component leaves a row
    out. Vectors of different length compare as if the shorter ended in zeros; components of
    2^19 or more are refused. Every row counts: a repeated row is another row with the same id,
    as a candidate and as an anchor, and such ties are broken by the order of reading. Negative
    positives have no window. An anchor without positives or negatives gives no row, an empty
    table an empty result; other columns are not read.

    A set of queries, 1 % of the rows, meets all rows, which are dealt into strips evenly by
    row number, whatever their label or vector. A strip sends five positives and five negatives
    per window and anchor at most, so the sort takes some dozen keys per anchor and strip.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "negatives")
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    moved = F.when(vec_id % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    wanted = vec_id.isNotNull() & label.isNotNull() & is_whole(F.col(vector_col))
    plain = embeddings.filter(wanted).select(
        F.monotonically_increasing_id().alias("row"),
        vec_id.alias("vec_id"),
        moved.alias("label"),
        scaled(F.col(vector_col)).alias("q"),
    )
    # Stored, since row numbers hold for one reading only.
    rows = scratch.put(plain, "rows")
    workers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = max(rows.count() // STRIP + 1, workers)
    empty = F.array().cast("array<long>")
    dealt = rows.withColumns(
        {"strip": F.pmod(F.xxhash64("row"), F.lit(strips)), "probe": F.lit(False), "windows": empty}
    )
    anchors = rows.filter(F.col("vec_id") % ANCHORS_EVERY == 0)

    def scored(probes: DataFrame, windowed: bool) -> DataFrame:
        everywhere = probes.withColumns(
            {
                "strip": F.explode(F.sequence(*(F.lit(n).cast("long") for n in (0, strips - 1)))),
                "probe": F.lit(True),
            }
        )
        both = dealt.unionByName(everywhere).repartition(strips, "strip")
        return both.sortWithinPartitions("strip", "probe").mapInArrow(
            _score_strips(windowed), _SCORED
        )

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = scored(anchors.withColumn("windows", empty), False)
    top = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= POSITIVES).drop("n")
    positives = scratch.put(top, "positives")
    of_anchor = positives.groupBy("anchor").agg(F.collect_list("score").alias("windows"))
    probes = anchors.join(of_anchor.withColumnRenamed("anchor", "row"), "row")
    negatives = scratch.put(scored(probes, True), "negatives")

    keys = positives.unionByName(negatives).rdd.map(lambda r: (pack(*r), None))
    ordered = keys.repartitionAndSortWithinPartitions(workers, _anchor_partition)
    emitted = ordered.mapPartitions(lambda pairs: windows_of(key for key, _ in pairs))
    return spark.createDataFrame(
        emitted,
        "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long",
    )


SQL = f"""
WITH v AS (
  SELECT vec_id,
         CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % {ANCHORS_EVERY} = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                               ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND {LEAST_SHARE} * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
