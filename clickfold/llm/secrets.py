"""Secret scans with multipart credential linking.

Tasks scan the texts for parts of credentials: access identifiers, secrets and endpoints. Some
kinds are secrets in themselves; the weak ones (a login name, a key-like word, a host) are
reported only where an interval join finds the complementary parts close by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch

#: Parts with at most this many code points between them belong together.
SCOPE = 200

# The kinds that always count.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LENGTH = 6
# Runs are maximal, so a run is long enough wherever any match inside it is.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

# The weak kinds. A key-like word is a whole run, however long, in either base64 alphabet, and
# has letters of both cases and digits.
LOGIN = re.compile(
    r"""\b(?:user(?:name)?|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+""",
    re.IGNORECASE | re.ASCII,
)
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
KEY_PARTS = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?")

#: What each kind is evidence of, and what a weak kind needs beside it.
ROLES = {
    "assign": "secret",
    "access": "identifier",
    "hex": "secret",
    "login": "identifier",
    "key": "secret",
    "endpoint": "endpoint",
}
NEEDS = {
    "login": ("secret",),
    "key": ("identifier",),
    "endpoint": ("identifier", "secret"),
}
ORDER = (*BASE_KINDS, *NEEDS)


def base_parts(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the kinds that always count, in code points."""
    parts = [
        ("assign", m.start(), m.end())
        for m in ASSIGN.finditer(text)
        if len(m.group(2)) >= ASSIGN_LENGTH
    ]
    parts += [("access", *m.span()) for m in ACCESS.finditer(text)]
    parts += [("hex", *m.span()) for m in HEX.finditer(text)]
    return parts


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates that overlap no base part."""
    found = [("login", *m.span()) for m in LOGIN.finditer(text)]
    found += [
        ("key", *m.span())
        for m in KEY.finditer(text)
        if all(part.search(m.group()) for part in KEY_PARTS)
    ]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not found:
        return []
    taken = sorted((start, end) for _, start, end in base)
    free, at, reach = [], 0, -1
    for kind, start, end in sorted(found, key=lambda p: p[1]):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if start >= reach:
            free.append((kind, start, end))
    return free


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row, doc, text_hash, text in batch.itertuples(index=False, name=None):
            doc = None if pd.isna(doc) else int(doc)
            base = base_parts(text)
            parts = [*base, *weak_parts(text, base)] or [(None, None, None)]
            rows += [(row, doc, text_hash, *part) for part in parts]
        out = pd.DataFrame(rows, columns=["row", "id", "text_hash", "kind", "start", "end"])
        for column in ("row", "id", "text_hash", "start", "end"):
            out[column] = pd.array(out[column].tolist(), dtype="Int64")
        yield out


def parts_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per part, or one without a kind for a document that has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    schema = "row long, id long, text_hash long, kind string, start long, end long"
    return slim.mapInPandas(_scan, schema)


def _by_kind(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("kind")]


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts that have each complementary part at most :data:`SCOPE` before or behind.

    An equality join on document, role and stretch of text, with the interval as condition.
    A weak part asks in the stretches from one before its start to one behind its end; any other
    answers where it starts and where it ends. Each role is answered at most once a stretch,
    however many parts lie there.
    """

    def bucket(column: str) -> Column:
        return F.floor(F.col(column) / SCOPE)

    needs = F.create_map(
        *(x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*(F.lit(r) for r in v))))
    )
    asking = (
        parts.filter(F.col("kind").isin(*NEEDS))
        .withColumn("needed", needs[F.col("kind")])
        .withColumn("role", F.explode("needed"))
        .withColumn("bucket", F.explode(F.sequence(bucket("start") - 1, bucket("end") + 1)))
    )
    ends = F.array_distinct(F.array(bucket("start"), bucket("end")))
    offering = parts.filter(F.col("kind").isNotNull()).select(
        F.col("row").alias("o_row"),
        _by_kind(ROLES).alias("o_role"),
        F.explode(ends).alias("o_bucket"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
    )
    behind = F.col("o_start") - F.col("end")
    before = F.col("start") - F.col("o_end")
    near = (
        (F.col("row") == F.col("o_row"))
        & (F.col("role") == F.col("o_role"))
        & (F.col("bucket") == F.col("o_bucket"))
        & (behind.between(0, SCOPE) | before.between(0, SCOPE))
    )
    answered = asking.join(offering, near, "left_semi")
    return (
        answered.groupBy(*parts.columns, "needed")
        .agg(F.count_distinct("role").alias("roles"))
        .filter(F.col("roles") == F.size("needed"))
        .select(*parts.columns)
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``n_assign``, ``n_access``, ``n_hex``, ``found`` (an
    array of start, place of the kind in the order, kind, end) by start and then kind, and
    ``text_hash``.

    A null or empty text has no parts and an empty list; repeated rows give repeated results,
    an empty table an empty one. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    parts = scratch.put(parts_table(docs, id_col, text_col), "parts")
    weak = F.col("kind").isin(*NEEDS)
    # A document whose weak parts all fall away still has its row.
    kept = parts.withColumn("kind", F.when(~weak, F.col("kind"))).unionByName(linked(parts))
    order = _by_kind({kind: i for i, kind in enumerate(ORDER)})
    part = F.when(
        F.col("kind").isNotNull(), F.struct("start", order.alias("order"), "kind", "end")
    )
    return kept.groupBy("row", "id", "text_hash").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE_KINDS),
        F.sort_array(F.collect_list(part)).alias("found"),
    ).select(F.col("id").alias(id_col), *(f"n_{k}" for k in BASE_KINDS), "found", "text_hash")


def as_text(found: str | Column) -> Column:
    """kind:start:end of each part, comma-joined."""
    one = F.transform(found, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"]))
    return F.array_join(one, ",")


def mask(text: str, spans: list[tuple[int, int]], sign: str = "[SECRET]") -> str:
    """``text`` with each stretch covered by spans replaced by the sign."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], sign]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in the text replaced; all rows and columns stay.

    Only documents that hold secrets are matched with their parts, by id and text.
    """
    scanned = scan_secrets(docs, id_col, text_col).filter(F.size("found") > 0)
    spans = scanned.select(
        F.col(id_col).alias("want_id"),
        F.col("text_hash").alias("want_hash"),
        F.transform("found", lambda p: p["start"]).alias("starts"),
        F.transform("found", lambda p: p["end"]).alias("ends"),
    ).dropDuplicates(["want_id", "want_hash"])
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)),
        F.col(id_col).alias("key_id"),
        F.xxhash64(text).alias("key_hash"),
    )
    same = F.col("key_id").eqNullSafe(F.col("want_id")) & (F.col("key_hash") == F.col("want_hash"))
    joined = held.join(spans, same, "left")

    @F.pandas_udf("string")
    def masked(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series(
            [t if s is None else mask(t, list(zip(s, e))) for t, s, e in zip(text, starts, ends)],
            dtype=object,
        )

    place = docs.columns.index(text_col)
    new = joined.withColumn(names[place], masked(F.col(names[place]), "starts", "ends"))
    return new.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
