"""Exact duplicates by content-defined chunk recipes, with built-in functions only.

Every text, freed of white space, is cut where its content says so. The distinct chunks get
verified identifiers, and two texts are equal when their ordered identifier lists are. Chunk
contents are shuffled once, after removing copies within each task; all later steps move
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch

#: White space that does not count: blank and the controls from tab to carriage return.
BLANKS = r"[ \t-\r]+"


def _chunk_pattern() -> str:
    """A chunk, as a pattern over a text's UTF-8 bytes, each written as one character.

    It ends after at least 256 bytes between two characters of which the first ends in one
    eighth of all possible last bytes and the second in another, or after about 4096 bytes where
    there is no such place. Last bytes vary in every script, so that the place depends on what
    stands there, and texts that differ early are soon cut alike again. The further
    alternatives take any byte, so that the chunks of a text are always the whole text; whole
    characters stay together wherever the text is valid UTF-8.
    """

    def lasts(low: int, high: int, *sixteenths: int) -> str:
        return "".join(f"\\x{b:02x}" for b in range(low, high) if b % 16 in sixteenths)

    before = lasts(0x00, 0xC0, 5, 14)
    ascii_, later = lasts(0x00, 0x80, 0, 13), lasts(0x80, 0xC0, 0, 13)
    after = (
        f"[{ascii_}]|[\\xc0-\\xdf][{later}]|[\\xe0-\\xef].[{later}]|[\\xf0-\\xff]..[{later}]"
    )
    return (
        rf"(?s).{{256,4095}}?(?<=[{before}])(?={after})"
        r"|.{1,4093}(?![\x80-\xbf])|.{1,4096}"
    )


CHUNK = _chunk_pattern()
#: The charset that writes every byte as the character of its number.
BYTES = "ISO-8859-1"


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: ``row`` (the input row), ``id``, ``n_chars`` (of the original
    text), ``text_hash`` (of the original text), ``sha256`` (of the normalised text),
    ``pos``, ``h`` and ``chunk``. An empty text has one row without a chunk."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("text_hash"),
        F.regexp_replace(text, BLANKS, "").alias("plain"),
    )
    as_bytes = F.decode(F.col("plain").cast("binary"), BYTES)
    cut = plain.select(
        "row",
        "id",
        "n_chars",
        "text_hash",
        F.sha2("plain", 256).alias("sha256"),
        F.posexplode_outer(F.regexp_extract_all(as_bytes, F.lit(CHUNK), F.lit(0))).alias(
            "pos", "chunk"
        ),
    ).withColumn("chunk", F.encode("chunk", BYTES).cast("string"))
    return cut.withColumn("h", F.when(F.col("chunk").isNotNull(), F.xxhash64("chunk")))


def _hash(hash_bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - hash_bits)


def identified(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """``chunks`` without content, with ``chunk_id``: equal for equal contents only.

    The identifier is the chunk's hash and a rank. The rank is 0 wherever all contents with
    this hash are equal, which comparing the distinct contents verifies. Contents that share
    a hash are ranked in order and their chunks find the rank by content.
    """
    distinct = chunks.filter(F.col("chunk").isNotNull()).select("h", "chunk").distinct()
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    shared = scratch.put(shared, "shared-hashes")
    if shared.isEmpty():
        return chunks.drop("chunk").withColumn("rank", F.lit(0).cast("long"))
    rival = distinct.join(shared, "h", "left_semi")
    in_order = Window.partitionBy("h").orderBy("chunk")
    ranks = rival.withColumn("rank", (F.row_number().over(in_order) - 1).cast("long"))
    ranked = chunks.join(ranks, ["h", "chunk"], "left").drop("chunk")
    return ranked.withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64
) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``,
    ``n_chars`` and ``text_hash`` (the last two of the original text).

    Texts are equal when identical without white space; a null text counts as empty. Of
    equal texts the row with the most code points stays, then the one with the smallest id;
    a row without an id loses such a tie. Of rows repeated in full, id included, exactly one
    is kept. An empty table gives an empty result; other columns of ``docs`` are not read.

    ``hash_bits`` shortens the chunk hashes, to test that shared hashes are told apart.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    chunks = chunk_rows(docs, id_col, text_col).withColumn("h", _hash(hash_bits))
    chunks = scratch.put(chunks, "chunks")
    recipes = (
        identified(chunks, scratch)
        .groupBy("row")
        .agg(
            *(F.first(c).alias(c) for c in ("id", "n_chars", "text_hash", "sha256")),
            F.sort_array(F.collect_list(F.struct("pos", "h", "rank"))).alias("list"),
        )
        # An empty text's only element has no position and no hash.
        .withColumn("recipe", F.transform("list", lambda c: F.struct(c["h"], c["rank"])))
        .drop("list")
    )
    recipes = scratch.put(recipes, "recipes")
    scratch.drop("chunks")
    best = F.struct("n_chars", (-F.col("id")).alias("id"), (-F.col("row")).alias("row"))
    groups = recipes.groupBy("recipe").agg(
        F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    # A group of any size is one row on the right. With both sides stored, nothing but the
    # exchange stands below the join, and Spark splits a hot recipe on the left.
    groups = scratch.put(groups, "groups")
    return recipes.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        (-F.col("best.id")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "n_chars",
        "text_hash",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies, as :func:`exact_groups` keeps them."""
    kept = exact_groups(docs, id_col, text_col).filter("kept")
    return keep_rows(docs, kept.select(F.col(id_col), "text_hash"), id_col, text_col)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (id, text_hash): one of each, with all columns.

    Rows of one id and one text are the same document and give one row. Both steps are keyed
    by the same three columns, so that a document moves once.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    keys = ["key_id", "key_null", "key_hash"]

    def keyed(df: DataFrame, row_id: Column, text_hash: Column, *rest: Column) -> DataFrame:
        # Plain equality in place of a null-safe one, whose expressions would be dealt anew.
        no_id = row_id.isNull()
        return df.select(
            F.when(no_id, F.lit(0)).otherwise(row_id).alias("key_id"),
            no_id.alias("key_null"),
            text_hash.alias("key_hash"),
            *rest,
        )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns)))
    held = keyed(docs, F.col(id_col), F.xxhash64(text), row.alias("held"))
    wanted = kept.toDF("want_id", "want_hash")
    wanted = keyed(wanted, F.col("want_id"), F.col("want_hash")).distinct()
    one = held.join(wanted, keys, "left_semi").dropDuplicates(keys)
    return one.select(*(F.col(f"held.{n}").alias(c) for c, n in zip(docs.columns, columns)))
