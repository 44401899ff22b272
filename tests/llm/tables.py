"""Small tables with the awkward cases every operator has to take."""

from pyspark.sql import functions as F

# Names the operators use inside, as columns of the input.
CLASHES = (
    "row id n_chars text_hash plain sha256 pos chunk h rank recipe fp key pair words word gram "
    "template label diagonal kind start end found ids length part sequence_id x y fits score "
    "held held_out predicted host path rule verdict html_ mix parts v size links c0 c1 key_id"
).split()

LONG = "long words go on and on without end " * 20_000
TEXTS = [
    (1, "Released under the MIT License. token = abcdefgh"),
    (1, "Released under the MIT License. token = abcdefgh"),
    (2, ""),
    (3, None),
    (4, " \t\n\x0b\x0c\r "),
    (5, LONG),
    (6, "released  under the mit license. token = abcdefgh "),
    (7, "x"),
    (8, "two words"),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (9, "ünï ſecret Kelvin K 　 \U0001f600 日本語"),
    (10, LONG + "!"),
    (11, "x" * 50_000),
    (12, "under the mit license under the mit license"),
]


def documents(spark, rows=TEXTS, clashes=True):
    """documents with the given (doc_id, text) rows."""
    full = [(i, t, "en", None if i is None else f"src{i % 3}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long"
    )
    if clashes:
        docs = docs.withColumns({c: F.lit("clash") for c in CLASHES if c not in docs.columns})
    return docs


def empty_documents(spark):
    return documents(spark, []).limit(0)


def rows(df, *columns):
    """Collected rows as tuples, in a fixed order."""
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=lambda r: [(v is not None, str(v)) for v in r])
