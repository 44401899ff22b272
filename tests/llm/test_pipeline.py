"""The pipeline against its stages done by hand, and the registered queries."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from clickfold.llm import quality, secrets, simhash
from clickfold.llm.queries import LLM_ORACLES
from tests.conftest import SF_DIR
from tests.llm.tables import TEXTS, documents, empty_documents

SMALL = "/root/testdata/sf0.001"


def _stages(spark, docs, sf_dir, tmp_path):
    made = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(number))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        made.append(docs)
    return made


def test_stages_by_hand(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = _stages(spark, docs, SMALL, tmp_path)
    for stage in made[:-1]:
        assert stage.schema.simpleString() == docs.schema.simpleString()
    before = {r.doc_id: r for r in docs.collect()}

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = quality.score_documents(docs, labels).collect()
    good = {r.doc_id for r in scored if r.predicted == 1}
    assert {r.doc_id for r in made[0].collect()} == good

    groups = {}
    for i in good:
        text = before[i].text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    exact = {min(g)[1] for g in groups.values()}
    assert {r.doc_id for r in made[1].collect()} == exact

    ids = sorted(exact)
    fps = [simhash.fingerprint(before[i].text) % (1 << 64) for i in ids]
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    near = {ids[r] for r in root}
    assert {r.doc_id for r in made[2].collect()} == near

    masked = {r.doc_id: r for r in made[3].collect()}
    assert set(masked) == near
    for i in near:
        text = before[i].text
        parts = secrets.base_parts(text)
        if not secrets.weak_parts(text, parts):
            assert masked[i].text == secrets.mask(text, [(s, e) for _, s, e in parts])
        assert masked[i].n_chars == len(masked[i].text)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in made[4].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == near
    for i, parts in pieces.items():
        tokens = np.array(
            library.encode(masked[i].text, add_special_tokens=False).ids + [1], "<u4"
        )
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(tokens)
            assert r.ids_crc32 == zlib.crc32(tokens[at : at + r.length].tobytes())
            at += r.length
        assert at == len(tokens)


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = _stages(spark, docs, SMALL, tmp_path)[-1]
    got = corpus_pipeline.run(spark, SMALL)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(
        map(tuple, made.select(*columns).collect())
    )


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    made = _stages(spark, documents(spark).drop("predicted"), SMALL, tmp_path)
    assert made[0].columns == documents(spark).drop("predicted").columns
    assert len({r.doc_id for r in made[-1].collect()}) <= len({i for i, _ in TEXTS})
    assert made[-1].count() > 0
    assert _stages(spark, empty_documents(spark), SMALL, tmp_path / "empty")[-1].count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_registered_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = __spark_entry__.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    ours = sorted((tuple(r) for r in result.select(*columns).collect()), key=str)
    theirs = duck.execute(
        f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})"
    ).fetchall()
    assert ours == sorted(theirs, key=str)


def test_every_operator_is_registered_once():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names


@pytest.mark.parametrize("number", range(2, 9))
def test_registered_queries_return_a_row_per_input(spark, number):
    name = next(n for n in __spark_entry__.queries() if n.startswith(f"op{number}_"))
    table = {3: "pages", 8: "pages", 5: "embeddings"}.get(number, "documents")
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    result = __spark_entry__.queries()[name](spark, SMALL)
    source = spark.read.parquet(f"{SMALL}/{table}.parquet")
    assert result.select(F.countDistinct(key)).first()[0] == source.count()
