"""License scans against SQL and by hand."""

import re

import duckdb

from clickfold.llm import licenses
from clickfold.llm.queries import LLM_ORACLES
from tests.llm.tables import TEXTS, documents, empty_documents, rows

COLUMNS = (
    "doc_id n_words n_base first_word last_word base_labels labels score".split()
)


def by_hand(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for label, phrase in licenses.BASE_PHRASES:
        phrase = phrase.split()
        places += [
            (i, label)
            for i in range(len(words))
            if words[i : i + len(phrase)] == phrase
        ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), labels)


EXTRA = [
    (30, "Apache license, version 2. CC-BY-NC and under-the-MIT-license"),
    (31, "the K under the mıt license; under the MIT\x00license"),
    (32, "GNU General Public License, really, version 3"),
    (33, "Permission is hereby granted, free of charge, to every person obtaining a copy of this "
         "software and associated documentation files"),
    (34, "gnu general public " * 50),
    (35, "This program: GNU Affero General Public License version 3"),
]


def test_base_columns_equal_brute_force(spark):
    texts = TEXTS + EXTRA
    got = rows(licenses.scan_licenses(documents(spark, texts)), *COLUMNS[:6])
    want = [(i, *by_hand(t)) for i, t in texts]
    assert got == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])


def test_whole_result_equals_sql(spark):
    texts = TEXTS + EXTRA
    got = rows(licenses.scan_licenses(documents(spark, texts)), *COLUMNS)
    duck = duckdb.connect()
    documents_ = documents(spark, texts, clashes=False).toPandas()
    duck.register("documents", documents_)
    want = duck.execute(
        f"SELECT {', '.join(COLUMNS)} FROM ({LLM_ORACLES['op1_license_scan']})"
    ).fetchall()
    assert got == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])


def test_notices_are_found_with_words_changed(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, EXTRA)).collect()}
    assert got[33].labels == "mit" and got[33].base_labels == ""
    assert got[33].score == 15 / 18
    assert got[34].labels == ""
    assert got[35].labels == "agpl-3"
    span = got[35].spans[0]
    assert (span.label, span.first_word, span.end_word) == ("agpl-3", 2, 9)


def test_empty_table(spark):
    assert licenses.scan_licenses(empty_documents(spark)).count() == 0


def test_no_python_on_executors_and_one_scan(spark):
    plan = licenses.scan_licenses(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("PythonUDF|Pandas|Arrow|BatchEval", plan)
    assert plan.count("BroadcastHashJoin") == 1
