"""Exact and SimHash deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clickfold.llm import exact_dedup, simhash
from clickfold.llm.components import component_roots
from clickfold.llm.scratch import Scratch
from tests.llm.tables import LONG, TEXTS, documents, empty_documents, rows

# --- exact -----------------------------------------------------------------------------


def exact_by_hand(texts):
    groups = {}
    for place, (i, t) in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or "", place))
    out = []
    for body, group in groups.items():
        best = min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0] or 0, g[2]))
        digest = hashlib.sha256(body.encode()).hexdigest()
        for i, t, place in group:
            out.append((i, best[0], len(group), place == best[2], digest))
    return out


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_exact_groups_equal_brute_force(spark, hash_bits):
    got = exact_dedup.exact_groups(documents(spark).coalesce(1), hash_bits=hash_bits)
    want = exact_by_hand(TEXTS)
    assert rows(got, *EXACT) == sorted(
        want, key=lambda r: [(v is not None, str(v)) for v in r]
    )


def test_short_hashes_do_not_merge_texts(spark):
    texts = [(i, "".join(f"{(i * k) % 97} word. " for k in range(400))) for i in range(40)]
    texts += [(100 + i, t + " ") for i, t in texts[:7]]
    got = exact_dedup.exact_groups(documents(spark, texts), hash_bits=2)
    assert {r[2] for r in rows(got, *EXACT)} == {1, 2}
    assert len({r[1] for r in rows(got, *EXACT)}) == 40


def test_chunks_are_the_whole_text(spark):
    texts = [(1, LONG), (2, "a" * 10_000), (3, "b, " * 9_999), (4, "日本語。" * 3_000)]
    chunks = exact_dedup.chunk_rows(documents(spark, texts), "doc_id", "text").collect()
    for i, text in texts:
        mine = sorted((c.pos, c.chunk) for c in chunks if c.id == i)
        assert "".join(c for _, c in mine) == re.sub(r"[ \t-\r]", "", text)
        assert max(len(c) for _, c in mine) <= 4096


def test_chunk_cuts_follow_the_content(spark):
    random = np.random.default_rng(0)
    names = [f"{'abcdefghijklmnopqrstuvwxyz'[i % 26]}o{i}ra" for i in range(500)]
    body = "".join(f"{names[i]} and {names[j]}, " for i, j in random.integers(0, 500, (9_000, 2)))
    chunks = exact_dedup.chunk_rows(
        documents(spark, [(1, body), (2, "Something put in front, " + body)]), "doc_id", "text"
    ).collect()
    one, two = ({c.chunk for c in chunks if c.id == i} for i in (1, 2))
    assert len(one & two) > 0.9 * len(one)


@pytest.mark.parametrize(
    "first, last",
    [(0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939)]
    + [(0xE01, 0xE3A), (0x3041, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF)],
)
def test_chunk_cuts_follow_the_content_in_every_script(spark, first, last):
    places = np.random.default_rng(first).integers(first, last + 1, 60_000)
    body = "".join(map(chr, places))
    docs = documents(spark, [(1, body), (2, "%" + body), (3, body[:20_000] + "%" + body[20_000:])])
    chunks = exact_dedup.chunk_rows(docs, "doc_id", "text").collect()
    own = {i: [c.chunk for c in chunks if c.id == i] for i in (1, 2, 3)}
    assert all(max(len(c.encode()) for c in cut) <= 4096 for cut in own.values())
    assert sum(map(len, own[1])) == len(body)
    for i in (2, 3):
        assert len(set(own[1]) & set(own[i])) > 0.95 * len(own[1])


def test_text_that_is_no_utf8_comes_through_the_chunks(spark):
    docs = spark.sql(
        "SELECT id AS doc_id, CAST(concat(CAST('start' AS BINARY), b) AS STRING) AS text"
        " FROM VALUES (1L, unhex(repeat('BF', 9000))), (2L, unhex(repeat('BF', 9000))),"
        " (3L, unhex(repeat('BFC3', 4500))) AS t(id, b)"
    )
    got = exact_dedup.exact_groups(docs)
    assert rows(got, "doc_id", "keep_id", "group_size") == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_drop_exact_keeps_one_row_and_all_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    want = {(i, best) for i, best, _, keep, _ in exact_by_hand(TEXTS) if keep}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in want)
    assert {r.label for r in kept.collect()} == {"clash"}


def test_exact_on_an_empty_table(spark):
    assert exact_dedup.exact_groups(empty_documents(spark)).count() == 0
    assert exact_dedup.drop_exact(empty_documents(spark)).count() == 0


def test_exact_runs_no_python_on_executors(spark):
    plan = exact_dedup.exact_groups(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- SimHash -----------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_fingerprint_equals_the_plain_definition(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text) % (1 << 64) == fingerprint_by_hand(text)


def test_near_groups_equal_brute_force(spark):
    base = " ".join(f"w{i * 7 % 501}" for i in range(400))
    texts = TEXTS + [(20 + i, base + " tail" * (i % 3) + f" {i}") for i in range(30)]
    got = simhash.near_groups(documents(spark, texts))
    fps = [fingerprint_by_hand(t) for _, t in texts]
    root = groups_by_hand(fps)
    want = []
    for place, (i, _) in enumerate(texts):
        ids = [texts[k][0] for k in range(len(texts)) if root[k] == root[place]]
        want.append((i, f"{fps[place]:016x}", min((x for x in ids if x is not None), default=None)))
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(
        want, key=lambda r: [(v is not None, str(v)) for v in r]
    )


def _near_fingerprints(n, seed):
    random = np.random.default_rng(seed)
    centres = random.integers(0, 1 << 63, 5, dtype=np.int64)
    fps = set()
    while len(fps) < n:
        fp = int(centres[random.integers(5)])
        for _ in range(random.integers(0, 7)):
            fp ^= 1 << int(random.integers(63))
        fps.add(fp)
    return np.array(sorted(fps), np.int64)


@pytest.mark.parametrize("block", [4096, 5])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = _near_fingerprints(300, 3)
    distinct = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    scratch = Scratch(spark, "test")
    roots = component_roots(simhash.close_links(distinct, scratch).distinct(), scratch)
    found = {r.node: r.root for r in roots.collect()}
    want = groups_by_hand([int(f) for f in fps])
    got = [found.get(int(f), int(f)) for f in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_large_variants_are_worked_on_in_blocks(spark, monkeypatch):
    """One half with ten times the rows of a block, and its neighbours by one bit."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    random = np.random.default_rng(9)
    low = random.choice(1 << 32, 500, replace=False).astype(np.int64)
    high = np.where(np.arange(500) < 420, 77, 77 ^ (1 << 5)).astype(np.int64)
    fps = (high << 32) | low
    distinct = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    rows = simhash.indexed(distinct, Scratch(spark, "test")).toPandas()
    runs = rows.groupby(["key", "pair"]).size()
    # Two blocks meet at a time; dealt by hash, a block may be somewhat over its mean.
    assert runs.max() <= 3 * 50 and rows["pair"].max() >= 40
    # Every two fingerprints that share a variant meet under it.
    by_run = rows.groupby(["key", "pair"])["fp"].agg(set)
    whole = ((0 * 33 + 32) << 32) + 77
    mine = [m for (key, _), m in by_run.items() if key == whole]
    some = fps[:420:37].tolist()
    assert all(any({a, b} <= m for m in mine) for a in some for b in some)
    masked = ((0 * 33 + 5) << 32) + (77 | 1 << 5)
    mine = [m for (key, _), m in by_run.items() if key == masked]
    assert all(any({a, b} <= m for m in mine) for a in some for b in fps[420::17].tolist())


def test_close_groups_equal_brute_force():
    for seed in range(20):
        fps = _near_fingerprints(60, seed)
        got = simhash.close_groups(fps).tolist()
        want = groups_by_hand([int(f) for f in fps])
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_drop_near_keeps_the_smallest_id_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    # 1 = 6 but for case and blanks; 2, 3 and 4 have no words.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["1", "2", "5", "7", "8", "None", "9", "10", "11", "12"]
    )


def test_simhash_on_an_empty_table(spark):
    assert simhash.near_groups(empty_documents(spark)).count() == 0
    assert simhash.drop_near(empty_documents(spark)).count() == 0


# --- components ----------------------------------------------------------------------------


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)]
    edges += [(500, k) for k in range(501, 560)] + [(7, 3), (3, 9), (9, 7), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in component_roots(table, Scratch(spark, "test")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}}
    assert roots == {**want, 3: 3, 7: 3, 9: 3}
