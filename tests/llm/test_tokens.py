"""Byte-level BPE and packing against the public tokenizer libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickfold.llm import byte_bpe, packing
from tests.llm.tables import LONG, TEXTS, documents, empty_documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)


def test_queue_pops_in_rank_then_place_order():
    queue = byte_bpe.RankQueue()
    entries = [(70_000, 5), (3, 9), (3, 2), (1023, 1), (1024, 1), (3, 7), (0, 0)]
    for rank, place in entries:
        queue.push(rank, place)
    got = [queue.pop() for _ in entries]
    assert got == sorted(entries) and queue.pop() is None
    queue.push(5, 5)
    assert queue.pop() == (5, 5) and queue.pop() is None


_DRAWN = st.text() | st.lists(
    st.sampled_from(["a", "aa", "the", " ", "\n", "é", "日", "\U0001f600", "1", "'s", "ing"]),
    max_size=40,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(_DRAWN)
def test_encoding_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    bpe, library = _both()
    ids = bpe.encode(text)
    assert ids == library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


_MADE = []


def _both():
    if not _MADE:
        ranks = byte_bpe.read_ranks(RANKS)
        _MADE.append(byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN))
        _MADE.append(
            tiktoken.Encoding(
                "own",
                pat_str=public_tokenizers.PATTERN,
                mergeable_ranks=ranks,
                special_tokens={},
            )
        )
    return _MADE


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_999, "é" * 5_000, "日本語" * 4_000, "=" * 9_999])
def test_long_pre_tokens(bpe, library, text):
    assert bpe.encode(text) == library.encode_ordinary(text)


def test_documents_are_encoded_whole(spark, library):
    args = (RANKS, public_tokenizers.PATTERN)
    full = byte_bpe.encode_documents(documents(spark), *args).collect()
    short = byte_bpe.encode_documents(documents(spark), *args, digests=True).collect()
    assert len(full) == len(short) == len(TEXTS)
    texts = {i: t or "" for i, t in TEXTS}
    for a, b in zip(full, short):
        text = texts[a.doc_id]
        assert list(a.ids) == library.encode_ordinary(text)
        assert bytes(a.decoded) == text.encode()
        assert a.n_tokens == b.n_tokens == len(a.ids)
        assert b.ids_sha256 == hashlib.sha256(",".join(map(str, a.ids)).encode()).hexdigest()
        assert b.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_documents(empty_documents(spark), *args).count() == 0


def test_memo_limit_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    small = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    text = "many different words and numbers 1 22 333 " * 3
    assert small.encode(text) == library.encode_ordinary(text)


# --- packing ---------------------------------------------------------------------------------


def first_fit_by_hand(lengths, room):
    free, bins = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, left in enumerate(free):
            if left >= lengths[i]:
                break
        else:
            b = len(free)
            free.append(room)
        free[b] -= lengths[i]
        bins[i] = b
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_tournament_tree_is_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 50)
    assert bins == first_fit_by_hand(lengths, 50)
    for b in set(bins):
        mine = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()
        assert sum(n for _, n in mine) <= 50


@settings(max_examples=300, deadline=None)
@given(_DRAWN)
def test_word_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode() + " <|endoftext|> Ünder\t'S"
    if not _WORD:
        _WORD.extend([packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)])
    own, library = _WORD
    want = library.encode(text, add_special_tokens=False).ids
    (got,) = own.encode_all([text])
    assert np.frombuffer(got, "<u4").tolist() == want


_WORD = []


def test_pieces_hold_every_id_once(spark):
    texts = TEXTS + [(100 + i, "some words here " * (i * 40 + 1)) for i in range(40)]
    full = packing.pack_documents(documents(spark, texts), WORDS).collect()
    short = packing.pack_documents(documents(spark, texts), WORDS, digests=True).collect()
    assert len(full) == len(short)
    library = Tokenizer.from_file(WORDS)
    want = sorted(
        tuple([*library.encode(t or "", add_special_tokens=False).ids, packing.END])
        for _, t in texts
    )
    whole = {}
    sequences = {}
    for r in full:
        assert 1 <= r.length <= packing.LENGTH and len(r.ids) == r.length
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = []
    for (i, n), parts in whole.items():
        copies = sum(1 for s, _ in parts if s == 0)
        joined = sum((ids for _, ids in sorted(set(parts))), ())
        assert len(joined) == n
        got += [joined] * copies
    assert sorted(got) == want
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= packing.LENGTH
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in short}
    for r in full:
        assert sums[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_groups_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    texts = [(i, "word " * (i % 37 * 30)) for i in range(100)]
    got = packing.pack_documents(documents(spark, texts), WORDS, digests=True).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 5
    assert sum(r.length for r in got) == sum(i % 37 * 30 + 1 for i in range(100))


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(empty_documents(spark), WORDS).count() == 0
    assert len(LONG) > 500_000
