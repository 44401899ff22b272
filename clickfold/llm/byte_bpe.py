"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The vocabulary gives every byte string a rank. A pre-token starts as single bytes; the pair
with the lowest rank is merged, leftmost first, until no pair has a rank. The queue finds that
pair in a few bit operations, however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.worker import kept

#: Bits of one bitmap word; two levels of words cover WORD_BITS squared ranks and more.
WORD_BITS = 10
#: Pre-tokens whose ids a worker remembers before it starts over. Only memory depends on it.
MEMO = 1_200_000

_LOW = (1 << WORD_BITS) - 1


class RankQueue:
    """Positions by rank, lowest rank first and leftmost first within a rank.

    A bucket per rank holds positions. ``words`` has a bit for every rank with a bucket and
    ``top`` a bit for every such word, so the lowest rank is found by two find-first-sets.
    """

    __slots__ = ("top", "words", "buckets")

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        high = rank >> WORD_BITS
        bit = 1 << (rank & _LOW)
        if high in self.words:
            self.words[high] |= bit
        else:
            self.words[high] = bit
            self.top |= 1 << high

    def pop(self) -> tuple[int, int] | None:
        """The next (rank, position), stale ones included; None at the end."""
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        word = self.words[high]
        bit = word & -word
        rank = high << WORD_BITS | bit.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        if word == bit:
            del self.words[high]
            self.top = top & (top - 1)
        else:
            self.words[high] = word ^ bit
        return rank, bucket[0]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token."""
    known = ranks.get
    whole = known(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    # The rank of the pair that starts at a position; None also for merged-away positions.
    pair = [known(piece[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i, rank in enumerate(pair):
        if rank is not None:
            push(rank, i)
    while (entry := pop()) is not None:
        rank, i = entry
        if pair[i] != rank:
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = None
        if k < n:
            before[k] = i
            pair[i] = rank = known(piece[i : after[k]])
            if rank is not None:
                push(rank, i)
        else:
            pair[i] = None
        h = before[i]
        if h >= 0:
            pair[h] = rank = known(piece[h:k])
            if rank is not None:
                push(rank, h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Memo(dict):
    """Ids by pre-token, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        ids = self[piece] = encode_piece(piece.encode(), self.ranks)
        return ids


class ByteBPE:
    """Encodes and decodes by the ranks of a vocabulary file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(ranks)
        self.spelled = {rank: piece for piece, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """One row per input row: its id, ``n_tokens``, ``ids`` and ``decoded`` (the bytes the
    ids stand for), or with ``digests`` the SHA-256 of the comma-joined ids and of the bytes
    in their place.

    A null text counts as empty and has no ids; repeated rows give repeated results, an empty
    table an empty one. Other columns are not read. ``path`` is read on the executors.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = kept(("byte_bpe", path, pattern), lambda: ByteBPE(path, pattern))
        spelled = {rank: str(rank) for rank in bpe.spelled}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                if digests:
                    joined = ",".join(map(spelled.__getitem__, ids))
                    out = hashlib.sha256(joined.encode()).hexdigest()
                    decoded = hashlib.sha256(decoded).hexdigest()
                else:
                    out = ids
                rows.append((len(ids), out, decoded))
            made = pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])
            made.insert(0, "id", batch["id"].astype("Int64").array)
            yield made

    kinds = ("string", "string") if digests else ("array<int>", "binary")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    made = slim.mapInPandas(run, f"id long, n_tokens long, ids {kinds[0]}, decoded {kinds[1]}")
    return made.toDF(id_col, "n_tokens", *names)
