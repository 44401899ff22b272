"""Packing of token sequences: first-fit decreasing over a tournament tree.

Documents are tokenised and cut into pieces of at most the sequence length. Pieces go to
randomised groups of documents; within a group the longest goes first, each into the first
sequence with room, which a tournament tree over the free room of the sequences finds in a
logarithmic number of steps.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch
from clickfold.llm.worker import kept

LENGTH = 2048
END = 1
#: Documents in a group, on average: a larger group pads less and takes longer.
GROUP = 8192
#: Words whose ids a worker remembers before it starts over, words given to the library at
#: once, and characters whose words are looked up together. Only memory depends on them.
MEMO = 1_200_000
LOT = 1000
STRETCH = 4_000_000
#: Stands between words; no other word's ids hold its id.
SIGN = "\x01"
_ID = np.dtype("<u4")


class TournamentTree:
    """The free room of up to ``size`` bins; each node holds the most of its two sides."""

    def __init__(self, size: int, room: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the first bin with room; its bin and the room before."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < length:
                node += 1
        bin_, before = node - self.leaves, most[node]
        most[node] -= length
        while node > 1:
            node //= 2
            best = max(most[2 * node], most[2 * node + 1])
            if most[node] == best:
                break
            most[node] = best
        return bin_, before


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece; pieces are at most ``room`` long, ties go by place."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree = TournamentTree(len(lengths), room)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        bins[i], before = tree.place(lengths[i])
        offsets[i] = room - before
    return bins, offsets


class WordTokenizer:
    """Ids of a tokenizer that drops white space, as little-endian bytes.

    Such a tokenizer treats what lies between blanks alone, so each distinct word is encoded
    by the library once and remembered. Words go to the library many at a time, with a control
    character between them whose id marks where the next one begins.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(SIGN, add_special_tokens=False).ids
        self.memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(m.ids, _ID) for m in made]

    def learn(self, texts: list[str]) -> None:
        """Remember the words of the texts that are new."""
        words = set()
        for text in texts:
            words.update(text.replace("\n", " ").split(" "))
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(words)
        odd = [w for w in new if SIGN in w]
        if odd:
            new = [w for w in new if SIGN not in w]
            self.memo.update(zip(odd, (ids.tobytes() for ids in self._ids(odd))))
        lots = [new[i : i + LOT] for i in range(0, len(new), LOT)]
        for lot, ids in zip(lots, self._ids([f" {SIGN} ".join(lot) for lot in lots])):
            ends = np.flatnonzero(ids == self.mark) * _ID.itemsize
            data, width = ids.tobytes(), _ID.itemsize
            starts = [0, *(ends + width).tolist()]
            for word, start, end in zip(lot, starts, [*ends.tolist(), len(data)]):
                self.memo[word] = data[start:end]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, some texts at a time."""
        for group in _by_size(texts):
            self.learn(group)
            for text in group:
                yield b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    """Stretches of the texts of about :data:`STRETCH` characters, or one longer text."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > STRETCH:
            yield group
            group, size = [], 0
    if group:
        yield group


def pieces(
    docs: DataFrame, path: str, id_col: str, text_col: str, length: int, digests: bool
) -> DataFrame:
    """One row per piece: ``row``, ``id``, ``start``, ``length``, ``doc_tokens`` and its ids,
    or their CRC-32."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        text.alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = kept(("word_tokenizer", path), lambda: WordTokenizer(path))
        end = np.array([END], _ID).tobytes()
        for batch in batches:
            rows, ids = [], []
            encoded = tokenizer.encode_all(batch["text"].tolist())
            for row, doc, made in zip(batch["row"], batch["id"], encoded):
                doc = None if pd.isna(doc) else int(doc)
                made += end
                n = len(made) // _ID.itemsize
                for start in range(0, n, length):
                    size = min(length, n - start)
                    part = made[start * _ID.itemsize : (start + size) * _ID.itemsize]
                    rows.append((row, doc, start, size, n))
                    ids.append(zlib.crc32(part) if digests else np.frombuffer(part, _ID))
            out = pd.DataFrame(rows, columns=["row", "id", "start", "length", "doc_tokens"])
            out["id"] = pd.array(out["id"].tolist(), dtype="Int64")
            out["ids"] = ids
            yield out

    kind = "long" if digests else "array<long>"
    return slim.mapInPandas(
        run, f"row long, id long, start long, length long, doc_tokens long, ids {kind}"
    )


def _pack(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "start"], ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].tolist(), length)
        number = int(group["part"].iloc[0]) << 32
        return pd.DataFrame(
            {
                "row": group["row"],
                "start": group["start"],
                "sequence_id": number + np.array(bins, np.int64),
                "offset": np.array(offsets, np.int64),
            }
        )

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    digests: bool = False,
) -> DataFrame:
    """One row per piece: the document's id, ``start`` (ids before it), ``length``, its
    ``ids`` (with ``digests``: ``ids_crc32``), ``doc_tokens``, ``sequence_id`` and ``offset``.

    Every document ends with the id :data:`END`, so that one without text is one piece of
    length 1; a null text counts as empty. All pieces of a document go to one group and all
    ids lie in exactly one piece. Repeated rows are packed each on their own, an empty table
    gives an empty result, and other columns are not read. ``path`` is read on the executors.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.put(pieces(docs, path, id_col, text_col, length, digests), "pieces")
    groups = max(1, -(-made.filter("start = 0").count() // GROUP))
    # A group holds about GROUP documents wherever they come from.
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part")
    placed = (
        made.select("row", "start", "length", part)
        .groupBy("part")
        .applyInPandas(_pack(length), "row long, start long, sequence_id long, offset long")
    )
    return made.join(placed, ["row", "start"]).select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.col("ids").alias("ids_crc32" if digests else "ids"),
        *("doc_tokens", "sequence_id", "offset"),
    )
