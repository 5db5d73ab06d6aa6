"""Byte-level BPE as a monoid: texts are encoded in halves, and neighbours are joined by encoding their border again.

A cut is a place where the splitting pattern always ends one match and starts the next, and where neither side can
change how the other is split: a change of character class after a character that is not white space. So the ids of
two texts joined at a cut are the ids of one followed by the ids of the other. Where two halves meet anywhere else,
a window around the border grows until it starts and ends at a cut; what lies outside is stable and stays, what lies
inside is encoded again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tallygrain.llm.common import to_batch
from tallygrain.llm.tokens import slices

LEAF = 1024  # characters encoded in one go
WINDOW = 64  # characters on either side of a border, at first
LONG = 1 << 16  # characters without a cut from which merges are taken from a heap, as the library's pattern gives up
BYTES = 1 << 14  # ids decoded in one go

# Class changes at which the splitting pattern always ends a match, whatever stands around them. Only a
# quote before a letter may go on, as in 'll, and a space before anything.
_CUT = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
    r"|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"
)

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_BYTES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern: merge the leftmost pair of least rank until no pair has a rank."""
    if data in ranks:
        return [ranks[data]]
    get, count = ranks.get, len(data)
    end, before = list(range(1, count + 1)), list(range(-1, count - 1))
    heap = [(rank, i, i + 2) for i in range(count - 1) if (rank := get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * count
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= count or end[middle] != stop:
            continue
        alive[middle] = False
        end[i] = stop
        if stop < count:
            before[stop] = i
            if (rank := get(data[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if i and (rank := get(data[before[i] : stop])) is not None:
            heapq.heappush(heap, (rank, before[i], stop))
    out, i = [], 0
    while i < count:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes by halves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _at_once(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.short.encode_ordinary(text)
        return list(chain.from_iterable(merge(piece.encode(), self.ranks) for piece in self.split(text)))

    def _taken(self, ids: list[int], size: int, step: int) -> int:
        """How many ids, from the front or the back, make up so many bytes."""
        count, at = 0, 0 if step > 0 else -1
        while size > 0:
            size -= len(self.tokens[ids[at]])
            at += step
            count += 1
        return count

    def _join(self, text: str, middle: int, left: list[int], right: list[int]) -> list[int]:
        if _CUT.match(text, middle):
            return left + right
        begin, reach = 0, WINDOW
        while middle - reach > 0:
            # One character more, so that a cut at the window's own edge is seen; the last cut lies nearest the border.
            cuts = [m.start() for m in _CUT.finditer(text, middle - reach, middle)]
            if cuts:
                begin = cuts[-1]
                break
            reach *= 2
        else:
            cuts = [m.start() for m in _CUT.finditer(text, 0, middle)]
            begin = cuts[-1] if cuts else 0
        end, reach = len(text), WINDOW
        while True:
            found = _CUT.search(text, middle + 1, min(len(text), middle + reach))
            if found:
                end = found.start()
                break
            if middle + reach >= len(text):
                break
            reach *= 2
        keep = len(left) - self._taken(left, len(text[begin:middle].encode()), -1)
        skip = self._taken(right, len(text[middle:end].encode()), 1)
        return left[:keep] + self.encode(text[begin:end], tree=False) + right[skip:]

    def encode(self, text: str, tree: bool = True) -> list[int]:
        """Ids of a text; ``tree`` splits it into halves down to leaves."""
        if not tree or len(text) <= self.leaf:
            return self._at_once(text)
        middle = len(text) // 2
        return self._join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, put together up the tree."""
        if len(ids) <= BYTES:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def bpe_encode(docs: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: ``doc_id``, ``ids``.

    The rank file is read on the driver, where ``ranks_path`` is, and sent to the tasks; its size is that of a
    vocabulary. A row per input row, in any order. Null and empty texts have no ids. Ids and texts may repeat, and a
    missing id stays missing. Strings of special tokens are ordinary text. Other columns are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in slices(batches, 1 << 20):
            ids = [np.array(codec.encode(text.as_py() or ""), np.int32) for text in batch.column("text")]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], schema=_IDS)

    narrow = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of token ids: ``doc_id``, ``n_tokens``, ``ids``, ``decoded``. Null ids count as none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                lists = part.column("ids")
                ids = [np.zeros(0, np.int32) if x.values is None else x.values.to_numpy() for x in lists]
                rows = {"doc_id": part.column("doc_id"), "n_tokens": [len(x) for x in ids], "ids": lists}
                yield to_batch(rows | {"decoded": [codec.decode(x.tolist()) for x in ids]}, _BYTES)

    narrow = encoded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def bpe_round_trip(docs: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bpe_decode`` of ``bpe_encode``, in one pass of each task over its texts: ``doc_id``, ``n_tokens``, ``ids``, ``decoded``."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in slices(batches, 1 << 20):
            ids = [codec.encode(text.as_py() or "") for text in batch.column("text")]
            rows = {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) for x in ids], "ids": [np.array(x, np.int32) for x in ids]}
            yield to_batch(rows | {"decoded": [codec.decode(x) for x in ids]}, _BYTES)

    narrow = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")
