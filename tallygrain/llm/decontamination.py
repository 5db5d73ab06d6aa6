"""Benchmark decontamination by greedy string tiling.

Documents meet benchmark items at shared runs of ``seed`` words. For each such pair, running Karp-Rabin fingerprints
give all common runs of words; the longest run in which no word is taken yet becomes a tile, again and again, until
none of ``seed`` words is left. Tiles never overlap, and their order does not matter, so an item whose passages stand
in another order is covered all the same. A document is contaminated by an item if tiles cover enough of the item.

Items are the query set: they go to the tasks in blocks of bounded size, and all documents pass by each block. No
document text is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import map_whole_rows, to_batch
from tallygrain.llm.tokens import Runs, folded, slices, text_bytes, word_codes, words

BLOCK_BYTES = 32 << 20  # benchmark text sent to the tasks at a time
SEED = 5
COVERAGE = 0.5
_BITS = 18  # of the table that turns away most fingerprints before they are looked up

_MATCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("coverage", pa.float64()),
        ("n_tiles", pa.int64()),
        ("longest_tile", pa.int64()),
        ("n_item_words", pa.int64()),
    ]
)
_MATCH_DDL = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long, n_item_words long"


def _word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(pc.utf8_lower(column))
    data = folded(data)
    starts, ends, counts = words(data, offsets)
    return word_codes(data, starts, ends), counts


def _seeds(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, text number and place of every run of ``size`` words inside one text."""
    grams = Runs(codes).grams(size)
    text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))[: len(grams)]
    inside = np.flatnonzero(np.arange(len(grams)) + size <= counts[text + 1])
    return grams[inside], text[inside], inside - counts[text[inside]]


class Items:
    """Benchmark items with an index of their word runs."""

    def __init__(self, ids: list[int | None], texts: list[str | None], seed: int):
        codes, counts = _word_codes(pa.array(texts, pa.string()))
        self.ids, self.sizes, self.seed = ids, np.diff(counts), seed
        grams, item, place = _seeds(codes, counts, seed)
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def meet(self, codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Text, item, and the places in both of all shared runs, for each pair that shares one."""
        grams, text, place = _seeds(codes, counts, self.seed)
        maybe = np.flatnonzero(self.table[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        low = np.searchsorted(self.grams, grams[maybe], "left")
        many = np.searchsorted(self.grams, grams[maybe], "right") - low
        mine = np.repeat(maybe, many)
        before = np.cumsum(many) - many
        theirs = np.arange(len(mine)) + np.repeat(low - before, many)
        pair = text[mine] * len(self.ids) + self.item[theirs]
        order = np.argsort(pair, kind="stable")
        edges = np.flatnonzero(np.diff(pair[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            yield int(pair[own[0]]) // len(self.ids), int(pair[own[0]]) % len(self.ids), place[mine[own]], self.place[theirs[own]]


def tiles(in_text: np.ndarray, in_item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words) from the places of all shared runs of ``seed`` words.

    The longest run that is still free comes first; of equal ones the one first in the item, then in the text.
    """
    diagonal = in_text - in_item
    order = np.lexsort((in_item, diagonal))
    x, y, diagonal = in_text[order], in_item[order], diagonal[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (diagonal[1:] != diagonal[:-1]) | (y[1:] != y[:-1] + 1)
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(x))) + seed - 1
    heap = [(-int(n), int(b), int(a)) for n, a, b in zip(sizes, x[first], y[first], strict=True)]
    heapq.heapify(heap)
    taken_text, taken_item, found = set(), set(), []
    while heap:
        size, b, a = heapq.heappop(heap)
        free = [a + k not in taken_text and b + k not in taken_item for k in range(-size)]
        if all(free):
            taken_text.update(range(a, a - size))
            taken_item.update(range(b, b - size))
            found.append((a, b, -size))
            continue
        begin = None
        for k, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = k
            elif not ok and begin is not None:
                if k - begin >= seed:
                    heapq.heappush(heap, (begin - k, b + begin, a + begin))
                begin = None
    return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list, list]]:
    """Ids and texts of the distinct items and how many rows each has, in blocks of about ``BLOCK_BYTES``."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = items.distinct().agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = own.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n")).collect()
        yield [row.item_id for row in rows], [row.text for row in rows], [row.n for row in rows]


def _covered(items: Items, batch: pa.RecordBatch, text_col: str, coverage: float) -> Iterator[tuple[int, int, list]]:
    """Text number, item number and tiles of every pair with enough coverage."""
    codes, counts = _word_codes(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()))
    for text, item, in_text, in_item in items.meet(codes, counts):
        found = tiles(in_text, in_item, items.seed)
        if sum(n for _, _, n in found) >= coverage * items.sizes[item]:
            yield text, item, found


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = SEED,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of a document and a benchmark item of which tiles cover the share ``coverage`` or more.

    Returns a row per pair: ``doc_id``, ``item_id``, ``coverage`` (share of the item's words), ``n_tiles``,
    ``longest_tile``, ``n_item_words``. Words are runs of ASCII letters, digits and characters beyond ASCII, in lower
    case.

    Null and empty texts, and items of fewer words than a seed, match nothing. Rows that repeat, in either table, give
    repeated pairs; missing ids stay missing. Other columns are not read. If either table is empty, so is the result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ids, texts, counts in _blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast((ids, texts, counts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            *known, counts = shared.value
            items = Items(*known, seed)
            for batch in slices(batches, 1 << 20):
                rows, times = {name: [] for name in _MATCH.names}, []
                for text, item, found in _covered(items, batch, "text", coverage):
                    rows["doc_id"].append(batch.column("doc_id")[text].as_py())
                    rows["item_id"].append(items.ids[item])
                    rows["coverage"].append(sum(n for _, _, n in found) / int(items.sizes[item]))
                    rows["n_tiles"].append(len(found))
                    rows["longest_tile"].append(found[0][2])
                    rows["n_item_words"].append(int(items.sizes[item]))
                    times.append(counts[item])
                matches, repeated = to_batch(rows, _MATCH), np.repeat(np.arange(len(times)), times)
                for begin in range(0, len(repeated), 50_000):
                    yield matches.take(pa.array(repeated[begin : begin + 50_000]))

        part = narrow.mapInArrow(run, _MATCH_DDL)
        out = part if out is None else out.union(part)
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = SEED,
    coverage: float = COVERAGE,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates; see ``contamination``."""
    name = f"c{docs.columns.index(text_col)}"
    for ids, texts, _ in _blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, seed)
            for batch in slices(batches, 1 << 20, name):
                clean = np.ones(batch.num_rows, bool)
                for text, _, _ in _covered(items, batch, name, coverage):
                    clean[text] = False
                yield batch.filter(pa.array(clean))

        docs = map_whole_rows(docs, run)
    return docs
