"""Runs of words that repeat with a period, found on a grammar of the words.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no pair occurs twice. Each new
symbol stands for a stretch of words that is the same wherever the symbol was put, so the runs that cross the boundary
between its two halves are looked for once and copied to all these places. A run lies inside some symbol, whose
boundary it then crosses, or crosses a boundary of the symbols that are left at the end; those are halved like a tree.

Before that, whole batches are thinned with numpy: in a run of at least four periods and six words every three
neighbouring words occur three times in the text, so only stretches of four or more such places can hold a run. Prose
has hardly any.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.tokens import mix, slices, text_bytes, word_codes, words

PERIODS = 4  # a run has at least so many periods
WORDS = 6  # and at least so many words
_GRAM = 3  # neighbouring words; in a run any so many occur at least
_TIMES = 3  # times
_SLOTS = 24  # bits of the table that counts them, at most
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

Run = tuple[int, int, int]  # period, first word, word after the last


class Grammar:
    """Re-Pair of a sequence: for each new symbol the length of its left half, its whole length, and all its places.

    Of equally frequent pairs the shorter one is replaced first, and of these the one that comes first, which keeps the
    symbols balanced. ``left`` holds the places at which the symbols start that remain.
    """

    def __init__(self, ids: list[int]):
        count = len(ids)
        symbol, size = list(ids), [1] * count
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        self.rules: list[tuple[int, int, list[int]]] = []
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(count - 1):
            places[symbol[i], symbol[i + 1]].append(i)
        heap = [(-len(p), 2, p[0], pair) for pair, p in places.items() if len(p) > 1]
        heapq.heapify(heap)
        fresh = max(ids, default=-1) + 1
        while heap:
            known, length, _, pair = heapq.heappop(heap)
            first, second = pair
            here, end = [], -1
            for i in places.pop(pair):
                j = after[i]
                # A place that was swallowed has no symbol; of overlapping places the left one counts.
                if i != end and symbol[i] == first and j < count and symbol[j] == second:
                    here.append(i)
                    end = j
            if len(here) < 2:
                continue
            if len(here) < -known:
                places[pair] = here
                heapq.heappush(heap, (-len(here), length, here[0], pair))
                continue
            self.rules.append((size[here[0]], length, here))
            for i in here:
                j = after[i]
                symbol[i], symbol[j], size[i] = fresh, -1, length
                after[i] = after[j]
                if after[j] < count:
                    before[after[j]] = i
            new: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i in here:
                if before[i] >= 0:
                    new[symbol[before[i]], fresh].append(before[i])
                if after[i] < count and symbol[after[i]] != fresh:
                    new[fresh, symbol[after[i]]].append(i)
            for made, at in new.items():
                if len(at) > 1:
                    places[made] = at
                    heapq.heappush(heap, (-len(at), size[at[0]] + size[after[at[0]]], at[0], made))
            fresh += 1
        self.left = []
        i = 0
        while i < count:
            self.left.append(i)
            i = after[i]


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items are equal; looks at little more than these."""
    size, done, step = min(len(a), len(b)), 0, 32
    while done < size:
        stop = min(size, done + step)
        different = np.flatnonzero(a[done:stop] != b[done:stop])
        if len(different):
            return done + int(different[0])
        done, step = stop, step * 2
    return size


def crossing(text: np.ndarray, middle: int) -> list[Run]:
    """Runs of a word sequence that hold the words on both sides of ``middle``, each as long as the sequence allows.

    Of a run's four periods two lie on one side. If they lie on the right, the words from the one before the middle
    equal those a period later, for a period and a word; on the left likewise. Three such words are compared for all
    periods at once, and what passes is followed word by word.
    """
    count = len(text)
    most = count // PERIODS
    if count < WORDS or not 0 < middle < count:
        return []
    found: list[Run] = []
    for side, m in ((text, middle), (text[::-1], count - middle)):
        q = np.arange(1, min(most, (count - m) // 2) + 1)
        q = q[(side[m - 1 + q] == side[m - 1]) & (side[m - 1 + 2 * q] == side[m - 1])]
        for period in q[side[m + q] == side[m]].tolist():
            if side is text:
                # Where a multiple of a run's period overlaps the run by that multiple, it gives the same run again.
                if any(period % known == 0 and stop >= middle - 1 + period for known, _, stop in found):
                    continue
                anchor = middle
            else:
                if any(period % known == 0 and start <= middle + 1 - period for known, start, _ in found):
                    continue
                anchor = middle - period
            stop = anchor + period + _agreement(text[anchor:], text[anchor + period :])
            start = anchor - _agreement(text[:anchor][::-1], text[: anchor + period][::-1])
            if start < middle < stop and stop - start >= max(WORDS, PERIODS * period):
                found.append((period, start, stop))
    return found


def _merged(found: set[Run]) -> list[Run]:
    """Maximal runs: stretches of one period that overlap by a period are one; of equal stretches the least period stays."""
    out: dict[tuple[int, int], int] = {}
    last: Run | None = None
    for q, start, stop in sorted(found) + [(0, 0, 0)]:
        if last and q == last[0] and start + q <= last[2]:
            last = (q, last[1], max(last[2], stop))
            continue
        if last:
            out.setdefault(last[1:], last[0])
        last = (q, start, stop)
    return sorted((q, start, stop) for (start, stop), q in out.items())


def grammar_runs(ids: list[int]) -> list[Run]:
    """All runs of a sequence."""
    grammar, text = Grammar(ids), np.array(ids, np.int64)
    found: set[Run] = set()
    for half, length, places in grammar.rules:
        origin = places[0]
        for q, start, stop in crossing(text[origin : origin + length], half):
            found.update((q, place + start, place + stop) for place in places)
    # The symbols that are left, halved at the boundary nearest the middle.
    bounds = np.array([*grammar.left, len(ids)])
    open_ = [(0, len(grammar.left))]
    while open_:
        a, b = open_.pop()
        begin, end = int(bounds[a]), int(bounds[b])
        if b - a < 2 or end - begin < WORDS:
            continue
        cut = int(np.searchsorted(bounds, (begin + end) // 2).clip(a + 1, b - 1))
        middle = int(bounds[cut])
        found.update((q, begin + start, begin + stop) for q, start, stop in crossing(text[begin:end], middle - begin))
        open_ += [(a, cut), (cut, b)]
    return _merged(found)


def _stretches(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Word ranges that may hold runs, each inside one text: neighbouring grams that all occur three times in the text."""
    count = len(codes) - _GRAM + 1
    if count <= 0:
        return
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    grams = text[:count] * _FACTORS[0]
    for i in range(_GRAM):
        grams += codes[i : i + count] * _FACTORS[i + 1]
    slots = (mix(grams) >> np.uint64(64 - min(_SLOTS, (8 * count).bit_length()))).astype(np.int64)
    inside = text[:count] == text[_GRAM - 1 :]
    # Grams that share a slot only make a stretch longer.
    often = inside & (np.bincount(slots[inside], minlength=int(slots.max()) + 1)[slots] >= _TIMES)
    # Two texts' grams are never neighbours, as those that reach over the border are not inside.
    edges = np.flatnonzero(np.diff(often.astype(np.int8), prepend=0, append=0))
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a + _GRAM - 1 >= WORDS:
            yield a, b + _GRAM - 1


def batch_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> dict[int, list[Run]]:
    """Runs by text number, with word numbers of the text, for a batch of texts given by its bytes and word ends."""
    out: dict[int, list[Run]] = defaultdict(list)
    for a, b in _stretches(word_codes(data, starts, ends), first):
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(data[i:j].tobytes(), len(numbers)) for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        text = int(np.searchsorted(first, a, "right")) - 1
        shift = a - int(first[text])
        out[text] += [(q, start + shift, stop + shift) for q, start, stop in grammar_runs(ids)]
    return out


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of whole texts: ``doc_id``, ``n_words``, ``runs`` and ``collapsed``.

    A run is a stretch of consecutive words with least period q, of at least max(6, 4 q) words, that no neighbouring
    word prolongs. ``runs`` lists start, length and period by start and period; ``collapsed`` is the text without the
    words that a run holds after its first q, joined by one space. Words are what white space (space, tab to carriage
    return) separates, compared byte by byte.

    A row per input row, in any order. Null and empty texts have no words and collapse to the empty text. Ids and texts
    may repeat, a missing id stays missing, and other columns are not read. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = words(data, offsets)
            found = batch_runs(data, starts, ends, first)
            kept = np.ones(len(starts), bool)
            listed = []
            for text in range(batch.num_rows):
                own = sorted((start, stop - start, q) for q, start, stop in found.get(text, ()))
                listed.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                for start, length, q in own:
                    kept[first[text] + start + q : first[text] + start + length] = False
            columns = [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(listed, pa.list_(_RUN))]
            yield pa.RecordBatch.from_arrays([*columns, _joined(data, offsets, starts, ends, first, kept)], schema=_OUT)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    mask = np.zeros(len(data), bool)
    gaps = np.zeros(len(data) + 1, np.int8)
    gaps[starts[kept]] += 1
    gaps[ends[kept]] -= 1
    mask[:] = np.cumsum(gaps[:-1], dtype=np.int8)
    number = np.flatnonzero(kept)
    of = np.searchsorted(first, number, "right")
    # A kept word that another of its text follows brings the white space after it along, as a space.
    joint = ends[number[:-1][of[:-1] == of[1:]]]
    mask[joint] = True
    data = data.copy()
    data[joint] = 32
    places = np.concatenate((np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)))[offsets]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(places), pa.py_buffer(data[mask]))
