"""Words, fingerprints and winnowed anchors of whole Arrow batches, computed with numpy inside Spark tasks.

Fingerprints of token runs are polynomial sums over random 64-bit codes. Callers compare two of them, or one among
runs that already share an anchor, so a false match needs two independent 64-bit collisions.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_LIMIT = 1 << 16  # positions of a word with powers of their own; longer words reuse them
BLOCK = 1 << 17  # window starts handled at a time
_SPACES = (9, 10, 11, 12, 13, 32)  # fixed values: the white space that ends a word
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def _random_codes(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, count, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = int(_random_codes(1, 11)[0])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
BYTE_CODES = _random_codes(256, 7)
_WORD_CODES = np.where(_IS_SPACE, np.uint64(0), BYTE_CODES)
_WORD_POWERS = _powers(_BASE, WORD_LIMIT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = np.where(np.char.isalnum(np.array([chr(i) for i in range(128)] + ["x"] * 128)), _LOWER, 32).astype(np.uint8)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of the result can be used."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the place where each text starts (one more than texts); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as the worker lives on for the tasks of later stages."""
    Runs.forget()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, or one row where a text is longer."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
                yield batch.slice(begin, end - begin)
                begin = end
    finally:
        give_back()


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, and ASCII that is neither letter nor digit to a space; bytes of other characters stay."""
    return _FOLDED[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of its first word (one more than texts)."""
    solid = ~_IS_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        until = max(done + 1, int(np.searchsorted(ends, starts[done] + (1 << 20), "right")))
        first = starts[done]
        local = starts[done:until] - first
        part = data[first : ends[until - 1]]
        origin = np.zeros(len(part), np.int64)
        origin[local] = local
        place = np.arange(len(part)) - np.maximum.accumulate(origin)
        sums = np.add.reduceat(_WORD_CODES[part] * _WORD_POWERS[place & (WORD_LIMIT - 1)], local)
        out[done:until] = mix(sums + (ends[done:until] - starts[done:until]).astype(np.uint64))
        done = until
    return out


class Runs:
    """Fingerprints of runs of at most ``limit`` + slack tokens of one code sequence."""

    _cache: dict[int, np.ndarray] = {}

    @classmethod
    def forget(cls) -> None:
        """Drop the tables that a long text made large."""
        cls._cache = {base: powers for base, powers in cls._cache.items() if len(powers) <= 1 << 18}

    @classmethod
    def _table(cls, base: int, count: int) -> np.ndarray:
        if base not in cls._cache or len(cls._cache[base]) < count:
            cls._cache[base] = _powers(base, 1 << max(18, count.bit_length()))
        return cls._cache[base]

    def __init__(self, codes: np.ndarray, salt: int = 0):
        self.base = int(_random_codes(1, 100 + salt)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        count = len(codes)
        self.sums = np.zeros(count + 1, np.uint64)
        np.cumsum(codes * self._table(self.base, count)[:count], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprint of the tokens from begin to end, wherever they stand."""
        span = self.sums[end] - self.sums[begin]
        return mix(span * self._table(self.inverse, len(self.sums))[begin] + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Fingerprint of each run of ``size`` tokens."""
        count = len(self.sums) - size
        if count <= 0:
            return np.zeros(0, np.uint64)
        spans = (self.sums[size:] - self.sums[:-size]) * self._table(self.inverse, len(self.sums))[:count]
        return mix(spans)


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by doubling."""
    reach = 1
    while reach < size:
        step = min(reach, size - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


def anchors(codes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Winnowed anchors of token sequences, a block of window starts at a time.

    Each window of ``window`` tokens inside one text picks the least of its ``gram``-token fingerprints, the leftmost
    of equal ones, so equal windows pick the same gram at the same place. Neighbouring windows with one pick form a
    row: text number, first window start (from the text's start), number of windows, place of the gram (from the first
    window start), fingerprint of the gram, and of all tokens that these windows cover. Texts shorter than a window
    have none. Where one token repeats on and on, each window is a row of its own; ``reps`` equal rows in a row are
    given once, so a row stands for the window starts from ``lo`` to ``lo + n + reps - 2``.
    """
    place_bits = np.uint64(20)
    place_mask = np.uint64((1 << 20) - 1)
    if window > BLOCK:
        raise ValueError("a window may not be longer than a block")
    total = len(codes)
    for base in range(0, max(0, total - window + 1), BLOCK):
        part = codes[base : base + BLOCK + window - 1]
        runs = Runs(part)
        grams = runs.grams(gram)
        order = (grams >> place_bits << place_bits) | np.arange(len(grams), dtype=np.uint64)
        picks = (_sliding_min(order, window - gram + 1) & place_mask).astype(np.int64)
        here = np.arange(base, base + len(picks))
        text = np.searchsorted(offsets, here, "right") - 1
        valid = here + window <= offsets[text + 1]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (picks[1:] != picks[:-1])
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        count = np.add.reduceat(valid.astype(np.int64), first)
        found = {
            "text": text[first],
            "lo": here[first] - offsets[text[first]],
            "n": count,
            "at": picks[first] - first,
            "h": grams[picks[first]].view(np.int64),
            "c": runs.of(first, first + count - 1 + window).view(np.int64),
        }
        same = np.zeros(len(first), bool)
        same[1:] = (found["c"][1:] == found["c"][:-1]) & (found["text"][1:] == found["text"][:-1])
        same[1:] &= (count[1:] == 1) & (count[:-1] == 1) & (first[1:] == first[:-1] + 1)
        heads = np.flatnonzero(~same)
        found = {name: values[heads] for name, values in found.items()}
        found["reps"] = np.diff(np.append(heads, len(first)))
        yield found


def window_codes(codes: np.ndarray, begin: np.ndarray, window: int, salt: int) -> np.ndarray:
    """Fingerprint of the window at each start; each salt gives an independent one."""
    out = np.empty(len(begin), np.int64)
    order = np.argsort(begin, kind="stable")
    sorted_begin = begin[order]
    done = 0
    while done < len(begin):
        origin = sorted_begin[done]
        until = int(np.searchsorted(sorted_begin, origin + BLOCK, "left"))
        runs = Runs(codes[origin : origin + BLOCK + window], salt)
        local = sorted_begin[done:until] - origin
        out[order[done:until]] = runs.of(local, local + window).view(np.int64)
        done = until
    return out
