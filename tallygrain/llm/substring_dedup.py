"""Removal of repeated word passages across documents: seed on winnowed anchors, extend, keep maximal repeats.

Every window of ``window`` words picks one of its ``gram``-word runs as anchor, by content alone, so equal windows
meet at equal anchors. Anchors that two documents share are the seeds. A seed is extended both ways over all words of
the windows that picked it: occurrences whose whole surroundings agree form one class, and everything in it repeats
the class's first document at once. Only where an anchor has several surroundings is the extension settled window by
window, for the first document of each class. Overlapping repeats add up to maximal ones.

Nothing is paired: classes and windows are grouped minima, summed up before the shuffle, then joined back to their
occurrences, and a hot key is split by the skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import in_pieces, listed, narrow, range_columns, spread, to_batch, written
from tallygrain.llm.tokens import anchors, slices, text_bytes, window_codes, word_codes, words

_ANCHOR = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())]
)
_WINDOW = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("lo", pa.int32())]
)
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        ("kept_text", pa.string()),
    ]
)
_ANCHOR_DDL = "doc_id long, part int, h long, c long, lo int, n int"
_WINDOW_DDL = "doc_id long, part int, w1 long, w2 long, lo int"
_RESULT_DDL = "doc_id long, n_words long, n_removed long, removed array<struct<begin:int,end:int>>, kept_text string"


def _tokenised(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, counts = words(data, offsets)
    return data, starts, ends, counts


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, counts = _tokenised(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            for found in anchors(word_codes(data, starts, ends), counts, window, gram):
                rows = {name: found[name] for name in ("h", "c", "lo")}
                rows |= {"doc_id": ids[found["text"]], "part": parts[found["text"]], "n": found["n"] + found["reps"] - 1}
                yield from in_pieces(rows, _ANCHOR)

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, counts = _tokenised(batch)
            codes = word_codes(data, starts, ends)
            begin, length, row = range_columns(batch.column("ranges"))
            lo, of = spread(begin, length)
            row = row[of]
            at = lo + counts[row]
            found = {"w1": window_codes(codes, at, window, 1), "w2": window_codes(codes, at, window, 2), "lo": lo}
            found["doc_id"] = batch.column("doc_id").to_numpy()[row]
            found["part"] = batch.column("part").to_numpy()[row]
            yield from in_pieces(found, _WINDOW)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, counts = _tokenised(batch)
            begin, length, row = range_columns(batch.column("ranges"))
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, begin + counts[row], 1)
            np.add.at(change, begin + counts[row] + length + window - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            # A kept word takes one space with it unless it is the first that its text keeps.
            keep = np.flatnonzero(~gone)
            kept_before = np.searchsorted(keep, counts)
            whole = data.tobytes()
            texts, removed, lost = [], [], []
            for i in range(batch.num_rows):
                a, b = counts[i], counts[i + 1]
                own = whole[starts[a] : ends[b - 1]].split() if b > a else []
                if kept_before[i + 1] - kept_before[i] == b - a:
                    texts.append(b" ".join(own).decode())
                    removed.append([])
                else:
                    out = gone[a:b]
                    texts.append(b" ".join([own[j] for j in np.flatnonzero(~out)]).decode())
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                    removed.append([{"begin": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                lost.append(int(b - a - (kept_before[i + 1] - kept_before[i])))
            rows = {"doc_id": batch.column("doc_id"), "n_words": np.diff(counts), "n_removed": lost}
            yield to_batch(rows | {"removed": removed, "kept_text": texts}, _RESULT)

    return run


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 25
) -> DataFrame:
    """Remove each word covered by a ``window``-word run that also starts in a document of a smaller id.

    Returns a row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (maximal word ranges, end
    exclusive), ``kept_text`` (kept words joined by one space). Words are runs of anything but ASCII white space.

    Null text counts as empty, and an empty or short text keeps all words. A row without id is never cut and cuts no
    other. Rows that share an id never cut each other; each gets its own result. Other columns are not read. An empty
    table gives an empty result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    base = narrow(docs, id_col, text_col)
    seeds = base.where("doc_id is not null").mapInArrow(_anchor_rows(window, gram), _ANCHOR_DDL)
    shared = seeds.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    hits = written(seeds.join(written(shared), "h"))
    classes = hits.groupBy("h", "c").agg(F.min("doc_id").alias("first_doc"))
    varied = classes.groupBy("h").agg((F.count(F.lit(1)) > 1).alias("varied"))
    classes = written(classes.join(varied, "h"))
    placed = hits.join(classes, ["h", "c"])
    later = placed.where("doc_id > first_doc").select("doc_id", "part", "lo", "n")
    first = placed.where("varied and doc_id = first_doc").select("doc_id", "part", "lo", "n")
    windows = base.join(listed(first), ["doc_id", "part"]).select("doc_id", "part", "text", "ranges")
    windows = written(windows.mapInArrow(_window_rows(window), _WINDOW_DDL))
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    single = windows.join(written(earliest), ["w1", "w2"]).where("doc_id > a")
    repeats = later.union(single.select("doc_id", "part", "lo", F.lit(1).alias("n")))
    cut = base.join(listed(repeats), ["doc_id", "part"], "left").select("doc_id", "text", "ranges")
    return cut.mapInArrow(_cut(window), _RESULT_DDL)
