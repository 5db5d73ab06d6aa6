"""Removal of byte strings that stand anywhere else, with a sparse suffix array.

A suffix array over every byte would hold as many suffixes as there are bytes. Here the suffixes start at winnowed
anchors: each window of ``window`` bytes picks one of its ``gram``-byte runs by content alone, so equal windows hold
equal anchors at equal places, and comparing the suffixes from shared anchors, together with the bytes before them,
settles every window. Anchors that occur once are dropped first. Occurrences whose whole surroundings agree form a
class; a class of two or more repeats as it stands.

What is left, classes that share an anchor but not their surroundings, is sorted: sampled splitters range-partition
the suffixes by their leading bytes, each bucket orders them by multikey quicksort, eight bytes a key, and the common
prefixes of neighbours give, at any depth, the suffixes that agree so far. The bytes before the anchors are ordered
backwards in the same way, once over all contexts and again in each bucket. Anchors at the edge of a bucket may go on
in the next one, so those of their windows that some neighbour reaches on both sides are also compared across
boundaries, by fingerprint, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import in_pieces, listed, narrow, range_columns, to_batch, written
from tallygrain.llm.tokens import BYTE_CODES, Runs, anchors, slices, text_bytes

_SMALL = 48  # suffixes ordered without a further split

_ANCHOR = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("h", pa.int64()),
        ("c", pa.int64()),
        ("lo", pa.int32()),
        ("n", pa.int32()),
        ("reps", pa.int32()),
        ("at", pa.int16()),
    ]
)
_ANCHOR_DDL = "doc_id long, part int, h long, c long, lo int, n int, reps int, at smallint"
_CONTEXT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("h", pa.int64()),
        ("k", pa.int64()),
        ("lo", pa.int32()),
        ("n", pa.int32()),
        ("suffix", pa.binary()),
        ("back", pa.binary()),
    ]
)
_CONTEXT_DDL = "doc_id long, part int, h long, k long, lo int, n int, suffix binary, back binary"
_REACHED = _CONTEXT.append(pa.field("reach", pa.int32()))
_REACHED_DDL = f"{_CONTEXT_DDL}, reach int"
_VERDICT = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("k", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())]
)
_VERDICT_DDL = "doc_id long, part int, lo int, n int, k long, w1 long, w2 long"
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        ("kept", pa.binary()),
    ]
)
_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, removed array<struct<begin:int,end:int>>, kept binary"


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            for found in anchors(BYTE_CODES[data], offsets, window, gram):
                rows = {name: found[name] for name in ("h", "c", "lo", "reps", "at")}
                rows |= {"doc_id": ids[found["text"]], "part": parts[found["text"]], "n": found["n"] + found["reps"] - 1}
                yield from in_pieces(rows, _ANCHOR)

    return run


def _context_rows(window: int):
    """Cut each listed context out of its text, at the anchor; what stands before it is turned round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc_id, part, text, contexts in zip(*(batch.column(c) for c in ("doc_id", "part", "text", "contexts")), strict=True):
                whole, rows = text.as_py().encode(), contexts.as_py()
                columns = {name: [r[name] for r in rows] for name in ("h", "k", "lo", "n")}
                columns["suffix"] = [whole[r["lo"] + r["at"] : r["lo"] + r["n"] + window - 1] for r in rows]
                columns["back"] = [whole[r["lo"] : r["lo"] + r["at"]][::-1] for r in rows]
                yield to_batch(columns | {"doc_id": [doc_id.as_py()] * len(rows), "part": [part.as_py()] * len(rows)}, _CONTEXT)

    return run


def _padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, filled up with zeros to a whole number of keys, and their lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(8, -(-int(lengths.max(initial=0)) // 8) * 8)
    joined = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(joined, np.uint8).reshape(-1, width), lengths


def multikey_order(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of byte rows by multikey quicksort: split in three by one key of eight bytes, go deeper where it ties.

    The order is that of Spark's binary columns, a string before those that go on from it.
    """
    keys = np.column_stack((rows.view(">u8").astype(np.uint64), lengths.astype(np.uint64)))
    order = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        begin, end, depth = todo.pop()
        own = order[begin:end]
        if end - begin <= 1 or depth == keys.shape[1]:
            continue
        if end - begin <= _SMALL:
            order[begin:end] = own[np.lexsort(keys[own, depth:].T[::-1])]
            continue
        column = keys[own, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        less, more = own[column < pivot], own[column > pivot]
        order[begin:end] = np.concatenate((less, own[column == pivot], more))
        low, high = begin + len(less), end - len(more)
        todo += [(begin, low, depth), (low, high, depth + 1), (high, end, depth)]
    return order


def _common_prefixes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it; the first shares none."""
    out = np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


class _Sorted:
    """Strings in order, ready to say which agree up to any depth."""

    def __init__(self, strings: list[bytes]):
        rows, lengths = _padded(strings)
        self.order = multikey_order(rows, lengths)
        self.shared = _common_prefixes(rows[self.order], lengths[self.order])

    def groups(self, depth: int) -> np.ndarray:
        """A number for each string; strings of that depth at least have the same one if they agree so far."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.shared < depth)
        return out


    def reach(self) -> np.ndarray:
        """The longest prefix that each string shares with another; all of it for the first and the last in order."""
        longest = np.maximum(self.shared, np.append(self.shared[1:], 0))
        out = np.empty(len(self.order), np.int64)
        out[self.order] = longest
        out[self.order[[0, -1]]] = np.iinfo(np.int32).max
        return out


def _reach_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add how far back each context agrees with another of its anchor."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = zip(rows.column("h").to_pylist(), rows.column("back").to_pylist(), strict=True)
        reach = np.maximum(_Sorted([(h + (1 << 63)).to_bytes(8, "big") + back for h, back in keys]).reach() - 8, 0)
        rows = rows.append_column("reach", pa.array(reach, pa.int32()))
        yield from rows.to_batches(max_chunksize=20_000)


def _settle_bucket(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Windows of one bucket that repeat inside it (w1 null), and windows to compare across boundaries."""
    suffixes, backs = rows.column("suffix").to_pylist(), rows.column("back").to_pylist()
    ids, parts, h, k, lo, n, behind = (rows.column(name).to_numpy() for name in ("doc_id", "part", "h", "k", "lo", "n", "reach"))
    right, left = _Sorted(suffixes), _Sorted(backs)
    at = np.fromiter(map(len, backs), np.int64, len(backs))
    flagged = np.zeros((len(at), int(n.max())), bool)
    for back in range(int(at.max()) + 1):
        # The window that starts ``back`` bytes before the anchor, in all contexts that hold it.
        own = np.flatnonzero((at >= back) & (at - back < n))
        if not len(own):
            continue
        key = right.groups(window - back)[own] * (len(at) + 1) + left.groups(back)[own]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        repeats = (count[which] > 1) | (k[own] > 1)
        flagged[own, at[own] - back] = repeats
    lone = np.flatnonzero(k == 1)
    edges = np.diff(np.pad(flagged[lone].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    row = lone[row]
    none = pa.nulls(len(row), pa.int64())
    yield to_batch(
        {"doc_id": ids[row], "part": parts[row], "lo": lo[row] + begin, "n": end - begin, "k": k[row], "w1": none, "w2": none}, _VERDICT
    )
    # What repeats here already is sent on once, for the buckets beside; what does not, to be found in them, if on both
    # sides it stays within what some other context shares.
    ahead, sent = right.reach(), []
    for i in np.flatnonzero(np.isin(h, [h[right.order[0]], h[right.order[-1]]])):
        codes = BYTE_CODES[np.frombuffer(backs[i][::-1] + suffixes[i], np.uint8)]
        settled = flagged[i, : n[i]] | (k[i] > 1)
        back = at[i] - np.arange(n[i])
        start = np.flatnonzero(settled | (back <= behind[i]) & (window - back <= ahead[i]))
        prints = [Runs(codes, salt).of(start, start + window).view(np.int64) for salt in (1, 2)]
        sent.append((np.full(len(start), i), start, *prints, settled[start]))
    row, start, w1, w2, settled = (np.concatenate(part) for part in zip(*sent, strict=True))
    order = np.lexsort((w2, w1, ~settled))
    w1, w2, row, start, settled = w1[order], w2[order], row[order], start[order], settled[order]
    again = np.zeros(len(order), bool)
    again[1:] = settled[1:] & (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
    row, start, w1, w2, settled = (x[~again] for x in (row, start, w1, w2, settled))
    found = {"doc_id": ids[row], "part": parts[row], "lo": lo[row] + start, "n": np.ones(len(row), int)}
    yield from in_pieces(found | {"k": 1 + settled.astype(np.int64), "w1": w1, "w2": w2}, _VERDICT)


def _bucket_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield from _settle_bucket(pa.Table.from_batches(held), window)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            begin, length, row = range_columns(batch.column("ranges"))
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, begin + offsets[row], 1)
            np.add.at(change, begin + offsets[row] + length + window - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            kept, removed = [], []
            touched = np.zeros(batch.num_rows, bool)
            touched[row] = True
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                out = gone[a:b]
                kept.append(data[a:b][~out].tobytes() if touched[i] else data[a:b].tobytes())
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0])))) if touched[i] else np.zeros(0, int)
                removed.append([{"begin": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
            sizes = np.diff(offsets)
            rows = {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_removed": sizes - [len(x) for x in kept]}
            yield to_batch(rows | {"removed": removed, "kept": kept}, _RESULT)

    return run


def suffix_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 64
) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts anywhere else, the same text included.

    Returns a row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``removed`` (maximal byte ranges, end
    exclusive), ``kept`` (the remaining bytes, which need not be whole characters). Texts are taken as UTF-8; a match
    never crosses from one text into another.

    Null text counts as empty, and texts shorter than a window stay whole. A row without id is kept whole and matches
    nothing. Repeated rows are other places, so each loses what it shares with the rest. Other columns are not read.
    An empty table gives an empty result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    base = narrow(docs, id_col, text_col)
    seeds = base.where("doc_id is not null").mapInArrow(_anchor_rows(window, gram), _ANCHOR_DDL)
    shared = seeds.groupBy("h").agg(F.sum("reps").alias("k")).where("k > 1").select("h")
    hits = written(seeds.join(written(shared), "h"))
    spot = F.struct("doc_id", "part", "lo", "n", "reps", "at")
    classes = hits.groupBy("h", "c").agg(F.sum("reps").alias("k"), F.min(spot).alias("r"))
    classes = written(classes.select("h", "c", "k", "r.*"))
    repeated = hits.join(classes.where("k > 1").select("h", "c"), ["h", "c"]).select("doc_id", "part", "lo", "n")
    varied = written(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("k")).where("m > 1 and k = 1").select("h"))
    # One window of a run of equal rows stands for all of them.
    context = F.struct("h", "k", "lo", (F.col("n") - F.col("reps") + 1).alias("n"), F.col("at").cast("int").alias("at"))
    wanted = classes.join(varied, "h").groupBy("doc_id", "part").agg(F.collect_set(context).alias("contexts"))
    texts = base.join(wanted, ["doc_id", "part"]).dropDuplicates(["doc_id", "part"])
    contexts = written(texts.select("doc_id", "part", "text", "contexts").mapInArrow(_context_rows(window), _CONTEXT_DDL))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reached = written(contexts.repartitionByRange(buckets, "h", "back", "doc_id", "lo").mapInArrow(_reach_rows, _REACHED_DDL))
    ordered = reached.repartitionByRange(buckets, "suffix", "back", "doc_id", "lo")
    verdicts = written(ordered.mapInArrow(_bucket_rows(window), _VERDICT_DDL))
    inside = verdicts.where("w1 is null").select("doc_id", "part", "lo", "n")
    edge = verdicts.where("w1 is not null")
    met = edge.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    across = edge.where("k = 1").join(written(met.select("w1", "w2")), ["w1", "w2"]).select("doc_id", "part", "lo", "n")
    ranges = repeated.union(inside).union(across)
    cut = base.join(listed(ranges), ["doc_id", "part"], "left").select("doc_id", "text", "ranges")
    return cut.mapInArrow(_cut(window), _RESULT_DDL)
