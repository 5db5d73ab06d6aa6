"""Near-duplicate documents by HyperMinHash sketches, banded, with every link confirmed on full shingle sets.

A sketch has ``REGISTERS`` buckets. A bucket holds the least hash that fell into it as a small float: the count of
leading zeros and ``MANTISSA_BITS`` bits after them. Documents with equal shingle sets collapse first. Of the rest,
documents that agree in all registers of a band share a bucket.

Buckets are not expanded into pairs. In each one, every member is compared with the smallest id; a bucket whose
members are then in one component is settled. For members of the others there is an exact way: two of them can only
link if they share one of their rarest shingles, so they meet at these, and only across components. Pairs whose
estimated similarity, corrected for chance agreement of registers, is far below the threshold are dropped before
verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import in_pieces, narrow, to_batch, written
from tallygrain.llm.graph import components
from tallygrain.llm.tokens import Runs, lower, mix, slices, text_bytes, word_codes, words

REGISTERS = 256
MANTISSA_BITS = 10
BAND = 6  # registers of a band: 42 bands, which miss a pair at 0.85 once in 400 million
CROWD = 8  # texts at a rare shingle from which they meet one among them first
DEVIATIONS = 8  # a pair is dropped unverified only if its estimate is so many standard errors below the threshold
COLLISION = 0.169919487159739  # fixed value: the chance term of the published HyperMinHash estimator
_EMPTY = np.uint16(0xFFFF)

_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("registers", pa.binary())]
)
_SKETCH_DDL = "doc_id long, part int, n_shingles long, f1 long, f2 long, registers binary"
_BUCKET = pa.schema([("key", pa.int64()), ("node", pa.int64())])
_BUCKET_DDL = "key long, node long"
_SET = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
_MEMBER = pa.schema([("s", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIR_DDL = "a long, b long"


def _shingles(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and where each text's begin (one more than texts)."""
    data, offsets = text_bytes(batch.column("text"))
    data = lower(data)
    starts, ends, counts = words(data, offsets)
    runs = Runs(word_codes(data, starts, ends))
    text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    grams = runs.grams(size)
    inside = np.flatnonzero(np.arange(len(grams)) + size <= counts[text[: len(grams)] + 1])
    few = np.flatnonzero((np.diff(counts) > 0) & (np.diff(counts) < size))
    hashes = np.concatenate((grams[inside], runs.of(counts[few], counts[few + 1])))
    text = np.concatenate((text[inside], few))
    order = np.argsort(text, kind="stable")
    hashes, text = mix(hashes[order]), text[order]
    edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(batch.num_rows + 1))


def _registers(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of registers for each text."""
    bucket_bits = REGISTERS.bit_length() - 1
    out = np.full((len(edges) - 1, REGISTERS), _EMPTY)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    bucket = (hashes >> np.uint64(64 - bucket_bits)).astype(np.int64)
    # Hashes are sorted within a text, so the first of a bucket is its least.
    first = np.ones(len(hashes), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])
    rest = hashes[first] << np.uint64(bucket_bits)
    # A hash below 2^-53 of the range would round up; such bits are beyond the mantissa that is kept.
    fraction, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    zeros = np.where(rest >> np.uint64(11) == 0, 53, 53 - exponent)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).clip(0).astype(np.int64)
    out[text[first], bucket[first]] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


def _sketch_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            hashes, edges = _shingles(batch, size)
            registers = _registers(hashes, edges)
            count = np.diff(edges)
            # In whole numbers throughout: sums wrap around, and so do their differences.
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64))) for salt in (3, 5)]
            yield to_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "part": batch.column("part"),
                    "n_shingles": count,
                    "f1": (sums[0][edges[1:]] - sums[0][edges[:-1]]).view(np.int64),
                    "f2": (sums[1][edges[1:]] - sums[1][edges[:-1]]).view(np.int64),
                    "registers": [row.tobytes() if n else None for row, n in zip(registers, count, strict=True)],
                },
                _SKETCH,
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _filled(registers: np.ndarray) -> np.ndarray:
    """Empty registers lent a value by the full one that comes first in an order of their own, the same for all texts.

    Small sets leave most registers empty; without this a band of theirs would rest on a single shingle.
    """
    turns = np.random.Generator(np.random.PCG64(17)).random((REGISTERS, REGISTERS)).argsort(axis=1).astype(np.uint16)
    out = registers.copy()
    for row, own in zip(out, registers, strict=True):
        full = np.flatnonzero(own != _EMPTY)
        empty = np.flatnonzero(own == _EMPTY)
        if len(empty):
            lender = full[turns[np.ix_(empty, full)].argmin(axis=1)]
            row[empty] = own[lender]
    return out


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        registers = _filled(_matrix(batch.column("registers")))
        for band in range(REGISTERS // BAND):
            key = np.full(len(node), band, np.uint64)
            for column in registers[:, band * BAND : (band + 1) * BAND].T:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
            yield from in_pieces({"key": key.view(np.int64), "node": node}, _BUCKET)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity from registers, less the agreement expected by chance; and the registers it rests on."""
    used = (left != _EMPTY) | (right != _EMPTY)
    equal = ((left == right) & used).sum(axis=1)
    ratio = np.maximum(n_left, n_right) / np.minimum(n_left, n_right)
    chance = COLLISION * REGISTERS / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    n_used = np.maximum(used.sum(axis=1), 1)
    return (equal - np.minimum(chance, equal)) / n_used, n_used


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess, used = estimate(
                _matrix(batch.column("ra")), _matrix(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            )
            margin = DEVIATIONS * np.sqrt(threshold * (1 - threshold) / used)
            yield batch.select(["a", "b"]).filter(pa.array(guess >= threshold - margin))

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            hashes, edges = _shingles(batch, size)
            rows = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield to_batch({"node": batch.column("doc_id"), "n": np.diff(edges), "shingles": rows}, _SET)

    return run


def _set_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, n, label, shingles in zip(*(batch.column(c) for c in ("node", "n", "label", "shingles")), strict=True):
            values = np.frombuffer(shingles.as_buffer(), np.int64)
            columns = {name: np.full(len(values), x.as_py()) for name, x in (("node", node), ("n", n), ("label", label))}
            yield from in_pieces(columns | {"s": values}, _MEMBER)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.searchsorted(x, y)
                both = int((x[np.minimum(place, len(x) - 1)] == y).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Verifier:
    """Confirms candidate pairs on full shingle sets; every pair is looked at once."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, percent
        self.links: list[DataFrame] = []

    def add(self, pairs: DataFrame) -> None:
        percent = self.percent
        side = self.sketches.select("node", "registers", F.col("n_shingles").alias("n"))
        known = pairs.join(side.toDF("a", "ra", "na"), "a").join(side.toDF("b", "rb", "nb"), "b")
        likely = written(known.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely(percent / 100), _PAIR_DDL))
        full = likely.join(self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        full = full.join(self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        self.links.append(written(full.select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), _PAIR_DDL)))

    def all_links(self) -> DataFrame:
        out = self.links[0]
        for more in self.links[1:]:
            out = out.union(more)
        return out


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each node (node, n, label, shingles): two nodes that link share one of them.

    A link needs ``percent`` hundredths of the larger set in common, so leaving out one shingle less than that many
    leaves a shared one, whatever the order, as long as it is the same for all. Shingles that no other node has are
    counted out: ``m`` are not, and a node with too many of its own can link with none. ``left`` counts the shingles
    from this one on.
    """
    rows = sets.mapInArrow(_set_members, "s long, node long, n long, label long")
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = written(rows).join(written(common), "s", "left")
    listed = ranked.groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("l"))
    keep = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    listed = listed.withColumn("m", F.expr("size(filter(l, x -> x.df > 1))").cast("long")).where(100 * F.col("m") >= percent * F.col("n"))
    picked = listed.select("node", "n", "m", "label", F.posexplode(F.slice("l", F.lit(1), keep)).alias("i", "x"))
    return written(picked.where("x.df > 1").select("x.s", "node", "n", "m", "label", (F.col("n") - F.col("i")).alias("left")))


def _around_hubs(rare: DataFrame, verifier: _Verifier, percent: int) -> DataFrame:
    """The rows of ``rare`` with labels of their own anew, after each crowded shingle's texts met one among them.

    That one is the text with the largest share of shingles that others have too: of a template and its many variants,
    the template, to which most variants are linked even where few are linked to each other. Their number at a shingle
    then counts once, by the label, and only what is still apart meets in pairs. No pair is passed over by this.
    """
    share = F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("node")).alias("least"), "n", "m", "label", "left")
    hubs = rare.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.max(share).alias("hub")).where(F.col("k") > CROWD)
    most = F.least("m", "hub.m", "left", "hub.left")
    star = rare.join(hubs, "s").withColumn("centre", -F.col("hub.least")).where("node <> centre and label <> hub.label")
    star = star.where(100 * most >= percent * (F.col("n") + F.col("hub.n") - most))
    verifier.add(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    labels = written(components(verifier.all_links(), "a", "b")).toDF("node", "new")
    return written(rare.join(labels, "node", "left").withColumn("label", F.coalesce("new", "node")).select(rare.columns))


def _settle(members: DataFrame, verifier: _Verifier, percent: int) -> DataFrame:
    """Component of each node in ``members`` (key, node) that has a link."""
    centred = written(members.groupBy("key").agg(F.min("node").alias("centre")))
    star = members.join(centred, "key").where("centre < node")
    verifier.add(star.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    labels = written(components(verifier.all_links(), "a", "b"))
    known = labels.toDF("node", "label")
    labelled = members.join(known, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled)
    state = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k"))
    # A bucket of two has been looked at in full.
    unsettled = written(state.where("x < y and k > 2").select("key"))
    rest = labelled.join(unsettled, "key").select("node", "label").distinct()
    rare = _around_hubs(_rare_first(verifier.sets.join(rest, "node"), percent), verifier, percent)
    other = rare.toDF("s", "node2", "n2", "m2", "label2", "left2")
    # At the first shingle that two nodes share, what they have left must be enough for a link.
    most = F.least("m", "m2", "left", "left2")
    met = rare.join(other, "s").where("node < node2 and label <> label2")
    met = met.where(100 * most >= percent * (F.col("n") + F.col("n2") - most))
    verifier.add(met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct())
    return components(verifier.all_links(), "a", "b")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more, transitively.

    Returns a row per input row: ``doc_id``, ``n_shingles`` (distinct shingles), ``component_id`` (smallest id
    reachable over links, itself included), ``kept`` (the id is its component's).

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer words than a shingle has
    its whole sequence as the only one; null, empty and blank texts have none and are linked with nothing. Rows that
    share an id are one document. A row without id is linked with nothing and kept, under a null component. Other
    columns are not read. An empty table gives an empty result.
    """
    base = narrow(docs, id_col, text_col)
    sketches = written(base.mapInArrow(_sketch_rows(shingle), _SKETCH_DDL))
    linkable = sketches.where("doc_id is not null and n_shingles > 0")
    classes = linkable.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "part", "n_shingles", "registers")).alias("r"))
    classes = written(classes.select("f1", "f2", F.col("r.doc_id").alias("node"), "r.part", "r.n_shingles", "r.registers"))
    rows = classes.select("node", "registers").mapInArrow(_bucket_rows, _BUCKET_DDL)
    crowded = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"))
    members = written(rows.join(crowded, "key"))
    wanted = members.select("node").distinct().join(classes.select("node", "part"), "node")
    texts = base.join(wanted.withColumnRenamed("node", "doc_id"), ["doc_id", "part"])
    sets = texts.select("doc_id", "text").mapInArrow(_set_rows(shingle), "node long, n long, shingles binary")
    sets = written(sets.dropDuplicates(["node", "shingles"]))
    verifier = _Verifier(classes, sets, percent)
    # An id with several texts ties their classes together.
    own = linkable.select("f1", "f2", "doc_id").join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    several = own.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("doc_id")
    verifier.links.append(written(own.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    labels = _settle(members, verifier, percent)
    placed = (
        sketches.select("doc_id", "n_shingles", "f1", "f2")
        .join(classes.select("f1", "f2", "node"), ["f1", "f2"], "left")
        .join(labels.select(F.col("id").alias("node"), "component_id"), "node", "left")
    )
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "node"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
