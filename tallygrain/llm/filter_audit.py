"""How document filters interact: what each one removes, and would have removed, in every order they can be applied in.

A document's outcome under all orders depends only on which filters it fails, its mask. A mask becomes one big integer
with a field for each order and step; a field holds four counters of 64 bits: kept, removed, redundant, unique. The
integers of a part are added up, weighted by the number of documents with that mask, and the fields of the sum are read
back. A counter never carries into its neighbour, as a part has fewer than 2^64 documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

MOST_FILTERS = 6  # the integer has filters! x filters fields
WIDTH = 64  # bits of a counter
COUNTERS = ("kept", "removed", "redundant", "unique")
SPACE = r"[\x20\x09-\x0D]+"


@cache
def packed(mask: int, filters: int) -> int:
    """The integer of a mask: for every order and step, which of the four counters a document with this mask raises."""
    rows = []
    for order in permutations(range(filters)):
        gone = False
        for own in order:
            fails = bool(mask >> own & 1)
            rows.append((not gone and not fails, not gone and fails, gone and fails, mask == 1 << own))
            gone = gone or fails
    return int.from_bytes(np.array(rows, "<u8").tobytes(), "little")


def unpacked(total: int, filters: int) -> np.ndarray:
    """The counters of a sum of integers: orders, steps, counters."""
    orders = factorial(filters)
    data = total.to_bytes(orders * filters * len(COUNTERS) * WIDTH // 8, "little")
    return np.frombuffer(data, "<u8").astype(np.int64).reshape(orders, filters, len(COUNTERS))


def filter_interactions(
    rows: DataFrame,
    filters: Sequence[str],
    *,
    part_col: str,
    marks: Sequence[str] = (),
    count_col: str | None = None,
) -> DataFrame:
    """One row per part, order of the filters and step, with what happens there.

    ``filters`` and ``marks`` name boolean columns of ``rows``: whether the row fails a filter, and whether it has a
    mark whose losses are counted. ``count_col`` is the number of documents that a row stands for, one by default.
    Columns: ``part``, ``filter_order`` (names joined), ``step`` (from 1), ``kept`` after the step, ``removed`` in it,
    ``redundant`` (fail the step's filter but are gone), ``unique_fails`` (fail that filter only), ``<mark>_lost``
    (removed here with the mark) and ``shapley`` (removed by that filter, over all orders).

    Rows are counted by part, mask and marks before they meet, so a part's group holds at most a row for each. A null
    part counts as the empty string, null flags as false, null counts as none. No rows give no result. Repeated rows
    count as often as they occur; other columns are not read.
    """
    filters, marks = list(filters), list(marks)
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"give 1 to {MOST_FILTERS} filters with names of their own")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("boolean"), F.lit(False)).cast("int")

    mask = sum((flag(name) * (1 << i) for i, name in enumerate(filters)), F.lit(0))
    mark = sum((flag(name) * (1 << i) for i, name in enumerate(marks)), F.lit(0))
    weight = F.lit(1).cast("long") if count_col is None else F.col(f"`{count_col}`").cast("long")
    counted = (
        rows.select(
            F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), mark.alias("mark"), weight.alias("n")
        )
        .groupBy("part", "mask", "mark")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    orders = list(permutations(range(len(filters))))
    names = ["".join(filters[i] for i in order) for order in orders]
    own = np.array(orders)
    fields = [StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType())]
    numbers = ["kept", "removed", "redundant", "unique_fails", *[f"{name}_lost" for name in marks], "shapley"]
    schema = StructType(fields + [StructField(name, LongType()) for name in numbers])
    return counted.groupBy("part").applyInArrow(_audit(len(filters), len(marks), names, own, numbers), schema)


def _audit(filters: int, marks: int, names: list[str], own: np.ndarray, numbers: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        sums = [0] * (marks + 1)  # of all documents, and of those with each mark
        for mask, mark, n in zip(*(table.column(c).to_pylist() for c in ("mask", "mark", "n")), strict=True):
            integer = n * packed(mask, filters)
            sums[0] += integer
            for i in range(marks):
                if mark >> i & 1:
                    sums[i + 1] += integer
        every = unpacked(sums[0], filters)
        removed = COUNTERS.index("removed")
        shapley = np.array([every[own == i][:, removed].sum() for i in range(filters)])
        values = [*np.moveaxis(every, 2, 0), *[unpacked(x, filters)[:, :, removed] for x in sums[1:]], shapley[own]]
        steps, part = own.size, table.column("part")[0].as_py()
        columns = {
            "part": pa.array([part] * steps, pa.string()),
            "filter_order": pa.array(np.repeat(np.array(names, object), filters), pa.string()),
            "step": pa.array(np.tile(np.arange(1, filters + 1), len(names)), pa.int32()),
        }
        return pa.table(columns | {name: pa.array(x.ravel(), pa.int64()) for name, x in zip(numbers, values, strict=True)})

    return run


def document_failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Which of five filters documents fail, counted: ``part``, ``A`` to ``E``, ``good``, ``toxic`` and ``n`` documents.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 3 % capital letters A-Z. D: any of
    ``#$%&*|``. E: the same text as a document with a smaller id. ``good`` and ``toxic`` are the labels' 1; a document
    whose label rows differ has a mark if any row says so, one without label rows has none.

    Null texts count as empty. Rows with one id and one text are documents of their own, but neither has the smaller
    id. A document without id is never smaller nor larger than another. Whole texts are read; what meets in a shuffle is
    a checksum, flags and counts, and copies are counted together before they meet, so no group of copies is one task's.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda word: word != "")
    split = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        words.alias("words"),
    )
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flagged = split.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("code"),
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * F.size("words").cast("long")).alias("B"),
        (100 * capitals.cast("long") > 3 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    flags = ["A", "B", "C", "D"]
    ids = flagged.groupBy("doc_id", "part", "code", *flags).agg(F.count(F.lit(1)).alias("n"))
    marked = ids.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    alike = marked.groupBy("code", "part", *flags, "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without"),
    )
    # At most a row for each part and pair of marks has one text, so the window is small whatever the number of copies.
    first = F.min("least").over(Window.partitionBy("code"))
    alone = F.col("n_without") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(
        F.struct(F.lit(False).alias("E"), F.col("alone").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("alone")).alias("n"))
    )
    return (
        alike.withColumn("first", first)
        .withColumn("alone", alone)
        .select("part", *flags, "good", "toxic", F.inline(both))
        .where("n > 0")
        .select("part", *flags, "E", "good", "toxic", "n")
    )
