"""Near-duplicate vectors: spherical k-means cells, cosine products in blocks, one vector kept of each group.

Centroids are fitted on a bounded sample. Every distinct vector is at home in the cell of its nearest centroid, and a
guest in each cell whose border is near. The border of two cells is the plane between their centroids: of two vectors at
the threshold that it parts, one lies within half their angle of it, so no link is missed. In a cell the home vectors
are compared with all of its vectors, in blocks of bounded size; a pair that two cells see is counted in one of them.
Equal vectors are one until the end.

Where differences spread over many dimensions most borders are near, and more cells mean more copies for few pairs less;
how many cells there are is therefore chosen by an estimate of both on the sample, one cell for all included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallygrain.llm.common import to_batch, written
from tallygrain.llm.graph import components

SAMPLE = 16_384  # vectors that the centroids are fitted on, about
CELL = 512  # distinct vectors of the smallest cells that are tried, about
MOST_CELLS = 1_024
STEPS = 12  # of k-means
TRIED = 2_048  # vectors of the sample by which a number of cells is judged
COPY = 2_048  # products that cost as much as one more copy of a vector, about
BLOCK = 1_024  # vectors on either side of one product
MOST_ROWS, MOST_NUMBERS = 8_192, 1 << 22  # vectors, and numbers in them, on either side of what a task holds at a time
SLACK = 1e-7  # beyond the rounding of distances to a border

_PLACED = [
    ("node", pa.int64()),
    ("n", pa.int64()),
    ("dim", pa.int32()),
    ("cell", pa.int32()),
    ("home", pa.int32()),
    ("cells", pa.list_(pa.int32())),
]
_PLACED_DDL = "node long, n long, dim int, cell int, home int, cells array<int>"
_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length one."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # By the largest part first, so that squares neither vanish nor overflow.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centroids; an empty cell keeps the centroid it had."""
    random = np.random.Generator(np.random.PCG64(seed))
    centroids = rows[random.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(STEPS):
        nearest = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centroids)
    return centroids


def _fit(classes: DataFrame, sample: int, cosine: float) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from about ``sample`` distinct vectors picked by hash."""
    sizes = {row.dim: row.n for row in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    steps = 1 << 30
    share = int(steps * min(1.0, sample / total))
    picked = classes.where(F.pmod(F.xxhash64("vector"), F.lit(steps)) < share).select("dim", "vector").limit(2 * sample)
    rows = picked.orderBy(F.xxhash64("vector")).toArrow()
    out = {}
    for dim, count in sizes.items():
        own = rows.filter(pc.equal(rows.column("dim"), dim))
        if own.num_rows:
            out[dim] = _cheapest(_unit(own.column("vector")), count, cosine)
    return out


def _cheapest(rows: np.ndarray, count: int, cosine: float) -> np.ndarray:
    """Centroids of as many cells as make copies and products of ``count`` vectors cheapest, judged on some ``rows``."""
    best, least, cells = None, np.inf, min(MOST_CELLS, max(1, count // CELL))
    held = max(BLOCK, min(MOST_ROWS, MOST_NUMBERS // rows.shape[1]))
    while True:
        centroids = spherical_kmeans(rows, cells)
        home, inside = _cells(rows[:TRIED], centroids, cosine)
        homes, members = (x * count / len(home) for x in (np.bincount(home, minlength=len(centroids)), inside.sum(axis=0)))
        copies = (homes * np.ceil(members / held) + members * np.ceil(homes / held)).sum()
        cost = COPY * copies + (homes * members).sum()
        if cost < least:
            best, least = centroids, cost
        if cells == 1:
            return best
        cells = max(1, cells // 4)


def _cells(rows: np.ndarray, centroids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and for every vector and cell whether it lives there or near its border."""
    near = rows @ centroids.T
    home = near.argmax(axis=1)
    own = centroids[home]
    gap = np.sqrt(np.maximum(2 - 2 * (own @ centroids.T), 1e-30))
    reach = np.sqrt(max(0.0, (1 - cosine) / 2))
    inside = near[np.arange(len(rows)), home][:, None] - near <= reach * gap + SLACK
    inside[np.arange(len(rows)), home] = True
    return home, inside


def _roots(rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
    """Smallest position that each position is tied to by the given ties."""
    root = np.arange(count)
    while True:
        before = root.copy()
        least = np.minimum(root[rows], root[columns])
        np.minimum.at(root, rows, least)
        np.minimum.at(root, columns, least)
        root = root[root]
        if (root == before).all():
            return root


def _close(left: np.ndarray, right: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs at the threshold, block by block.

    Products are taken in single precision; those that its rounding leaves open are taken again in double precision.
    """
    doubt = (left.shape[1] + 4) * 1.2e-7
    many = max(1, MOST_NUMBERS // left.shape[1])
    short_left, short_right = left.astype(np.float32), right.astype(np.float32)
    for x in range(0, len(left), BLOCK):
        for y in range(0, len(right), BLOCK):
            product = short_left[x : x + BLOCK] @ short_right[y : y + BLOCK].T
            i, j = np.nonzero(product >= np.float32(cosine - doubt))
            good = product[i, j] > cosine + doubt
            open_ = np.flatnonzero(~good)
            i, j = i + x, j + y
            for k in range(0, len(open_), many):
                part = open_[k : k + many]
                good[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= cosine
            if good.any():
                yield i[good], j[good]


def _compare(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        left = group.filter(pc.equal(group.column("side"), 0))
        right = group.filter(pc.equal(group.column("side"), 1))
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        cell = group.column("cell")[0].as_py()
        a, b = left.column("node").to_numpy(), right.column("node").to_numpy()
        n_left, n_right = left.column("n").to_numpy(), right.column("n").to_numpy()
        guest_homes = right.column("home").to_numpy()
        visited = left.column("cells").combine_chunks()
        flat = visited.flatten().to_numpy()
        visits = np.zeros((len(a), 1 + max(flat.max(), guest_homes.max())), bool)
        visits[np.repeat(np.arange(len(a)), pc.list_value_length(visited).to_numpy()), flat] = True
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for i, j in _close(_unit(left.column("vector")), _unit(right.column("vector")), cosine):
            # Both at home here: each pair shows up twice, so one order counts. A guest's pair may also show up at its home.
            guest_home = guest_homes[j]
            elsewhere = (guest_home < cell) & visits[i, guest_home]
            counted = np.where(guest_home == cell, a[i] < b[j], ~elsewhere)
            i, j = i[counted], j[counted]
            if not len(i):
                continue
            p, q = place[i], place[len(a) + j]
            links += np.bincount(p, n_right[j], len(nodes)).astype(np.int64)
            links += np.bincount(q, n_left[i], len(nodes)).astype(np.int64)
            root = _roots(np.concatenate((p, np.arange(len(nodes)))), np.concatenate((q, root)), len(nodes))
        used = np.flatnonzero(links)
        return pa.Table.from_batches([to_batch({"node": nodes[used], "links": links[used], "root": nodes[root[used]]}, _FOUND)])

    return run


def embedding_near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, sample: int = SAMPLE
) -> DataFrame:
    """Link vectors whose cosine, in double precision, is ``cosine`` or more, and group them by links.

    Returns a row per input row: ``vec_id``, ``n_links`` (other vectors linked directly, copies included),
    ``component_id`` (smallest id reachable by links, itself included), ``kept`` (the id is its component's).

    Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing, nor does a row without id,
    which is kept under a null component. Vectors of another length never link. An id with several vectors is one
    member of its group and has the links of all of them. Other columns are not read. An empty table gives an empty
    result.
    """
    # Vectors travel as they came, in single precision where that is what they are; products are in double precision.
    kind = "float" if vectors.schema[vector_col].dataType == ArrayType(FloatType(), True) else "double"
    schema = pa.schema([*_PLACED, ("vector", pa.list_(pa.float32() if kind == "float" else pa.float64()))])
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    able = F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))
    grouped = rows.where(able).groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = written(grouped.select("vector", "node", "n", F.size("vector").alias("dim")))
    shared = vectors.sparkSession.sparkContext.broadcast(_fit(classes, sample, cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                alike = batch.filter(pc.equal(batch.column("dim"), dim))
                for begin in range(0, alike.num_rows, BLOCK):
                    part = alike.slice(begin, BLOCK)
                    rows = _unit(part.column("vector"))
                    centroids = shared.value.get(dim)
                    if centroids is None:
                        home, inside = np.zeros(len(rows), int), np.ones((len(rows), 1), bool)
                    else:
                        home, inside = _cells(rows, centroids, cosine)
                    row, cell = np.nonzero(inside)
                    # Only the row at home says which cells its vector visits.
                    lists = [np.flatnonzero(x) for x in inside]
                    columns = {name: part.column(name).take(pa.array(row)) for name in ("node", "n", "dim", "vector")}
                    columns |= {"cell": cell, "home": home[row], "cells": [lists[x] if home[x] == c else None for x, c in zip(row, cell)]}
                    yield to_batch(columns, schema)

    placed = written(classes.mapInArrow(place, f"{_PLACED_DDL}, vector array<{kind}>"))
    at_home = F.col("home") == F.col("cell")
    held = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_ROWS), F.floor(F.lit(MOST_NUMBERS) / F.col("dim"))))
    sizes = placed.groupBy("dim", "cell").agg(F.sum(at_home.cast("int")).alias("homes"), F.count(F.lit(1)).alias("all"))
    sizes = sizes.select("dim", "cell", *[F.ceil(F.col(c) / held).cast("int").alias(c) for c in ("homes", "all")])
    # A row for each cell at most, a few thousand.
    cut = placed.join(F.broadcast(sizes), ["dim", "cell"])
    spot = F.xxhash64("node", "vector")
    left = cut.where(at_home).select("*", F.pmod(spot, "homes").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(0).alias("side"))
    right = cut.where("homes > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), F.pmod(spot, "all").cast("int").alias("j"), F.lit(1).alias("side"))
    wanted = ["dim", "cell", "i", "j", "side", "node", "n", "home", "cells", "vector"]
    blocks = left.select(wanted).union(right.select(wanted)).groupBy("dim", "cell", "i", "j")
    found = written(blocks.applyInArrow(_compare(cosine), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # An id with several vectors holds their groups together as it is one node.
    several = rows.where(able).join(classes.select("vector", "node"), "vector").where("vec_id <> node")
    ids = several.groupBy("vec_id").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    ties = ids.where("node <> last").select(F.col("vec_id").alias("node"), F.col("node").alias("root"))
    ties = ties.union(ids.where("node <> last").select(F.col("vec_id").alias("node"), F.col("last").alias("root")))
    labels = components(found.select("node", "root").where("node <> root").union(ties), "node", "root")
    joined = (
        rows.join(classes.select("vector", "node", "n"), "vector", "left")
        .join(links, "node", "left")
        .join(labels.withColumnRenamed("id", "node"), "node", "left")
    )
    linked = able & F.col("node").isNotNull()
    component = F.when(linked, F.coalesce("component_id", "node")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(linked, F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
