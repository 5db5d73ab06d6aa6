"""Document cleaning, chunking and exact vector search.

Texts are cleaned and cut with row-local expressions over whole texts, so no shuffle moves them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain.functions.exprs import col

TARGET_TOKENS = 550
MAX_TOKENS = 700
MAX_TOP_K = 20

# Blanks that may stand at the ends of a line, and the characters that end one.
_BLANK = r"[ \t\x1F\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
# One class, not an alternation: a long run of blanks must not deepen the stack.
_EDGE = r"[ \t\n\x1F\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
_LINE_END = r"\r\n|[\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"


# --- text ------------------------------------------------------------------------------------


def clean_text(text: Column | str) -> Column:
    """One space for runs of blanks, trimmed lines, at most one empty line in a row."""
    value = F.regexp_replace(col(text), _LINE_END, "\n")
    value = F.regexp_replace(value, r"[ \t]+", " ")
    value = F.regexp_replace(value, f"{_BLANK}*\n{_BLANK}*", "\n")
    value = F.regexp_replace(value, r"\n{3,}", "\n\n")
    return F.regexp_replace(value, rf"\A{_EDGE}+|{_EDGE}+\z", "")


def estimated_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.ceil(F.length(col(text)) / 4), F.lit(1)).cast("int")


def sections(text: Column | str, title: Column | str) -> Column:
    """Array of (section, paragraphs) of a cleaned Markdown text.

    The text is split in front of each heading line; what comes before the first one belongs to the
    title. Sections without a body are left out.
    """
    pieces = F.split(clean_text(text), r"(?md)(?=^#{1,6}\s+\S)")

    def opened(piece: Column) -> Column:
        headed = piece.rlike(r"\A#{1,6}\s+\S")
        name = F.when(headed, F.regexp_extract(piece, r"\A#{1,6}\s+([^\n]*)", 1)).otherwise(col(title))
        body = clean_text(F.when(headed, F.regexp_replace(piece, r"\A[^\n]*", "")).otherwise(piece))
        return F.struct(F.trim(name).alias("section"), body.alias("body"))

    kept = F.filter(F.transform(pieces, opened), lambda s: s["body"] != "")
    return F.transform(
        kept, lambda s: F.struct(s["section"].alias("section"), F.split(s["body"], "\n\n").alias("paragraphs"))
    )


def line_section(text: Column | str, section: Column | str) -> Column:
    """One section whose paragraphs are the non-empty lines of a cleaned text; no line gives no chunk."""
    lines = F.filter(F.split(clean_text(text), "\n"), lambda line: line != "")
    return F.array(F.struct(col(section).alias("section"), lines.alias("paragraphs")))


def _piece_bounds(target: int, largest: int) -> str:
    """D3: SQL text folding paragraph lengths ``lens`` after a prefix of ``lead`` characters into pieces.

    A piece is (first paragraph, paragraph count, characters). It closes when it reaches the target,
    or before a paragraph that would take it past the maximum. A short tail joins the piece before
    it where both fit. Only lengths are folded; texts are joined once, afterwards.
    """

    def tokens(length: str) -> str:
        return f"greatest(ceil(({length}) / 4), 1)"

    piece = "struct<first:int,count:int,chars:int>"
    start = f"named_struct('first', 0, 'count', 0, 'chars', 0, 'out', CAST(array() AS array<{piece}>))"
    step = f"""
      transform(array(s.count > 0 AND {tokens('lead + s.chars + 2 + p.len')} > {largest}), over ->
        transform(array(named_struct(
            'first', IF(over OR s.count = 0, p.i, s.first),
            'count', IF(over, 1, s.count + 1),
            'chars', IF(over OR s.count = 0, p.len, s.chars + 2 + p.len))), b ->
          named_struct(
            'first', b.first,
            'count', IF({tokens('lead + b.chars')} >= {target}, 0, b.count),
            'chars', b.chars,
            'out', concat(
              IF(over, concat(s.out, array(named_struct('first', s.first, 'count', s.count, 'chars', s.chars))), s.out),
              IF({tokens('lead + b.chars')} >= {target}, array(b), CAST(array() AS array<{piece}>))))
        )[0])[0]"""
    tail = "array(named_struct('first', s.first, 'count', s.count, 'chars', s.chars))"
    before = "element_at(s.out, -1)"
    finish = f"""
      CASE WHEN s.count = 0 THEN s.out
        WHEN size(s.out) > 0 AND {tokens('lead + s.chars')} < {target // 2}
          AND {tokens(f'lead + {before}.chars + 2 + s.chars')} <= {largest}
        THEN concat(slice(s.out, 1, size(s.out) - 1), array(named_struct('first', {before}.first,
          'count', {before}.count + s.count, 'chars', {before}.chars + 2 + s.chars)))
        ELSE concat(s.out, {tail}) END"""
    return f"aggregate(lens, {start}, (s, p) -> {step}, s -> {finish})"


def chunk_documents(
    documents: DataFrame,
    *,
    key: str,
    title: str,
    parts: str,
    target_tokens: int = TARGET_TOKENS,
    max_tokens: int = MAX_TOKENS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Chunks of every document, from the ``parts`` array of (section, paragraphs).

    Each chunk starts with its document title and section. ``carry`` names further document columns.
    """
    if target_tokens < 1 or max_tokens < target_tokens:
        raise ValueError("max_tokens must be at least target_tokens, and that at least one")
    opened = documents.select(
        F.col(key).alias("document_id"), F.col(title).alias("document_title"), *carry, F.col(parts).alias("_parts")
    )
    lead = F.concat(F.lit("Document: "), F.col("document_title"), F.lit("\nSection: "))
    measured = opened.withColumn(
        "_parts",
        F.transform(
            "_parts",
            lambda s: F.struct(
                s["section"].alias("section"),
                s["paragraphs"].alias("paragraphs"),
                F.concat(lead, s["section"], F.lit("\n\n")).alias("prefix"),
                F.transform(
                    s["paragraphs"], lambda p, i: F.struct((i + 1).alias("i"), F.length(p).alias("len"))
                ).alias("lens"),
            ),
        ),
    )
    cut = _piece_bounds(target_tokens, max_tokens)
    cut_part = cut.replace("aggregate(lens,", "aggregate(part.lens,").replace("lead +", "length(part.prefix) +")
    pieces = F.expr(
        f"""flatten(transform(_parts, part -> transform({cut_part}, piece -> named_struct(
          'section', part.section,
          'content', concat(part.prefix, array_join(slice(part.paragraphs, piece.first, piece.count), '\\n\\n'))))))"""
    )
    return (
        measured.select("document_id", "document_title", *carry, F.posexplode(pieces).alias("_at", "_piece"))
        .select(
            F.format_string("%s-C%03d", F.col("document_id").cast("string"), F.col("_at") + 1).alias("chunk_id"),
            "document_id",
            "document_title",
            *carry,
            F.col("_piece.section").alias("section"),
            (F.col("_at") + 1).alias("chunk_index"),
            F.col("_piece.content").alias("content"),
        )
        .withColumns({"content_hash": F.sha2("content", 256), "estimated_tokens": estimated_tokens("content")})
    )


def documents_without_chunks(documents: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk."""
    return documents.select(F.col(key).alias("document_id")).join(
        chunks.select("document_id").distinct(), "document_id", "left_anti"
    )


# --- vectors ---------------------------------------------------------------------------------


def vector_problem(vector: Column | str, dimensions: int) -> Column:
    """What breaks the vector contract, or null."""
    v = col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(v.isNull(), "missing").when(F.size(v) != dimensions, "wrong size").when(~finite, "not finite")
    )


def vector_problems(frame: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """Rows whose vector is missing, has the wrong size or holds a non-finite value."""
    return frame.select(key, vector_problem(vector, dimensions).alias("problem")).filter("problem IS NOT NULL")


def _vector_state(vectors: DataFrame, key: str, dimensions: int) -> DataFrame:
    """Per key, how many vectors there are and what is wrong with one of them."""
    marked = vectors.select(key, vector_problem("embedding", dimensions).alias("problem"))
    return marked.groupBy(key).agg(F.count("*").alias("_n"), F.min("problem").alias("_problem"))


def vector_rejects(chunks: DataFrame, vectors: DataFrame, key: str, dimensions: int) -> DataFrame:
    """Chunks without exactly one valid vector, and why: missing, repeated, or what breaks the contract."""
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").otherwise(F.col("_problem"))
    state = _vector_state(vectors, key, dimensions)
    return chunks.join(state, key, "left").select(chunks["*"], problem.alias("problem")).filter("problem IS NOT NULL")


def attach_vectors(
    chunks: DataFrame, vectors: DataFrame, key: str, *, model: str, dimensions: int, check: bool = True
) -> DataFrame:
    """Chunks with their embedding, model and size.

    Unless ``check`` is off, a chunk without exactly one valid vector is an error. With it off such chunks are left
    out, and ``vector_rejects`` names them.
    """
    if check:
        rejects = vector_rejects(chunks, vectors, key, dimensions).select(key, "problem").limit(5).collect()
        if rejects:
            raise ValueError(f"Chunks without exactly one valid vector, for example {[tuple(r) for r in rejects]}")
    sound = _vector_state(vectors, key, dimensions).filter("_n = 1 AND _problem IS NULL")
    good = vectors.select(key, "embedding").join(sound, key, "left_semi")
    return chunks.join(good, key).withColumns(
        {"embedding_model": F.lit(model), "embedding_dimensions": F.lit(dimensions)}
    )


def chunks_without_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks no vector exists for."""
    return chunks.join(vectors.select(key), key, "left_anti")


# --- exact search ----------------------------------------------------------------------------

# A block of queries holds about this many numbers. All chunks pass by one block after another, whatever their count.
BLOCK_NUMBERS = 4_000_000
# The blocks that meet the chunks in one pass hold about this many numbers.
PASS_NUMBERS = 4_000_000
# A task takes this many chunks where there are enough of them to keep all cores busy.
TASK_ROWS = 50_000
# Queries scored at a time, so that the similarity matrix of a batch stays small.
GROUP = 64
# Parts that the hits of a query are cut down in before the last ranking.
PARTS = 64
# Numbers and rows of the sample of chunks that cells and first limits are taken from, at most, and cells made of it.
# They decide how much is skipped, never what is found.
SAMPLE_NUMBERS = 1_000_000
SAMPLE_ROWS = 4_096
CELLS = 64
# Angles and cosines near their ends are this exact.
ANGLE_SLACK = 1e-6


def _unit(rows: Iterable) -> np.ndarray:
    matrix = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _best(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, floor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and the ids and similarities of its k best rows, ties by id."""
    slack = 1e-9
    for number, row in enumerate(queries @ vectors.T):
        usable = np.flatnonzero(row >= floor - slack)
        if len(usable) > k:
            limit = np.partition(row[usable], len(usable) - k)[len(usable) - k]
            usable = usable[row[usable] >= limit - slack]
        # A matrix product may sum equal rows in another order; the few that are left are summed alike, so that they tie.
        exact = np.einsum("nd,d->n", vectors[usable], queries[number])
        usable, exact = usable[exact >= floor], exact[exact >= floor]
        order = np.lexsort((ids[usable], -exact))[:k]
        yield number, ids[usable][order], exact[order]


def _centres(sample: np.ndarray) -> np.ndarray:
    """Unit centres of at most ``CELLS`` cells, by a few rounds of spherical k-means."""
    if not len(sample):
        return np.eye(1, sample.shape[1])
    centres = sample[np.linspace(0, len(sample) - 1, min(CELLS, len(sample))).astype(int)]
    for _ in range(5):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _first_limits(wanted: np.ndarray, sample: np.ndarray, k: int, floor: float) -> np.ndarray:
    """A lower bound for the k-th hit of each query: the k-th best among a part of the chunks."""
    limits = np.full(len(wanted), floor)
    if len(sample) >= k:
        for at in range(0, len(wanted), GROUP):
            scores = np.nan_to_num(wanted[at : at + GROUP] @ sample.T, nan=-1.0)
            limits[at : at + GROUP] = np.maximum(floor, np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k])
    return limits


def _turns(wanted: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(wanted @ centres.T, -1.0, 1.0))


def _reach(turns: np.ndarray, radius: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Which cells may hold a hit of which query.

    A member of a cell is at least the angle to its centre less the cell's radius away from the query, so its cosine is
    at most that of this angle. Cells below the query's limit hold no hit. Radii below zero mark empty cells.
    """
    least = np.clip(turns - radius - ANGLE_SLACK, 0.0, np.pi)
    return (np.cos(least) >= limits[:, None] - ANGLE_SLACK) & (radius >= 0)


def _groups(turns: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring queries of one cell, of at most ``GROUP``, so that a group leaves out much at once."""
    if not len(turns):
        return []
    home = turns.argmin(axis=1)
    cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)]
    return [(at, min(at + GROUP, end)) for begin, end in zip(cuts, cuts[1:]) for at in range(begin, end, GROUP)]


def check_search(top_k: int, min_similarity: float) -> None:
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    if not -1.0 <= min_similarity <= 1.0:
        raise ValueError("min_similarity must be between -1 and 1")


def search(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    key: str = "chunk_id",
    query_key: str = "query_id",
    vector: str = "embedding",
    dimensions: int,
    top_k: int = 5,
    min_similarity: float = 0.0,
    model: str | None = None,
    columns: Sequence[str] = (),
    check: bool = True,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """Exact cosine top-k of every query, ties by chunk key.

    Queries go to the tasks in blocks of bounded size, and the chunks pass by the blocks in Arrow batches, by as many
    blocks in one pass as fit bounded memory; a task keeps k rows per query, so pairs are never written out. Chunks are
    dealt to the tasks once. The chunks of a batch lie in cells,
    and a query leaves out each cell that by its radius can hold nothing above the query's k-th hit so far; the k-th best
    of a sample of chunks is where that limit starts. Nothing is lost by it. ``model`` keeps the chunks of one
    embedding model; ``columns`` adds columns of the chunks to the result. A bad query vector is an error, and so is a
    bad chunk vector unless ``check`` is off; then it is left out and ``vector_problems`` names it. A zero vector is
    similar to nothing.
    """
    check_search(top_k, min_similarity)
    if model is not None:
        chunks = chunks.filter(F.col("embedding_model") == model)
    offered = chunks.select(F.col(key).alias("_id"), F.col(vector).alias("_v"))
    sound = F.col("_problem").isNull()
    state = offered.withColumn("_problem", vector_problem("_v", dimensions))
    # One scan looks for bad vectors, which sort first, and takes the sample.
    seen = (
        (state if check else state.filter(sound))
        .select("_id", F.when(sound, F.col("_v")).alias("_v"), "_problem")
        .orderBy(sound, F.xxhash64("_id"))
        .limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dimensions)))
        .collect()
    )
    bad = [(r["_id"], r["_problem"]) for r in seen if r["_problem"] is not None]
    if bad:
        raise ValueError(f"Chunk vectors break the contract, for example {bad[:5]}")
    sample = _unit(r["_v"] for r in seen) if seen else np.zeros((0, dimensions))
    sample = sample[~np.isnan(sample[:, 0])]
    good = state.filter(sound).select("_id", "_v")
    asked = queries.select(F.col(query_key).alias("_q"), F.col(vector).alias("_v"))
    if not vector_problems(asked, "_q", "_v", dimensions).isEmpty():
        raise ValueError("A query vector is missing, has the wrong size or is not finite")
    result = T.StructType(
        [
            T.StructField("_q", asked.schema["_q"].dataType),
            T.StructField("_id", good.schema["_id"].dataType),
            T.StructField("similarity_score", T.DoubleType()),
        ]
    )
    found = _search_blocks(good, asked, sample, result, top_k, min_similarity, max(1, block_numbers // dimensions))
    # Each task has k rows for a query; they are cut down in parts before they meet.
    part = Window.partitionBy("_q", F.pmod(F.xxhash64("_id"), F.lit(PARTS))).orderBy(F.desc("similarity_score"), "_id")
    few = found.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top_k)
    order = Window.partitionBy("_q").orderBy(F.desc("similarity_score"), "_id")
    ranked = (
        few.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top_k)
        .select(F.col("_q").alias(query_key), F.col("_id").alias(key), "similarity_score", "place")
    )
    return ranked.join(chunks.select(key, *columns), key) if columns else ranked


def _search_blocks(
    good: DataFrame, asked: DataFrame, sample: np.ndarray, result: T.StructType, k: int, floor: float, block_rows: int
) -> DataFrame:
    """All chunks against the blocks of queries, as many in one pass as bounded memory allows.

    Queries of one cell stand together in a block. The chunks are dealt evenly to the tasks first, as a file of theirs
    may be one partition: a task's work is its chunks times all queries.
    """
    centres = _centres(sample)
    context = good.sparkSession.sparkContext
    blocks_in_pass = max(1, PASS_NUMBERS // (block_rows * centres.shape[1]))
    pass_rows = block_rows * blocks_in_pass
    passes = max(1, math.ceil(asked.count() / pass_rows))
    dealt = good.repartition(max(context.defaultParallelism, math.ceil(good.count() / TASK_ROWS)))
    found = None
    for number in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == number).orderBy("_q").collect()
        names = np.array([r["_q"] for r in rows], object)
        matrix = _unit(r["_v"] for r in rows) if rows else np.zeros((0, centres.shape[1]))
        together = np.argsort((matrix @ centres.T).argmax(axis=1), kind="stable")
        names, matrix = names[together], matrix[together]
        limits = _first_limits(matrix, sample, k, floor)
        shared = context.broadcast((names, matrix, limits, centres))
        part = dealt.mapInPandas(_scorer(shared, k, floor, block_rows), result)
        found = part if found is None else found.unionAll(part)
    return found


class _Hits:
    """The best chunks of each query of a block so far."""

    def __init__(self, names: np.ndarray, wanted: np.ndarray, limits: np.ndarray, centres: np.ndarray) -> None:
        self.names, self.wanted, self.limits = names, wanted, limits.copy()
        self.turns = _turns(wanted, centres)
        self.groups = _groups(self.turns)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, ids: np.ndarray, vectors: np.ndarray, home: np.ndarray, radius: np.ndarray, k: int, floor: float) -> None:
        for at, end in self.groups:
            reach = _reach(self.turns[at:end], radius, self.limits[at:end])
            asked = at + np.flatnonzero(reach.any(axis=1))
            if not len(asked):
                continue
            rows = np.flatnonzero(reach.any(axis=0)[home])
            for number, near, values in _best(ids[rows], vectors[rows], self.wanted[asked], k, floor):
                query = int(asked[number])
                if query in self.kept:
                    near = np.concatenate((self.kept[query][0], near))
                    values = np.concatenate((self.kept[query][1], values))
                    order = np.lexsort((near, -values))[:k]
                    near, values = near[order], values[order]
                self.kept[query] = near, values
                if len(values) == k:
                    self.limits[query] = max(self.limits[query], values[-1])

    def frames(self) -> Iterator[pd.DataFrame]:
        for begin in range(0, len(self.names), 1_000):
            own = [n for n in range(begin, min(begin + 1_000, len(self.names))) if n in self.kept and len(self.kept[n][0])]
            if own:
                yield pd.DataFrame(
                    {
                        "_q": np.repeat(self.names[own], [len(self.kept[n][0]) for n in own]),
                        "_id": np.concatenate([self.kept[n][0] for n in own]),
                        "similarity_score": np.concatenate([self.kept[n][1] for n in own]),
                    }
                )


def _scorer(
    shared: Broadcast, k: int, floor: float, block_rows: int | None = None
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted, limits, centres = shared.value
        size = block_rows or max(1, len(names))
        blocks = [slice(at, at + size) for at in range(0, len(names), size)]
        hits = [_Hits(names[b], wanted[b], limits[b], centres) for b in blocks]
        for batch in batches:
            if batch.empty or not hits:
                continue
            ids, vectors = batch["_id"].to_numpy(), _unit(batch["_v"])
            sound = ~np.isnan(vectors[:, 0])
            ids, vectors = ids[sound], vectors[sound]
            if not len(ids):
                continue
            beside = vectors @ centres.T
            home = beside.argmax(axis=1)
            radius = np.full(len(centres), -1.0)
            np.maximum.at(radius, home, np.arccos(np.clip(beside.max(axis=1), -1.0, 1.0)))
            for block in hits:
                block.meet(ids, vectors, home, radius, k, floor)
        for block in hits:
            yield from block.frames()

    return score


def relevance_label(category: Column | str, regions: Column | str, topics: Column | str) -> Column:
    """D10: 'Category · regions · topics', with 'company-wide' where no region is named."""
    named = F.array_join(F.coalesce(col(regions), F.array().cast("array<string>")), ", ")
    said = F.array_join(
        F.transform(F.coalesce(col(topics), F.array().cast("array<string>")), lambda t: F.replace(t, F.lit("_"), F.lit(" "))),
        ", ",
    )
    return F.concat_ws(
        " · ",
        F.initcap(F.replace(col(category), F.lit("_"), F.lit(" "))),
        F.when(named == "", "company-wide").otherwise(named),
        F.when(said != "", said),
    )


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """Documents, chunks, distinct chunk ids and the range of estimated tokens."""
    return chunks.agg(
        F.count_distinct("document_id").alias("documents"),
        F.count("chunk_id").alias("chunks"),
        F.min("estimated_tokens").alias("smallest_chunk_tokens"),
        F.max("estimated_tokens").alias("largest_chunk_tokens"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
    )
