import hashlib
import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrain.operators import retrieval as rt


def clean(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(rt.clean_text("t")).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("  a \t b  ", "a b"),
        ("a\r\nb\rc\u2028d\x85e", "a\nb\nc\nd\ne"),
        ("a\n\n\n \n\nb", "a\n\nb"),
        ("\n\n a \n\n", "a"),
        (" \t\n ", ""),
        ("\u00a0é  ü\u00a0\n\u3000x", "é ü\nx"),
    ],
)
def test_clean_text(spark, raw, expected):
    assert clean(spark, raw) == expected


def test_sections(spark):
    text = "intro line\n\n# One\nfirst\n\nsecond\n## Empty\n\n### Two ##\nlast\n#not a heading"
    row = spark.createDataFrame([(text, "Title")], "t string, title string").select(rt.sections("t", "title").alias("s")).first()
    assert [(s.section, s.paragraphs) for s in row.s] == [
        ("Title", ["intro line"]),
        ("One", ["first", "second"]),
        ("Two ##", ["last\n#not a heading"]),
    ]


def pieces_by_hand(paragraphs, prefix, target, largest):
    """Greedy pieces, straight from the rules, as lists of paragraphs."""

    def size(part):
        return max(1, math.ceil(len(prefix + "\n\n".join(part)) / 4))

    closed, open_piece = [], []
    for p in paragraphs:
        if open_piece and size(open_piece + [p]) > largest:
            closed.append(open_piece)
            open_piece = []
        open_piece = open_piece + [p]
        if size(open_piece) >= target:
            closed.append(open_piece)
            open_piece = []
    if open_piece:
        fits = closed and size(open_piece) < target // 2 and size(closed[-1] + open_piece) <= largest
        if fits:
            closed[-1] = closed[-1] + open_piece
        else:
            closed.append(open_piece)
    return closed


@pytest.mark.parametrize("target, largest", [(40, 60), (20, 20), (550, 700)])
def test_chunks_follow_the_rules(spark, target, largest):
    draw = random.Random(target)
    documents = []
    for i in range(30):
        paragraphs = ["w" * draw.choice([1, 5, 30, 90, 200, 400]) for _ in range(draw.randint(1, 25))]
        documents.append((f"D{i}", f"T{i}", [("S", paragraphs), ("U", paragraphs[:2])]))
    schema = "id string, title string, parts array<struct<section:string,paragraphs:array<string>>>"
    got = rt.chunk_documents(
        spark.createDataFrame(documents, schema), key="id", title="title", parts="parts",
        target_tokens=target, max_tokens=largest,
    ).orderBy("document_id", "chunk_index").collect()
    expected = {}
    for key, title, parts in documents:
        texts = []
        for section, paragraphs in parts:
            prefix = f"Document: {title}\nSection: {section}\n\n"
            texts += [prefix + "\n\n".join(p) for p in pieces_by_hand(paragraphs, prefix, target, largest)]
        for n, text in enumerate(texts, 1):
            expected[f"{key}-C{n:03d}"] = text
    assert {r.chunk_id: r.content for r in got} == expected
    assert all(r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() for r in got)
    assert all(r.estimated_tokens == max(1, math.ceil(len(r.content) / 4)) for r in got)


def test_chunk_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        rt.chunk_documents(spark.range(1), key="id", title="id", parts="id", target_tokens=10, max_tokens=5)


def vectors(n, seed):
    draw = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    draw[: n // 3] = draw[0]  # a third of all rows are copies of one vector
    return [(i, [float(x) for x in row]) for i, row in enumerate(draw)]


def exact(chunks, queries, k, floor):
    out = {}
    for q, qv in queries:
        scored = []
        for c, cv in chunks:
            a, b = np.array(qv), np.array(cv)
            s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
            if s >= floor:
                scored.append((-round(s, 9), c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("bound", [rt.BLOCK_NUMBERS, 8 * 7])
def test_search_is_exact_in_one_block_and_in_many(spark, bound):
    chunks, queries = vectors(300, 1), vectors(40, 2)
    frame = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>").repartition(7)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = rt.search(frame, asked, dimensions=8, top_k=6, min_similarity=0.1, block_numbers=bound)
    rows = got.orderBy("query_id", "place").collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r.chunk_id)
    expected = {q: ids for q, ids in exact(chunks, queries, 6, 0.1).items() if ids}
    assert found == expected


def test_search_passes_all_blocks_at_once_and_in_bounded_passes(spark, monkeypatch):
    chunks, queries = vectors(300, 1), vectors(40, 2)
    frame = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    expected = {q: ids for q, ids in exact(chunks, queries, 6, 0.1).items() if ids}
    for numbers, passes in ((rt.PASS_NUMBERS, 1), (8 * 21, 2)):
        monkeypatch.setattr(rt, "PASS_NUMBERS", numbers)
        got = rt.search(frame, asked, dimensions=8, top_k=6, min_similarity=0.1, block_numbers=8 * 7)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == passes
        found = {}
        for r in got.orderBy("query_id", "place").collect():
            found.setdefault(r.query_id, []).append(r.chunk_id)
        assert found == expected


def clustered(n, seed, cells=20, dimensions=16):
    draw = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(cells, dimensions))
    rows = centres[draw.integers(cells, size=n)] + 0.05 * draw.normal(size=(n, dimensions))
    rows[::50] = rows[0]  # ties
    rows[1::97] = 0.0
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows.astype(np.float32))]


def exact_scores(chunks, queries, k, floor):
    ids = np.array([c for c, _ in chunks])
    with np.errstate(invalid="ignore"):
        a, b = rt._unit([v for _, v in queries]), rt._unit([v for _, v in chunks])
    out = {}
    for (q, _), row in zip(queries, a @ b.T, strict=True):
        ranked = sorted((-round(float(s), 9), int(c)) for s, c in zip(row, ids, strict=True) if s >= floor)
        if ranked:
            out[q] = [c for _, c in ranked[:k]]
    return out


@pytest.mark.parametrize("floor", [-1.0, 0.3])
def test_search_by_cells_loses_no_hit(spark, floor):
    chunks, queries = clustered(3000, 1), clustered(150, 2)
    frame = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    found = {}
    for r in rt.search(frame, asked, dimensions=16, top_k=7, min_similarity=floor).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert found == exact_scores(chunks, queries, 7, floor)


def test_search_skips_cells_that_cannot_hold_a_hit(monkeypatch):
    chunks, queries = clustered(3000, 1), clustered(150, 2)
    scored = []
    best = rt._best
    monkeypatch.setattr(rt, "_best", lambda ids, v, q, k, floor: scored.append(len(ids) * len(q)) or best(ids, v, q, k, floor))
    with np.errstate(invalid="ignore"):
        wanted, every = (rt._unit([v for _, v in rows]) for rows in (queries, chunks))
    sample = every[:500][~np.isnan(every[:500, 0])]
    centres = rt._centres(sample)
    together = np.argsort((wanted @ centres.T).argmax(axis=1), kind="stable")
    names, wanted = np.array([q for q, _ in queries], object)[together], wanted[together]
    shared = SimpleNamespace(value=(names, wanted, rt._first_limits(wanted, sample, 5, -1.0), centres))
    batches = [pd.DataFrame(chunks[at : at + 1000], columns=["_id", "_v"]) for at in range(0, 3000, 1000)]
    hits = pd.concat(rt._scorer(shared, 5, -1.0)(iter(batches)))
    assert sum(scored) < 0.5 * len(chunks) * len(queries)
    expected = exact_scores(chunks, queries, 5, -1.0)
    assert {q: rows["_id"].tolist() for q, rows in hits.groupby("_q")} == expected


def test_search_contract(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, float("nan")]), (3, [1.0])], "chunk_id long, embedding array<float>")
    good = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.chunk_id for r in rt.search(frame, good, dimensions=2, check=False).collect()] == [1]
    with pytest.raises(ValueError, match="Chunk vectors"):
        rt.search(frame, good, dimensions=2)
    problems = {r.chunk_id: r.problem for r in rt.vector_problems(frame, "chunk_id", "embedding", 2).collect()}
    assert problems == {2: "not finite", 3: "wrong size"}
    for bad in ({"top_k": 0}, {"top_k": 21}, {"min_similarity": 1.5}):
        with pytest.raises(ValueError):
            rt.search(frame, good, dimensions=2, **bad)
    with pytest.raises(ValueError):
        rt.search(frame, frame.withColumnRenamed("chunk_id", "query_id"), dimensions=2)
    assert rt.search(frame, good.limit(0), dimensions=2, check=False).count() == 0


def test_search_keeps_one_model_and_adds_columns(spark):
    rows = [(1, [1.0, 0.0], "a", "x"), (2, [1.0, 0.1], "b", "y"), (3, [0.0, 1.0], "a", "z")]
    frame = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, embedding_model string, title string")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    found = rt.search(frame, asked, dimensions=2, model="a", columns=["title"]).orderBy("place").collect()
    assert [(r.chunk_id, r.place, r.title) for r in found] == [(1, 1, "x"), (3, 2, "z")]


def test_vectors_are_attached_once_or_refused(spark):
    chunks = spark.createDataFrame([(i,) for i in range(1, 6)], "k long")
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, float("inf")])], "k long, embedding array<float>"
    )
    rejects = {r.k: r.problem for r in rt.vector_rejects(chunks, vectors, "k", 2).collect()}
    assert rejects == {2: "wrong size", 3: "repeated", 4: "not finite", 5: "missing"}
    with pytest.raises(ValueError, match="exactly one valid vector"):
        rt.attach_vectors(chunks, vectors, "k", model="m", dimensions=2)
    assert [r.k for r in rt.attach_vectors(chunks, vectors, "k", model="m", dimensions=2, check=False).collect()] == [1]


def test_relevance_label(spark):
    row = spark.createDataFrame([("market_report", ["Europe", "India"], ["cost_review"])], "c string, r array<string>, t array<string>")
    assert row.select(rt.relevance_label("c", "r", "t")).first()[0] == "Market Report · Europe, India · cost review"
    none = row.withColumn("r", F.array().cast("array<string>")).withColumn("t", F.lit(None).cast("array<string>"))
    assert none.select(rt.relevance_label("c", "r", "t")).first()[0] == "Market Report · company-wide"
