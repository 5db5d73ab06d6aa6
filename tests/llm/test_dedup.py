"""Substring, suffix, shingle and vector deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tallygrain.llm import near_dedup
from tallygrain.llm.embedding_dedup import embedding_near_duplicates
from tallygrain.llm.graph import components
from tallygrain.llm.near_dedup import _sketch_rows, near_duplicates
from tallygrain.llm.substring_dedup import substring_dedup
from tallygrain.llm.suffix_dedup import _padded, multikey_order, suffix_dedup

DOCS = "doc_id long, text string, h string, lo int, node string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture
def uneven(spark):
    """Many small partitions, as on a cluster."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def word_texts():
    draw = random.Random(2)
    passages = [[draw.choice("abcdefgh") for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(0, 5)):
            part = draw.choice(passages)
            words += draw.choice([part, part[3:], part[:7], ["z"] * 11, [f"w{draw.random()}"]])
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(100 + i, t) for i, t in rows[:10]] + [(200, None), (201, ""), (202, " \n "), (203, "é\x0bß"), (None, rows[5][1])]


def test_substring_dedup_equals_brute_force(uneven):
    rows, window = word_texts(), 6
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[s : s + window])
                first[key] = min(i, first.get(key, i))
    expected = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if i is not None and first[tuple(words[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        expected.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    got = substring_dedup(frame(uneven, rows), window=window, gram=3).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=order) == sorted(expected, key=order)
    for r in got:
        assert sum(x["end"] - x["begin"] for x in r.removed) == r.n_removed


def test_substring_dedup_of_very_long_and_repeated_rows(spark):
    long = " ".join(str(i % 70_001) for i in range(150_000))
    rows = [(1, long), (2, long), (2, long), (3, "only this"), (3, "another " * 60)]
    got = {}
    for r in substring_dedup(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == [(150_000, 0)] and got[2] == [(150_000, 150_000)] * 2
    assert sorted(got[3]) == [(2, 0), (60, 0)]
    assert substring_dedup(frame(spark, [])).collect() == []


def test_suffix_dedup_equals_brute_force_across_buckets(uneven):
    draw, window = random.Random(4), 60
    word = lambda n: "".join(draw.choice("abcé ") for _ in range(n))
    passages, wide = [word(90) for _ in range(3)], word(300)
    rows = []
    for i in range(150):
        pieces = lambda: [word(draw.randint(1, 60)), *passages, wide[draw.randint(0, 40) : draw.randint(200, 300)], "x" * draw.randint(1, 150)]
        rows.append((i, "".join(draw.choice(pieces()) for _ in range(draw.randint(0, 6)))))
    rows += [(200 + i, t) for i, t in rows[:10]] + [(300, None), (301, ""), (302, rows[0][1])]
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[s : s + window] for s in range(len(data) - window + 1))
    expected = {}
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - window + 1):
            if seen[data[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        expected[i] = (len(data), sum(gone), bytes(c for c, g in zip(data, gone) if not g))
    got = suffix_dedup(frame(uneven, rows), window=window, gram=20).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in got} == expected


def test_suffix_dedup_edges(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(500))
    got = suffix_dedup(frame(spark, [(None, text), (1, text), (2, "b" * 401), (3, text[:199])])).collect()
    kept = {r.doc_id: (r.n_removed, len(r.removed)) for r in got}
    assert kept[None] == (0, 0) and kept[2] == (401, 1) and kept[3] == (0, 0)
    assert suffix_dedup(frame(spark, [])).collect() == []


def test_multikey_order_sorts_bytes():
    draw = np.random.default_rng(1)
    strings = [bytes(draw.integers(0, 3, draw.integers(0, 20)).astype(np.uint8)) for _ in range(3000)]
    rows, lengths = _padded(strings)
    assert [strings[i] for i in multikey_order(rows, lengths)] == sorted(strings)


def shingle_texts():
    draw = random.Random(6)
    rows = []
    for group in range(12):
        base = [f"g{group}w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 9, 40, 120, 300]))]
        for _ in range(draw.choice([1, 2, 12])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2])):
                words[draw.randrange(len(words))] = f"new{draw.random()}"
            rows.append(" ".join(words).upper() if draw.random() < 0.3 else " ".join(words))
    draw.shuffle(rows)
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, "a b"), (903, "A\tB"), (904, "\n")]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_brute_force(spark):
    rows = shingle_texts()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = smallest_reachable(sets, links)
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), expected[i], expected[i] == i) for i in sets
    }


def test_near_duplicates_that_straddle_the_threshold(spark):
    # Copies of one text, each with other words changed: many pairs lie just below and above the threshold.
    draw = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for place in draw.sample(range(150), draw.choice([1, 2, 3, 4])):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = smallest_reachable(sets, links)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()} == expected


def test_variants_of_a_template_meet_the_template(spark, monkeypatch):
    """Most variants are linked to the template alone, and the smallest ids to few, so buckets stay unsettled."""
    draw = random.Random(12)
    template = [f"w{i}" for i in range(200)]
    texts = [template]
    for n in range(150):
        own = list(template)
        for place in draw.sample(range(200), draw.choice((2, 3))):
            own[place] = f"x{n}y{place}"
        texts.append(own)
    rows = list(zip([9999, *draw.sample(range(1000), 150)], map(" ".join, texts), strict=True))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = smallest_reachable([i for i, _ in rows], links)
    met = []
    around = near_dedup._around_hubs
    monkeypatch.setattr(near_dedup, "_around_hubs", lambda *x: met.append(around(*x)) or met[-1])
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()} == expected
    assert len(met) == 1 and met[0].groupBy("s").agg(F.count_distinct("label").alias("k")).where("k > 8").count() == 0


def test_near_duplicates_with_odd_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (9, "q r s t u v"), (9, "q r s t u v")]
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False), (9, 4, False)
    ]
    assert near_duplicates(frame(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + draw.randint(0, 80), 2000 + draw.randint(0, 80)) for _ in range(60)]
    links += [(5, 5), (7, 8), (8, 7)]
    ids = {x for pair in links for x in pair if pair[0] != pair[1]}
    got = components(spark.createDataFrame(links + [(None, 3)], "a long, b long"), "a", "b").collect()
    assert {r.id: r.component_id for r in got} == {i: c for i, c in smallest_reachable(ids, links).items()}


def test_vector_groups_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(700, 16))
    near = base[:120] + draw.normal(size=(120, 16)) * 0.12
    rows = np.concatenate((base, near, base[:30], base[:5] * 3))
    vectors = [(i, x.tolist()) for i, x in enumerate(rows)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None, 1.0]), (2004, []), (2005, [1.0, float("inf")]), (2006, [1.0, 1.0]), (2007, [2.0, 2.0]), (None, base[0].tolist())]
    frame = spark.createDataFrame([(i, v, 0, "c") for i, v in vectors + odd], "vec_id long, embedding array<double>, n int, cell string")
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(close, 1)))] + [(2006, 2007)]
    ids = [i for i, _ in vectors + odd if i is not None]
    root = smallest_reachable(ids, links)
    count = Counter(x for pair in links for x in pair)
    got = embedding_near_duplicates(frame).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (count[i], root[i], root[i] == i) for i in ids}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embedding_near_duplicates(frame.limit(0)).collect() == []


def test_vector_links_are_found_across_cells(small, spark):
    draw = np.random.default_rng(9)
    base = draw.normal(size=(4000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    turn = draw.normal(size=(4000, 32))
    turn -= (turn * base).sum(axis=1)[:, None] * base
    near = 0.91 * base + np.sqrt(1 - 0.91**2) * turn / np.linalg.norm(turn, axis=1)[:, None]
    rows = np.concatenate((base, near))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    true = sum(int((rows[i : i + 1000] @ rows.T >= 0.9).sum()) for i in range(0, 8000, 1000)) - 8000
    found = sum(r.n_links for r in embedding_near_duplicates(frame, sample=2000).collect())
    assert 0.99 * true <= found <= true


def test_vectors_of_few_inner_dimensions_lose_no_link(spark):
    # Differences lie in 8 of 64 dimensions, so many pairs differ straight across a border.
    draw = np.random.default_rng(10)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(draw.normal(size=(4000, 8)))
    turn = draw.normal(size=(4000, 8))
    turn = unit(turn - (turn * base).sum(axis=1)[:, None] * base)
    plane = np.linalg.qr(draw.normal(size=(64, 8)))[0]
    rows = np.concatenate((base, 0.91 * base + np.sqrt(1 - 0.91**2) * turn)) @ plane.T
    close = rows @ rows.T >= 0.9
    root = smallest_reachable(range(8000), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(close, 1)))])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = embedding_near_duplicates(frame, sample=2000).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(close[i].sum()) - 1, root[i]) for i in root}


def test_equal_sets_have_equal_fingerprints_wherever_they_lie():
    texts = [f"a b c d e f g {i % 3}" for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(300), "text": texts, "part": pa.array([0] * 300, pa.int32())})
    found = {}
    for out in _sketch_rows(5)(iter([batch])):
        for row in out.to_pylist():
            found.setdefault(texts[row["doc_id"]], set()).add((row["f1"], row["f2"]))
    assert [len(x) for x in found.values()] == [1, 1, 1]
