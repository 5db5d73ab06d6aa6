"""Filter interactions, token counts and periodic runs against brute force and the public library."""

import random
import re
import zlib
from hashlib import sha256
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tallygrain.llm import filter_audit, periodic_runs, token_counts
from tallygrain.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


# --- filter interactions ---------------------------------------------------------------------


def expected_audit(rows, filters, marks):
    """rows: (part, failed filters, marks), one per document; every order and step is walked through."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left = own
            for step, name in enumerate(order, 1):
                hit = [r for r in left if name in r[1]]
                gone = len([r for r in own if name in r[1]]) - len(hit)
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(hit)
                alone = len([r for r in own if set(r[1]) == {name}])
                out[part, "".join(order), step] = [len(left), len(hit), gone, alone, *[sum(m in r[2] for r in hit) for m in marks], name]
        for (p, _, _), values in out.items():
            if p == part:
                values[-1] = shapley[values[-1]]
    return out


def audit(spark, rows, filters, marks, **extra):
    flags = [Row(part=p, **{f: f in fails for f in filters}, **{m: m in has for m in marks}, **extra) for p, fails, has in rows]
    schema = "part string, " + ", ".join(f"{c} boolean" for c in [*filters, *marks]) + "".join(f", {c} long" for c in extra)
    found = filter_audit.filter_interactions(spark.createDataFrame(flags, schema), filters, part_col="part", marks=marks)
    numbers = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in numbers] for r in found.collect()}


@pytest.mark.parametrize("filters", [["A"], ["A", "B", "C"], ["p", "q", "r", "s", "t"]])
def test_every_order_and_step(spark, filters):
    random.seed(len(filters))
    rows = [
        (random.choice(["x", "y", ""]), [f for f in filters if random.random() < 0.4], [m for m in ("good", "bad") if random.random() < 0.5])
        for _ in range(300)
    ]
    assert audit(spark, rows, filters, ["good", "bad"], n=9, mask=1) == expected_audit(rows, filters, ["good", "bad"])


def test_counters_do_not_carry():
    sums = sum(n * filter_audit.packed(mask, 3) for mask, n in ((0, 2**62), (1, 2**61), (7, 2**61)))
    every = filter_audit.unpacked(sums, 3)
    orders = list(permutations(range(3)))
    assert every[orders.index((0, 1, 2))].tolist() == [[2**62, 2**62, 0, 2**61], [2**62, 0, 2**61, 0], [2**62, 0, 2**61, 0]]


def test_weights_nulls_and_no_rows(spark):
    schema = "part string, A boolean, B boolean, n long"
    rows = spark.createDataFrame([(None, True, None, 5), ("", None, False, 2), ("", True, True, None), ("z", True, True, 0)], schema)
    found = filter_audit.filter_interactions(rows, ["A", "B"], part_col="part", count_col="n").collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in found} == {
        ("", "AB", 1): (2, 5, 10), ("", "AB", 2): (2, 0, 0), ("", "BA", 1): (7, 0, 0), ("", "BA", 2): (2, 5, 10),
    }
    assert filter_audit.filter_interactions(rows.limit(0), ["A"], part_col="part").collect() == []
    with pytest.raises(ValueError, match="filters"):
        filter_audit.filter_interactions(rows, list("ABCDEFG"), part_col="part")


def failures(text, i, docs):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [
        name
        for name, fails in {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text or "")) > 3 * len(text or ""),
            "D": re.search(r"[#$%&*|]", text or "") is not None,
            "E": i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in docs),
        }.items()
        if fails
    ]


def test_document_failures(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", long, long + " x|", "AB cd", "a " * 500, "é日 w x", "a\vb\x1cc", long.upper(), "big " * 60_000]
    random.seed(3)
    docs = [(i, t, random.choice(["en", None, "de"]), "x") for i, t in enumerate(texts * 5)]
    docs += [(None, long, "en", "x"), (None, long, "en", "y"), (2, long, "en", "z"), (2, long, "en", "z"), (60, long, None, "z")]
    labels = [(i, i % 3 == 0, i % 2) for i in range(40)] + [(2, True, None), (3, None, None), (None, True, 1)]
    good, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, code string")
    marks = spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    found = filter_audit.document_failures(frame, marks)
    counted = {}
    for r in found.collect():
        key = (r.part, "".join(f for f in "ABCDE" if r[f]), r.good, r.toxic)
        counted[key] = counted.get(key, 0) + r.n
    wanted = {}
    for i, text, lang, _ in docs:
        key = (lang or "", "".join(failures(text, i, docs)), i in good, i in toxic)
        wanted[key] = wanted.get(key, 0) + 1
    assert counted == wanted
    assert filter_audit.document_failures(frame.limit(0), marks).collect() == []


# --- token counts ----------------------------------------------------------------------------

PARTS = ["a", "the", "The", " ", "  ", " " * 20, "\n", "\n\n", "\r\n", "\t", "▁", "▁▁", "1234", ".", "...", "é", "ü日本", "<s>", "</s>",
         "<unk>", "<0x0A>", "\x00", " ", "　", "ﬁ", "x" * 70, "🙂", "é"]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=60)))
def test_pre_tokens_add_up_to_the_library(text):
    tokens = token_counts.pre_tokens(text)
    assert sum(token_counts.count_pieces(LIBRARY, tokens)) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("frequent", [0, 7, 1 << 17])
def test_token_counts(spark, frequent):
    random.seed(frequent)
    texts = [None, "", " ", "\n", "word", "a b " * 3000, "x" * 100_000, " " * 50_000, "日本語" * 9000, "tail\n" * 700 + "q" * 50]
    texts += ["".join(random.choice(PARTS) for _ in range(random.randrange(60))) for _ in range(200)]
    rows = [(i, t, "row", 1, b"k") for i, t in enumerate(texts)] + [(5, "again and again", "n", 2, b""), (5, "again and again", "n", 2, b""), (None, "no id", "", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n long, key binary").repartition(5)
    found = token_counts.token_counts(docs, vocabulary_path=VOCABULARY, frequent=frequent)
    key = lambda r: (r[0] is None, r)
    wanted = [(i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t, *_ in rows]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    assert token_counts.token_counts(docs.limit(0), vocabulary_path=VOCABULARY).collect() == []


def test_each_pre_token_is_counted_once_and_the_frequent_are_bounded(spark):
    docs = spark.createDataFrame([(i, "the cat " * 50 + f"only{i}") for i in range(300)], "doc_id long, text string").repartition(7)
    distinct = token_counts.distinct_pre_tokens(docs)
    assert distinct.count() == distinct.select("key").distinct().count() == 302
    pieces = token_counts.pre_token_pieces(distinct, VOCABULARY)
    for bound in (0, 1, 2, 10, 400):
        least = token_counts.least_bucket(pieces, bound)
        assert pieces.where(f"bucket >= {least}").count() <= bound


class Crossing:
    def __init__(self, pieces, normal="identity"):
        self.pieces = pieces
        self.get_piece_size = lambda: len(pieces)
        self.id_to_piece = pieces.__getitem__
        self.is_control = self.is_unknown = self.is_byte = lambda i: False
        self.normalize = lambda text: "▁" + text.replace(" ", "▁") if normal == "identity" else text.lower()


@pytest.mark.parametrize("model", [Crossing(["of▁the"]), Crossing(["a\n"]), Crossing(["a"], "lower")])
def test_a_vocabulary_that_crosses_words_is_refused(model):
    with pytest.raises(ValueError, match="piece|rewrites"):
        token_counts.check_vocabulary(model)


# --- periodic runs ---------------------------------------------------------------------------


def brute_runs(ids):
    """Every period's stretches of equal words, longest possible; of equal stretches the least period."""
    out = {}
    for q in range(1, len(ids) // 4 + 1):
        i = 0
        while i < len(ids) - q:
            j = i
            while j < len(ids) - q and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((q, start, stop) for (start, stop), q in out.items())


@st.composite
def repetitive(draw):
    size = draw(st.integers(1, 4))
    out = []
    for _ in range(draw(st.integers(0, 5))):
        part = draw(st.lists(st.integers(0, size), min_size=1, max_size=9))
        out += part * draw(st.integers(1, 6)) + part[: draw(st.integers(0, len(part)))]
    return out


@settings(max_examples=600, deadline=None)
@given(repetitive())
def test_runs_equal_brute_force(ids):
    assert periodic_runs.grammar_runs(ids) == brute_runs(ids)


@settings(max_examples=200, deadline=None)
@given(repetitive())
def test_a_grammar_derives_its_sequence(ids):
    grammar = periodic_runs.Grammar(ids)
    for half, length, places in grammar.rules:
        assert 0 < half < length and len(places) > 1
        assert len({tuple(ids[p : p + length]) for p in places}) == 1
        assert all(b - a >= length for a, b in zip(places, places[1:], strict=False))
    assert sum(len(places) for _, _, places in grammar.rules) + len(grammar.left) == len(ids)


@settings(max_examples=200, deadline=None)
@given(repetitive(), st.integers(1, 40))
def test_runs_across_any_boundary(ids, middle):
    whole = [run for run in brute_runs(ids) if run[1] < middle < run[2]]
    found = periodic_runs.crossing(np.array(ids, np.int64), middle)
    # Multiples of a period may be reported too, for the same words.
    assert {run[1:] for run in found} == {run[1:] for run in whole} and set(whole) <= set(found)


def test_long_repetition_takes_little_work():
    for ids in ([1] * 100_000, list(range(2500)) * 8, [i // 3 % 7 for i in range(30_000)]):
        assert len(periodic_runs.grammar_runs(ids)) == 1


def collapse(words, runs):
    gone = {i for q, start, stop in runs for i in range(start + q, stop)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(spark):
    random.seed(5)
    texts = [None, "", " \n", "one", "a " * 6, "a a a a a", "ab " * 40_000, "x y\n" * 4 + "z", "  " * 9 + "é é", "a b c " * 1000 + "a b"]
    texts += [" ".join(random.choice("ab") for _ in range(random.randrange(90))) for _ in range(150)]
    texts += ["  ".join(f"w{i % 17}" for i in range(random.randrange(200))) + "\t" for _ in range(20)]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(4, "q q q q q q", "x", 7)] * 2 + [(None, "r s " * 4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long").repartition(4)
    found = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_words, [(x.period, x.start, x.start + x.length) for x in r.runs], r.collapsed)
        for r in periodic_runs.periodic_runs(docs).collect()
    )
    wanted = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = brute_runs([numbers[w] for w in words]) if len(words) < 9000 else [(1, 0, len(words))]
        by_start = sorted(runs, key=lambda r: (r[1], r[2]))
        wanted.append((i is None, i or 0, len(words), sorted(by_start, key=lambda r: r[1]), collapse(words, runs)))
    order = lambda rows: sorted((a, b, c, sorted(d), e) for a, b, c, d, e in rows)
    assert order(found) == order(wanted)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_periodic_query_against_brute_force(spark, tmp_path):
    random.seed(8)
    texts = [None, "", "a", *[" ".join(f"w{random.randrange(30)}" for _ in range(random.randrange(1, 120))) for _ in range(200)]]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        listed = "".join(f"{s},{e - s},{q}\n" for q, s, e in sorted(runs, key=lambda r: (r[1], r[0])))
        q, s, e = min(runs, key=lambda r: (r[1] - r[2], r[1], r[0]), default=(None, None, None))
        row = found[i]
        assert (row.n_runs, row.start, row.period) == (len(runs), s, q)
        assert row.length == (None if s is None else e - s)
        assert row.exponent_milli == (None if s is None else 1000 * (e - s) // q)
        assert row.runs_sha256 == sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == sha256(collapse(words, runs).encode()).hexdigest()
