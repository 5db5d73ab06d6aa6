"""Registered text queries against their SQL, and the pipeline stage by stage."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from tallygrain.llm.common import table, written
from tallygrain.llm.decontamination import contamination
from tallygrain.llm.pii import base_spans
from tallygrain.llm.queries import QUERIES, SQL
from tools.check_oracle import key, plain


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    duck = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    frame = QUERIES[name](spark, small)
    assert sorted(names) == sorted(frame.columns)
    got = [plain(tuple(r)) for r in frame.select(*names).collect()]
    assert sorted(got, key=key) == sorted([plain(tuple(r)) for r in result.fetchall()], key=key)


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2:].split("_")[0].isdigit()) == list(range(1, 14))
    assert "pipeline" in names and set(SQL) <= set(contract.oracle_sql())


def brute_groups(rows, percent):
    """Least id of each group of texts, by comparing all pairs of their shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    return [min((rows[i][0] for i in range(len(rows)) if top(i) == g and rows[i][0] is not None), default=None) for g in range(len(rows)) if top(g) == g]


def test_near_dedup_takes_rows_as_documents(spark, small):
    def varied(n, at=20):
        return " ".join(f"w{i}" if i not in range(at, at + n) else f"x{i}" for i in range(120))

    # 120 words have 116 shingles; n changed words touch n + 4 of them.
    rows = [(1, varied(0)), (2, varied(8)), (3, varied(9, 60)), (4, "one two three four five six"), (4, "another text under the same id")]
    rows += [(None, "no id here at all"), (None, "no id here at all"), (7, "no id here at all"), (9, varied(0)), (None, "only once without an id"), (8, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    kept = pipeline.near_dedup(spark, docs, small)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    wanted = [rows[0], rows[2], rows[3], rows[4], rows[7], rows[9]]
    assert got == sorted((i is None, i or 0, t) for i, t in wanted)
    assert sorted(str(i) for i, _ in wanted) == sorted(map(str, brute_groups(rows, 80)))


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    whole = {r.doc_id: r.text for r in docs.collect()}
    seen = {"start": docs}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, small))
        seen[name] = docs
    known = {r.doc_id for r in seen["language_id"].collect()}
    assert known == {i for i, t in whole.items() if t and any(map(str.isalpha, t))}
    assert {r.doc_id for r in seen["near_dedup"].collect()} == set(brute_groups([(r.doc_id, r.text) for r in seen["language_id"].collect()], 80))
    leaked = {r.doc_id for r in contamination(seen["near_dedup"], table(spark, small, "benchmark")).collect()}
    clean = {r.doc_id for r in seen["decontamination"].collect()}
    assert leaked and clean == {r.doc_id for r in seen["near_dedup"].collect()} - leaked
    texts = {r.doc_id: r for r in seen["pii"].collect()}
    assert set(texts) == clean and not any(base_spans(r.text) for r in texts.values())
    assert all(r.n_chars == len(r.text) for r in texts.values())
    last = {r.doc_id: r for r in seen["byte_bpe"].collect()}
    assert {i: r.text for i, r in last.items()} == {i: r.text for i, r in texts.items()}
    assert all(r.n_tokens == len(r.ids) for r in last.values())
    for name in ("language_id", "near_dedup", "decontamination", "pii"):
        assert seen[name].columns == seen["start"].columns


def test_stages_take_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `c0` string, h string, label int"
    rows = [(1, "the cat sat on the mat " * 3, "en", "s", 1, "c", "h", 1), (None, "the dog and the cat and more", None, None, None, None, None, None)]
    rows += [(1, "the cat sat on the mat " * 3, "en", "s", 1, "c", "h", 1), (2, None, "en", "s", None, "c", "h", 0), (3, "", "en", "s", 0, "c", "h", 0), (4, "12 34", "en", "s", 5, "c", "h", 0)]
    docs = spark.createDataFrame(rows, schema)
    for frame, ids in ((docs, [None, 1]), (docs.limit(0), [])):
        for name, stage in pipeline.STAGES:
            frame = written(stage(spark, frame, small))
            assert frame.columns == docs.columns or name == "byte_bpe"
        assert sorted((r.doc_id for r in frame.collect()), key=lambda i: i or 0) == ids
