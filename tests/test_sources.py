import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import profiling
from tallygrain.sources import files, jdbc
from tests.frames import valid_tables


def test_csv_round_trip(spark, tmp_path):
    tables = valid_tables(spark)
    files.write_csv_tables(tables, str(tmp_path / "csv"))
    again = files.read_csv_tables(spark, str(tmp_path / "csv"))
    for name, frame in tables.items():
        got = getattr(again, name)
        assert got.schema == frame.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, frame.collect()))


def test_store_refuses_a_filled_target(spark, tmp_path):
    tables, target = valid_tables(spark), str(tmp_path / "store")
    counts = {r.table: r.rows for r in files.store_tables(tables, target).collect()}
    assert counts["sales"] == 5
    with pytest.raises(ValueError, match="not empty"):
        files.store_tables(tables, target)
    files.store_tables(tables.with_tables(sales=tables.sales.limit(3)), target, replace=True)
    check = {r.check: (r.expected, r.found) for r in files.load_check(tables, files.read_tables(spark, target)).collect()}
    assert check["sales"] == (5, 3) and check["customers"] == (4, 4)
    assert check["sales_subscription has no parent"] == (0, 0)


def test_missing_results_are_all_named(spark, tmp_path):
    files.write_result(spark.range(3), str(tmp_path / "here"))
    assert files.load_artifacts(spark, {"here": str(tmp_path / "here")})["here"].count() == 3
    with pytest.raises(FileNotFoundError, match="gone, lost"):
        files.load_artifacts(spark, {"lost": str(tmp_path / "x"), "here": str(tmp_path / "here"), "gone": str(tmp_path / "y")})


def test_json_has_no_nan(spark, tmp_path):
    frame = spark.sql(
        "SELECT double('NaN') AS a, array(1D, double('Infinity')) AS b, named_struct('x', double('NaN'), 'y', 2) AS c, map('k', double('NaN')) AS d"
    )
    files.write_json(frame, str(tmp_path / "json"))
    text = "".join(p.read_text() for p in Path(tmp_path / "json").glob("*.json"))
    assert json.loads(text, parse_constant=lambda c: pytest.fail(c)) == {"b": [1.0, None], "c": {"y": 2}, "d": {"k": None}}


def test_corpus(spark, tmp_path):
    (tmp_path / "one.md").write_text("# A\n\ntext\n")
    (tmp_path / "two.markdown").write_text("plain")
    (tmp_path / "skip.txt").write_text("no")
    rows = {r.document_id: r.text for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"one": "# A\n\ntext\n", "two": "plain"}
    (tmp_path / "README.md").write_text("about")
    (tmp_path / "Three.MD").write_text("x")
    assert {r.document_id for r in files.read_corpus(spark, str(tmp_path)).collect()} == {"one", "two", "Three"}
    (tmp_path / "two.md").write_text("again")
    (tmp_path / "four.md").write_text(" \n")
    with pytest.raises(ValueError, match=r"\['four', 'two'\]"):
        files.read_corpus(spark, str(tmp_path))
    assert files.read_corpus(spark, str(tmp_path), check=False).count() == 5
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="No Markdown"):
        files.read_corpus(spark, str(tmp_path / "none"))


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert sorted(tuple(r) for r in files.upsert(old, new, "k").collect()) == [(1, "a"), (2, "b"), (3, "b")]
    with pytest.raises(ValueError, match="repeat a key"):
        files.upsert(old, new.union(new.limit(1)), "k")
    assert files.upsert(old, new, "k", replace=True).count() == 2 and files.upsert(None, new, "k").count() == 2


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = tmp_path / "stored"
    old = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("a").alias("v"))
    files.store_by_key(old, str(path), "k", buckets=8)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    new = spark.createDataFrame([(7, "b"), (1000, "b")], "k long, v string")
    touched = files.upsert_stored(new, str(path), "k")
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    changed = {int(f.parent.name.partition("=")[2]) for f, _ in before.items() ^ after.items()}
    assert changed == set(touched) and 1 <= len(touched) <= 2
    expected = {k: "a" for k in [None, *range(1, 200)]} | {7: "b", 1000: "b"}
    rows = files.read_by_key(spark, str(path)).collect()
    assert len(rows) == len(expected) and {r.k: r.v for r in rows} == expected
    assert files.upsert_stored(new.limit(0), str(path), "k") == []
    with pytest.raises(ValueError, match="repeat a key"):
        files.upsert_stored(new.unionAll(new), str(path), "k")
    old.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="not stored by key"):
        files.upsert_stored(new, str(tmp_path / "plain"), "k")


def test_jdbc_reads_are_split():
    assert jdbc.hash_predicates("sale_id", 2) == ["mod(abs(hashtext(sale_id)), 2) = 0", "mod(abs(hashtext(sale_id)), 2) = 1"]
    with pytest.raises(ValueError):
        jdbc.hash_predicates("x", 0)


def test_profile_edges(spark):
    frame = spark.createDataFrame(
        [(1.0, "a", None, True), (1.0, "a", None, True), (5.0, None, 3.0, False), (None, "b", 4.0, True)],
        "x double, s string, y double, f boolean",
    )
    assert profiling.dataset_summary(frame).first().asDict() == {"rows": 4, "columns": 4, "duplicate_rows": 1}
    assert [(r.column, r.dtype) for r in profiling.column_types(frame).collect()][0] == ("x", "double")
    missing = {r.column: (r.missing_count, r.missing_percent) for r in profiling.missing_values(frame).collect()}
    assert missing == {"y": (2, 50.0), "x": (1, 25.0), "s": (1, 25.0), "f": (0, 0.0)}
    top = [(r.value, r.n, r.unique_count) for r in profiling.categorical_summary(frame, ["s"]).orderBy("place").collect()]
    assert top == [("a", 2, 2), ("b", 1, 2), (None, 1, 2)]
    assert profiling.missing_values(frame.limit(0)).filter("missing_percent <> 0").count() == 0
    numbers = {r.column: r for r in profiling.numerical_summary(frame).collect()}
    assert numbers["y"].p50 == 3.5 and numbers["y"]["count"] == 2
    flat = profiling.correlations(frame.withColumn("c", F.lit(1.0)).select("x", "c"), method="spearman").first()
    assert flat.correlation is None
    assert profiling.correlations(frame.withColumn("c", F.lit(1.0)).select("x", "c"), method="pearson").first().correlation is None
    with pytest.raises(ValueError):
        profiling.categorical_summary(frame, top_n=0)
    with pytest.raises(ValueError):
        profiling.iqr_outliers(frame, multiplier=0)
