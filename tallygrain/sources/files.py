"""File readers and writers (IO1, IO2, IO4–IO10). Every write is made by the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain.operators.contracts import relation_rules, row_counts
from tallygrain.schemas import SCHEMAS, Tables

DATE_FORMAT = "yyyy-MM-dd"


def read_csv_tables(spark: SparkSession, folder: str) -> Tables:
    """IO1: the five tables from ``<folder>/<table>.csv``, with their declared types; bad cells fail."""
    reader = spark.read.option("header", True).option("dateFormat", DATE_FORMAT).option("mode", "FAILFAST")
    return Tables(**{name: reader.schema(schema).csv(f"{folder}/{name}.csv") for name, schema in SCHEMAS.items()})


def write_csv_tables(tables: Tables, folder: str, *, mode: str = "errorifexists") -> None:
    """IO2: the five tables as CSV with ISO dates."""
    for name, frame in tables.items():
        frame.write.mode(mode).option("header", True).option("dateFormat", DATE_FORMAT).csv(f"{folder}/{name}.csv")


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """IO3: the five stored tables; fails early and names every one that is missing."""
    return Tables(**load_artifacts(spark, {name: f"{folder}/{name}" for name in SCHEMAS}))


def store_tables(tables: Tables, folder: str, *, replace: bool = False) -> DataFrame:
    """IO4: store the tables as parquet and return the stored row counts.

    A target that already holds rows is refused unless ``replace``. All targets are checked before
    the first one is written.
    """
    spark = tables.customers.sparkSession
    if not replace:
        filled = [name for name in SCHEMAS if _holds_rows(spark, f"{folder}/{name}")]
        if filled:
            raise ValueError(f"Target tables are not empty: {', '.join(filled)}")
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    return row_counts(read_tables(spark, folder))


def _holds_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def load_check(loaded: Tables, stored: Tables) -> DataFrame:
    """IO5: per table loaded and stored rows, and per relation the stored orphans, as (check, expected, found)."""
    counts = row_counts(loaded).withColumnRenamed("rows", "expected").join(
        row_counts(stored).withColumnRenamed("rows", "found"), "table"
    )
    orphans = relation_rules(stored).select(
        F.col("rule").alias("check"), F.lit(0).cast("bigint").alias("expected"), F.col("violations").alias("found")
    )
    return counts.select(F.col("table").alias("check"), "expected", "found").unionByName(orphans)


def json_safe(frame: DataFrame) -> DataFrame:
    """IO6: non-finite numbers as null, in columns, structs, arrays and map values."""

    def safe(value, kind: T.DataType):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: safe(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: safe(x, kind.valueType))
        if isinstance(kind, T.StructType):
            inner = F.struct(*[safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), inner)
        return value

    return frame.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in frame.schema.fields])


def write_json(frame: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """IO6: one strict JSON object per row."""
    json_safe(frame).write.mode(mode).json(path)


def write_result(frame: DataFrame, path: str, *, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """IO7: scores, forecasts, backtests and predictions."""
    if kind not in ("parquet", "csv"):
        raise ValueError("kind must be 'parquet' or 'csv'")
    writer = frame.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("dateFormat", DATE_FORMAT).csv(path)
    else:
        writer.parquet(path)


def load_artifacts(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """IO8: stored results by name; one error names every missing one."""
    found, missing = {}, []
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"Stored results are incomplete; missing: {', '.join(sorted(missing))}")
    return found


def read_corpus(spark: SparkSession, path: str, *, check: bool = True) -> DataFrame:
    """IO9: one row per Markdown file with its whole text; the id is the file name without suffix.

    Suffixes count in any case, and a readme is no document. Unless ``check`` is off, a folder without documents, a
    document without text and an id that two files share are errors.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    documents = (
        spark.read.option("pathGlobFilter", "*.[mM]*")
        .text(path, wholetext=True)
        .select(
            F.regexp_replace(name, r"\.[^.]+$", "").alias("document_id"),
            name.alias("source_path"),
            F.col("value").alias("text"),
        )
        .filter(F.lower("source_path").rlike(r"\.(md|markdown)$") & ~F.lower("source_path").rlike(r"^readme\."))
    )
    if check:
        blank = (F.trim(F.regexp_replace("text", r"\s+", " ")) == "").cast("int")
        state = documents.groupBy("document_id").agg(F.count("*").alias("files"), F.max(blank).alias("blank"))
        bad = state.filter("files > 1 OR blank = 1").orderBy("document_id").limit(5).collect()
        if bad:
            raise ValueError(f"Documents without text, or ids of several files: {[r.document_id for r in bad]}")
        if documents.isEmpty():
            raise ValueError(f"No Markdown documents below {path}")
    return documents


def upsert_repeats(incoming: DataFrame, key: str) -> DataFrame:
    """IO10: keys that several incoming rows share, and how many."""
    return incoming.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, *, replace: bool = False) -> DataFrame:
    """IO10: stored rows not named by the incoming ones, with the incoming rows.

    A key may come in once; ``upsert_repeats`` names those that break this. Write the result to a new path, then point readers to it: parquet has no update in place. ``upsert_stored`` rewrites only the parts of a stored table that change.
    """
    _refuse_repeats(incoming, key)
    if existing is None or replace:
        return incoming
    return _merged(existing, incoming, key)


def _refuse_repeats(incoming: DataFrame, key: str) -> None:
    repeats = upsert_repeats(incoming, key).orderBy(key).limit(5).collect()
    if repeats:
        raise ValueError(f"Incoming rows repeat a key, for example {[tuple(r) for r in repeats]}")


def _merged(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


# The folder column of a table stored by key says into how many buckets keys are hashed.
BUCKET_PREFIX = "bucket_of_"


def _write_buckets(frame: DataFrame, path: str, bucket: str, mode: str) -> None:
    # Rows of a bucket meet in a few files; a bucket that is too large for a task is split.
    frame.hint("rebalance", bucket).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def _bucketed(frame: DataFrame, key: str, bucket: str) -> DataFrame:
    count = int(bucket.removeprefix(BUCKET_PREFIX))
    return frame.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))


def store_by_key(frame: DataFrame, path: str, key: str, *, buckets: int) -> None:
    """IO10: a table in folders by the hash of its key, for ``upsert_stored``. The path must not exist yet.

    Take as many buckets as give files of some 100 MB to 1 GB; the folder names keep the number.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    bucket = f"{BUCKET_PREFIX}{buckets}"
    _write_buckets(_bucketed(frame, key, bucket), path, bucket, "errorifexists")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    frame = spark.read.parquet(path)
    names = [c for c in frame.columns if c.startswith(BUCKET_PREFIX)]
    if len(names) != 1:
        raise ValueError(f"{path} is not stored by key")
    return frame, names[0]


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    """IO10: the rows of a table stored by key."""
    frame, bucket = _stored(spark, path)
    return frame.drop(bucket)


def upsert_stored(incoming: DataFrame, path: str, key: str) -> list[int]:
    """IO10: put incoming rows into a table stored by key, and return the buckets that were rewritten.

    Only buckets that an incoming key falls into are read and replaced; the files of all others stay as they are. New
    files are staged beside the table and take the place of the old ones when the job is committed, so a lost executor
    changes nothing; readers should wait for the commit. A key may come in once. An empty increment changes nothing.
    """
    _refuse_repeats(incoming, key)
    stored, bucket = _stored(incoming.sparkSession, path)
    arriving = _bucketed(incoming, key, bucket)
    # At most as many numbers as there are buckets.
    touched = sorted(r[0] for r in arriving.select(bucket).distinct().collect())
    if touched:
        _write_buckets(_merged(stored.filter(F.col(bucket).isin(touched)), arriving, key), path, bucket, "overwrite")
    return touched
