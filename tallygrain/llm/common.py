"""What several operators of this package need: narrow inputs, written intermediate tables, Arrow output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallygrain.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id, the text, and ``part``: a checksum that tells apart rows that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        (F.crc32(F.coalesce(text, F.lit("")).cast("binary")) - (1 << 31)).cast("int").alias("part"),
    )


def unused(name: str, frame: DataFrame) -> str:
    """The name, with as many underscores before it as it takes to differ from all columns of a frame."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name = f"_{name}"
    return name


def written(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet below the shared checkpoint folder and read it back, which cuts its lineage."""
    spark = frame.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def map_whole_rows(frame: DataFrame, run: Callable, added: Sequence[StructField] = ()) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names: a task sees them as c0, c1 and so on."""
    fields = [*frame.schema.fields, *added]
    schema = StructType([StructField(f"c{i}", field.dataType) for i, field in enumerate(fields)])
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    return plain.mapInArrow(run, schema).toDF(*[field.name for field in fields])


def to_batch(columns: Mapping[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def in_pieces(columns: Mapping[str, np.ndarray], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    count = len(next(iter(columns.values())))
    for begin in range(0, count, size):
        yield to_batch({name: values[begin : begin + size] for name, values in columns.items()}, schema)


def range_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of all listed ranges, and the number of the row that each belongs to."""
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    row = np.repeat(np.arange(len(column)), lengths)
    return flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64), row


def spread(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, and the number of the range of each."""
    of = np.repeat(np.arange(len(begin)), length)
    before = np.cumsum(length) - length
    return np.arange(len(of)) - before[of] + begin[of], of


def listed(ranges: DataFrame) -> DataFrame:
    """All ranges (lo, n) of a text, without repeats, in one row."""
    return ranges.groupBy("doc_id", "part").agg(F.collect_set(F.struct("lo", "n")).alias("ranges"))
