"""Database reader and writer over JDBC (IO3, IO4)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.schemas import DATE_COLUMNS, PRIMARY_KEYS, SCHEMAS, Tables


def hash_predicates(column: str, partitions: int, hash_function: str = "hashtext") -> list[str]:
    """One WHERE clause per read task for text keys, which have no numeric range to split."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return [f"mod(abs({hash_function}({column})), {partitions}) = {i}" for i in range(partitions)]


def read_jdbc_tables(
    spark: SparkSession, url: str, properties: Mapping[str, str], *, partitions: int = 16
) -> Tables:
    """IO3: the five tables, each read by several tasks."""
    return Tables(
        **{
            name: spark.read.jdbc(
                url, name, predicates=hash_predicates(PRIMARY_KEYS[name], partitions), properties=dict(properties)
            ).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
            for name, schema in SCHEMAS.items()
        }
    )


def write_jdbc_table(
    frame: DataFrame, url: str, name: str, properties: Mapping[str, str], *, replace: bool = False, batch: int = 2000
) -> None:
    """IO4: append to an empty table, or replace its rows, keeping its definition."""
    stored = frame.sparkSession.read.jdbc(url, name, properties=dict(properties))
    if not replace and not stored.isEmpty():
        raise ValueError(f"Target table is not empty: {name}")
    typed = frame.withColumns({c: F.col(c).cast("date") for c in DATE_COLUMNS.get(name, ())})
    typed.write.option("truncate", True).option("batchsize", batch).jdbc(
        url, name, mode="overwrite" if replace else "append", properties=dict(properties)
    )
