"""Registered reader and writer queries (IO1–IO10): what is written is read back and reported."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallygrain.operators import kpis
from tallygrain.operators.contracts import row_counts
from tallygrain.plans.base import Registry
from tallygrain.plans.contract_queries import ALL_ROLES, KEYS, SOURCES
from tallygrain.plans.kpi_queries import monthly_revenue_sql
from tallygrain.schemas import SCHEMAS
from tallygrain.session import ensure_checkpoint_dir
from tallygrain.sources import files, roles

SOURCE = Registry()


def _folder(spark) -> str:
    """A new folder in the shared place the session names."""
    return f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


def _typed(spark, folder):
    """The roles in the declared column types."""
    tables = roles.business_tables(spark, folder)
    return tables.with_tables(
        **{
            name: frame.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])
            for name, frame in tables.items()
        }
    )


def _counts_sql(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", {columns} FROM {SOURCES.get(table, table)}" for table in KEYS
    )


@SOURCE.add("csv_round_trip", _counts_sql("count(*) AS rows"), ALL_ROLES)
def csv_round_trip(spark, folder):
    target = _folder(spark)
    files.write_csv_tables(_typed(spark, folder), target)
    return row_counts(files.read_csv_tables(spark, target))


@SOURCE.add(
    "csv_values",
    """SELECT region, plan_type, CAST(sum(CAST(net_revenue AS DECIMAL(14,2))) AS DOUBLE) AS net_revenue,
      min(sale_date) AS first_sale, max(sale_date) AS last_sale FROM sales GROUP BY ALL""",
    ["sales"],
)
def csv_values(spark, folder):
    target = _folder(spark)
    files.write_csv_tables(_typed(spark, folder), target)
    return files.read_csv_tables(spark, target).sales.groupBy("region", "plan_type").agg(
        F.sum("net_revenue").cast("double").alias("net_revenue"),
        F.min("sale_date").alias("first_sale"),
        F.max("sale_date").alias("last_sale"),
    )


@SOURCE.add("store_tables", _counts_sql("count(*) AS rows"), ALL_ROLES)
def store_tables(spark, folder):
    return files.store_tables(_typed(spark, folder), _folder(spark))


@SOURCE.add(
    "load_check",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"check\", count(*) AS expected, count(*) AS found FROM {SOURCES.get(t, t)}" for t in KEYS
    )
    + "".join(
        f" UNION ALL SELECT '{name} has no parent', 0::BIGINT, 0::BIGINT"
        for name in ("subscriptions_customer", "sales_customer", "sales_subscription", "tickets_customer")
    ),
    ALL_ROLES,
)
def load_check(spark, folder):
    loaded, target = _typed(spark, folder), _folder(spark)
    files.store_tables(loaded, target)
    return files.load_check(loaded, files.read_tables(spark, target))


@SOURCE.add(
    "json_round_trip",
    f"SELECT month, net_revenue, CASE WHEN month(month) > 1 THEN discount_rate END AS discount_rate FROM ({monthly_revenue_sql()})",
    ["sales"],
)
def json_round_trip(spark, folder):
    monthly = kpis.monthly_revenue(roles.sales(spark, folder)).select("month", "net_revenue", "discount_rate")
    spoiled = monthly.withColumn(
        "discount_rate", F.when(F.month("month") == 1, float("nan")).otherwise(F.col("discount_rate"))
    )
    target = _folder(spark)
    files.write_json(spoiled, target)
    return spark.read.schema("month date, net_revenue double, discount_rate double").json(target)


@SOURCE.add("result_round_trip", f"SELECT month, net_revenue FROM ({monthly_revenue_sql()})", ["sales"])
def result_round_trip(spark, folder):
    target = _folder(spark)
    files.write_result(kpis.monthly_revenue(roles.sales(spark, folder)), target)
    return files.load_artifacts(spark, {"monthly": target})["monthly"].select("month", "net_revenue")


@SOURCE.add(
    "upsert",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END AS text,
      CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM documents""",
)
def upsert(spark, folder):
    """Two thirds are stored only, a sixth comes in anew, a sixth replaces what is stored."""
    documents = roles.table(spark, folder, "documents").select("doc_id", "text")
    existing = documents.filter("doc_id % 6 <> 3").withColumn("origin", F.lit("old"))
    incoming = documents.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new "), "text").alias("text"), F.lit("new").alias("origin"))
    return files.upsert(existing, incoming, "doc_id")


@SOURCE.add(
    "upsert_stored",
    """SELECT o_orderkey, CASE WHEN o_orderdate >= (SELECT max(o_orderdate) FROM orders) THEN 'U' ELSE o_orderstatus END
      AS o_orderstatus, o_totalprice FROM orders""",
)
def upsert_stored(spark, folder):
    """Orders of the last day come in again with another status; only their buckets are rewritten."""
    orders = roles.table(spark, folder, "orders")
    last = orders.agg(F.max("o_orderdate").alias("o_orderdate"))
    incoming = orders.join(last, "o_orderdate").select("o_orderkey", F.lit("U").alias("o_orderstatus"), "o_totalprice")
    target = _folder(spark)
    files.store_by_key(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), target, "o_orderkey", buckets=16)
    files.upsert_stored(incoming, target, "o_orderkey")
    return files.read_by_key(spark, target)


@SOURCE.add("upsert_repeats", "SELECT o_custkey AS customer, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def upsert_repeats(spark, folder):
    incoming = roles.table(spark, folder, "orders").select(F.col("o_custkey").alias("customer"))
    return files.upsert_repeats(incoming, "customer")
