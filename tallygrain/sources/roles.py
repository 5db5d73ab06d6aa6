"""Star-schema parquet tables seen as the five business tables.

Every rule is a row-local expression or a key join, so filters and column pruning reach the scans.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.functions.exprs import money
from tallygrain.schemas import Tables

CHANNELS = ("Direct", "Online", "Partner", "Referral")


# Column types of the star schema; reading with them opens no file while a plan is built.
STAR_SCHEMA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMA[name]).parquet(f"{folder}/{name}.parquet")


def _customer_places(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"), F.col("n_name").alias("country")
    )
    return table(spark, folder, "customer").join(places, "c_nationkey")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    history = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min(F.col("o_orderdate").cast("date")).alias("signup_date"),
            F.bool_or(F.col("o_orderstatus") == "O").alias("any_active"),
        )
    )
    balance = F.col("c_acctbal")
    return (
        _customer_places(spark, folder)
        .join(history, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            "region",
            "country",
            F.col("c_mktsegment").alias("industry"),
            F.when(balance < 2500, "Small").when(balance < 7500, "Medium").otherwise("Enterprise").alias("company_size"),
            F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("c_custkey") % 4 + 1).cast("int")).alias(
                "acquisition_channel"
            ),
            "signup_date",
            F.when(F.col("any_active"), "active").otherwise("inactive").alias("customer_status"),
        )
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    price, start = F.col("o_totalprice"), F.col("o_orderdate").cast("date")
    state = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(price < 125000, "Basic").when(price < 350000, "Professional").otherwise("Enterprise").alias("plan_type"),
        start.alias("start_date"),
        F.date_add(start, 365).alias("renewal_date"),
        F.when(state != "O", F.date_add(start, (F.col("o_orderkey") % 445 + 75).cast("int"))).alias("end_date"),
        money(price).alias("monthly_price"),
        (F.col("o_orderkey") % 420 + 1).cast("int").alias("seats"),
        F.when(state == "O", "active").when(state == "F", "cancelled").otherwise("expired").alias("subscription_status"),
    )


def sale_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Customer, plan and region of each subscription. Both sides are unique on their key."""
    return (
        subscriptions(spark, folder)
        .select("subscription_id", "customer_id", "plan_type")
        .join(
            _customer_places(spark, folder).select(F.col("c_custkey").alias("customer_id"), "region"), "customer_id"
        )
    )


def sale_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sales as their lines alone tell them: no customer, plan or region, and so no join."""
    gross = money("l_extendedprice")
    discount = gross * F.col("l_discount").cast("decimal(4,2)")
    return (
        table(spark, folder, "lineitem")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sale_id"),
            F.col("l_orderkey").alias("subscription_id"),
            F.col("l_shipdate").cast("date").alias("sale_date"),
            gross.alias("gross_revenue"),
            discount.cast("decimal(18,4)").alias("discount_amount"),
            (gross - discount).cast("decimal(18,4)").alias("net_revenue"),
            F.col("l_returnflag").alias("sales_channel"),
        )
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with the customer, region and plan of their owners.

    Owners are joined to each other first, so a hot order or customer only repeats on the line-item side, which a skew
    join can split.
    """
    return (
        sale_lines(spark, folder)
        .join(sale_owners(spark, folder), "subscription_id")
        .select(
            "sale_id", "customer_id", "subscription_id", "sale_date", "region", "plan_type",
            "gross_revenue", "discount_amount", "net_revenue", "sales_channel",
        )
    )


def event_costs(spark: SparkSession, folder: str) -> DataFrame:
    """One cost row per day of the event stream: a component per event type."""
    parts = {"compute_cost": "view", "storage_cost": "click", "network_cost": "signup", "gpu_cost": "purchase"}
    value = money("value")
    daily = (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin(*parts.values()))
        .groupBy(F.col("ts").cast("date").alias("date"))
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("event_type") == kind, value)), F.lit(Decimal(0))).alias(name)
                for name, kind in parts.items()
            ]
        )
    )
    return daily.select(
        F.date_format("date", "yyyy-MM-dd").alias("cost_id"),
        "date",
        F.lit("ALL").alias("region"),
        F.lit("events").alias("service_type"),
        *parts,
        sum((F.col(name) for name in list(parts)[1:]), F.col("compute_cost")).alias("total_cost"),
    )


def shipping_costs(spark: SparkSession, folder: str) -> DataFrame:
    """One cost row per day and supplier region, from the tax on line items.

    Suppliers are unique on their key, so a hot supplier repeats on the line-item side only, which a
    skew join can split. Rows of one day and region are summed before the shuffle.
    """
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    sites = (
        table(spark, folder, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region"))
    )
    tax = (money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    parts = {
        "compute_cost": (flag == "A") & (status == "O"),
        "storage_cost": flag == "N",
        "network_cost": (flag == "A") & (status == "F"),
        "gpu_cost": flag == "R",
    }
    zero = F.lit(Decimal(0))
    return (
        table(spark, folder, "lineitem")
        .join(sites, "l_suppkey")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), "region")
        .agg(
            *[F.coalesce(F.sum(F.when(rule, tax)), zero).alias(name) for name, rule in parts.items()],
            F.sum(tax).alias("total_cost"),
        )
        .select(
            F.concat_ws("-", F.date_format("date", "yyyy-MM-dd"), "region").alias("cost_id"),
            "date",
            "region",
            F.lit("shipping").alias("service_type"),
            *parts,
            "total_cost",
        )
    )


def support_tickets(spark: SparkSession, folder: str, *, months_back: int = 0) -> DataFrame:
    """Events as tickets; ``months_back`` moves them into the period of the subscriptions."""
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value").cast("decimal(12,2)")
    created = F.add_months(F.col("ts").cast("date"), -months_back)
    raw = F.lit(Decimal("5.15")) - F.lit(Decimal("0.055")) * value
    score = F.least(F.greatest(raw, F.lit(Decimal("1"))), F.lit(Decimal("5"))).cast("decimal(8,5)")
    event = F.col("event_id")
    return table(spark, folder, "events").select(
        event.alias("ticket_id"),
        F.col("user_id").alias("customer_id"),
        created.alias("created_date"),
        F.when(event % 50 != 0, F.date_add(created, (event % 7).cast("int"))).alias("resolved_date"),
        F.col("event_type").alias("ticket_category"),
        F.when(k < 26, "Low").when(k < 72, "Medium").when(k < 95, "High").otherwise("Critical").alias("severity"),
        value.alias("resolution_hours"),
        F.when(event % 12 != 0, score).alias("satisfaction_score"),
        F.when(event % 50 == 0, "open").otherwise("resolved").alias("status"),
    )


def business_tables(spark: SparkSession, folder: str, *, ticket_months_back: int = 0) -> Tables:
    return Tables(
        customers=customers(spark, folder),
        subscriptions=subscriptions(spark, folder),
        sales=sales(spark, folder),
        cloud_costs=event_costs(spark, folder),
        support_tickets=support_tickets(spark, folder, months_back=ticket_months_back),
    )
