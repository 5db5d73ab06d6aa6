"""Connected components of links held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.session import materialize


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest id reachable from every id that has a link: columns ``id``, ``component_id``.

    Alternates two steps until nothing changes: larger neighbours are tied to the smallest neighbour, then smaller
    neighbours are tied to the smallest one. Every step is a grouped minimum and a join, so an id with very many links
    is summed up before the shuffle and its partition can be split in the join. Self links and nulls are left out;
    repeated links do no harm.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(nearest, "u")
        small = joined.select(
            F.explode(
                F.when(
                    F.col("v") == F.col("m"), F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
                ).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            ).alias("e")
        ).select("e.u", "e.v")
        small = materialize(small.where("u > v").distinct())
        # Settled when no id has two smaller neighbours and no smaller neighbour has one of its own.
        parents = small.select(F.col("v").alias("u")).distinct()
        open_chain = small.join(parents, "u", "left_semi").limit(1).count()
        if not open_chain and small.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
        edges = small
    roots = small.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return small.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
