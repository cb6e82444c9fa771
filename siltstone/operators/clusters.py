"""Clusters of matched records: pivot correlation clustering inside components, stable identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut, discard


def pivot_clusters(component: DataFrame, edges: DataFrame) -> DataFrame:
    """(record, cluster) by pivot clustering: in an order given by hashes, each record not yet taken is a pivot and
    takes its unassigned neighbours of the same component.

    In rounds, so that components may have any size: a record is settled once its earlier neighbours are. It is a
    pivot if none of these is one, else it belongs to the first of them that is. That is what the order one by one gives.

    component: record, component. edges: a, b (positive pairs)."""
    of = component.where("record is not null").select("record", "component").dropDuplicates(["record"]).withColumn("rank", F.struct(F.md5(F.col("record").cast("string")).alias("h"), F.col("record").cast("string").alias("r")))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    x, y = (of.select(F.col("record").alias(n), F.col("component").alias(f"c{n}"), F.col("rank").alias(f"r{n}")) for n in ("a", "b"))
    # b comes before a
    before = cut(both.join(x, "a").join(y, "b").where("ca <=> cb and rb < ra").select("a", "b", "rb"))
    # pivot: null while a record is open
    state = cut(of.select("record", F.lit(None).cast(before.schema["b"].dataType).alias("pivot")))
    while not state.where("pivot is null").isEmpty():
        first = before.join(state.where("pivot is null").select(F.col("record").alias("a")), "a").join(state.select(F.col("record").alias("b"), "pivot"), "b")
        open_, is_pivot = F.col("pivot").isNull(), F.col("pivot") == F.col("b")
        # the earliest neighbour that is a pivot takes the record, unless an earlier one is still open
        seen = first.groupBy("a").agg(F.min(F.when(open_, F.col("rb"))).alias("waits"), F.min(F.when(is_pivot, F.col("rb"))).alias("taken"), F.min_by("b", F.when(is_pivot, F.col("rb"))).alias("by"))
        after = state.join(seen.withColumnRenamed("a", "record"), "record", "left")
        taken = F.col("taken").isNotNull() & (F.col("waits").isNull() | (F.col("taken") < F.col("waits")))
        own = F.col("taken").isNull() & F.col("waits").isNull()
        after = cut(after.select("record", F.coalesce("pivot", F.when(taken, F.col("by")).when(own, F.col("record"))).alias("pivot")))
        discard(state)
        state = after
    label = state.groupBy("pivot").agg(F.min(F.col("record").cast("string")).alias("cluster"))
    return state.join(label, "pivot").select("record", "cluster")


def assign_identifiers(clusters: DataFrame, prior: DataFrame, prefix: str = "ent/") -> DataFrame:
    """(record, uri): a cluster keeps the prior uri that most of its records had, ties by the smaller; a uri goes to
    the cluster that has most of its records, so that no two clusters share one. Others get a new one by content."""
    held = clusters.join(prior, "record").groupBy("cluster", "uri").agg(F.count(F.lit(1)).alias("n"))
    best = held.groupBy("cluster").agg(F.max_by("uri", F.struct("n", F.xxhash64("uri"))).alias("uri"), F.max("n").alias("n"))
    owner = best.groupBy("uri").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("cluster"))
    named = clusters.join(owner, "cluster", "left")
    return named.select("record", F.coalesce("uri", F.concat(F.lit(prefix), F.substring(F.md5(F.col("cluster").cast("string")), 1, 16))).alias("uri"))
