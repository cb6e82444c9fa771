"""What changed between two loads of a table, how severe it is, and where it goes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.quality import Expectation
from siltstone.operators.relationships import column_values

# From what distance of value sets on a column counts as drifted, and what each kind of signal leads to.
VALUE_SET_LIMIT = 0.5
ROUTES = {"schema": "evolve", "distribution": "reverify", "quality": "quarantine"}


def severity(statistic: Column, threshold: float) -> Column:
    """0.5 at the threshold, rising to 0.99 at twice it."""
    if threshold <= 0:
        return F.lit(0.99)
    return F.least(F.lit(0.99), 0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (statistic - threshold) / threshold)))


def value_sets(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(column, old_distinct, new_distinct, common): all columns in one aggregation over their distinct values."""
    a, b = column_values({"t": (old, columns)}).select("col", "value", F.lit(1).alias("a"), F.lit(0).alias("b")), column_values({"t": (new, columns)}).select("col", "value", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("col", "value").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.groupBy(F.expr("substr(col, 3)").alias("column")).agg(F.sum("a").alias("old_distinct"), F.sum("b").alias("new_distinct"), F.sum(F.col("a") * F.col("b")).alias("common"))


def value_set_drift(old: DataFrame, new: DataFrame, columns: list[str], limit: float = VALUE_SET_LIMIT) -> DataFrame:
    """(column, distance, drifted, severity): 1 - Jaccard of the distinct values of both loads."""
    c = F.col("common")
    distance = 1 - c / (F.col("old_distinct") + F.col("new_distinct") - c)
    rows = value_sets(old, new, columns).withColumn("distance", distance)
    return rows.select("column", "distance", (F.col("distance") > limit).alias("drifted"), F.when(F.col("distance") > limit, severity(F.col("distance"), limit)).alias("severity"))


def append_mostly(old: DataFrame, new: DataFrame, columns: list[str], floor: float = 0.7, share: float = 0.8) -> DataFrame:
    """One row: old_rows, new_rows, comparable and consistent columns, append_mostly. Pure appending keeps every old value,
    so a column's Jaccard is then its old by its new number of distinct values; rows must have grown."""
    sets = value_sets(old, new, columns).where("old_distinct > 0 and new_distinct > 0")
    jaccard = F.col("common") / (F.col("old_distinct") + F.col("new_distinct") - F.col("common"))
    fits = jaccard >= floor * F.least(F.lit(1.0), F.col("old_distinct") / F.col("new_distinct"))
    counts = sets.agg(F.count(F.lit(1)).alias("comparable"), F.coalesce(F.sum(fits.cast("int")), F.lit(0)).alias("consistent"))
    rows = old.agg(F.count(F.lit(1)).alias("old_rows")).join(F.broadcast(new.agg(F.count(F.lit(1)).alias("new_rows")))).join(F.broadcast(counts))
    return rows.withColumn("append_mostly", (F.col("new_rows") > F.col("old_rows")) & (F.col("comparable") > 0) & (F.col("consistent") >= share * F.col("comparable")))


def route(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """signals (kind, severity, ...) with route: evolve, reverify or quarantine; those below the least severity, and
    kinds that aren't known, are suppressed."""
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return signals.withColumn("route", F.when(F.coalesce(F.col("severity") >= least, F.lit(False)), F.coalesce(F.try_element_at(routes, F.col("kind")), F.lit("suppressed"))).otherwise("suppressed"))


def contract(name: str, df: DataFrame, expectations: list[Expectation]) -> str:
    """A table's data contract as JSON: its columns and types, and what is expected of them."""
    rules = [{"column": e.column, "kind": e.kind, "argument": list(e.argument) if isinstance(e.argument, tuple) else e.argument} for e in expectations]
    return json.dumps({"table": name, "columns": dict(df.dtypes), "expectations": rules}, sort_keys=True, indent=1)


def parse_contract(text: str) -> tuple[str, dict[str, str], list[Expectation]]:
    c = json.loads(text)
    return c["table"], c["columns"], [Expectation(e["column"], e["kind"], tuple(e["argument"]) if isinstance(e["argument"], list) else e["argument"]) for e in c["expectations"]]
