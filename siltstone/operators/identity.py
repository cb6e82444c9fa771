"""Identities: normal forms of what names an entity, links resolved by them, and columns that hold variants of one
another's identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import fold


def norm_name(c: Column) -> Column:
    """Upper case; full stops and apostrophes go without a trace, other signs become blanks; blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[.'’]", ""), r"[^A-Z0-9]+", " "))


def norm_tail(c: Column) -> Column:
    """A tail number in upper case without blanks and hyphens, and without its leading N if a digit follows."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"[\s\-]+", ""), r"^N(?=[0-9])", "")


def norm_code(c: Column) -> Column:
    """A code without signs and leading zeros, in upper case: '00-12.a' is '12A'."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", ""), r"^0+(?=.)", "")


NORMALS = {"text": fold, "name": norm_name, "tail": norm_tail, "code": norm_code}


def resolve_links(child: DataFrame, child_id: str, child_key: str, parent: DataFrame, parent_id: str, parent_key: str, normal: str = "text") -> DataFrame:
    """(child_id, parent_id) for each child whose key in normal form is that of one parent only; blank keys and keys of
    several parents link nothing. Parents are reduced to a row a key before the join."""
    form = NORMALS[normal]
    p = parent.select(form(F.col(parent_key).cast("string")).alias("_k"), F.col(parent_id).alias("_p")).where("_k <> ''").groupBy("_k").agg(F.min("_p").alias("_p"), F.max("_p").alias("_q")).where("_p = _q")
    c = child.select(F.col(child_id).alias("child_id"), form(F.col(child_key).cast("string")).alias("_k")).where("_k <> ''").distinct()
    return c.join(p, "_k").select("child_id", F.col("_p").alias("parent_id"))


def variant_columns(values: DataFrame, least: float = 0.6, gain: float = 2.0, unique: float = 0.8) -> DataFrame:
    """(left, right, plain, residual): pairs of columns whose identifiers overlap far more once brought to norm_code.

    values: (col, value, n) as from relationships.column_values. plain and residual are the shares of left's distinct values
    that right has, as they stand and in normal form. left's values must be nearly unique in their column."""
    forms = values.withColumn("code", norm_code(F.col("value"))).where("code <> ''")
    facts = values.groupBy("col").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("rows"))
    codes = forms.select("col", "code").distinct()
    sizes = codes.groupBy("col").agg(F.count(F.lit(1)).alias("codes"))

    def shared(rows: DataFrame, key: str) -> DataFrame:
        # columns meet by their values: a value's columns are few, so no value is paired with itself over rows
        together = rows.groupBy(key).agg(F.collect_set("col").alias("cols")).where(F.size("cols") > 1)
        pairs = together.select(F.explode("cols").alias("left"), "cols").select("left", F.explode("cols").alias("right")).where("left <> right")
        return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("both"))

    plain = shared(values.select("col", "value"), "value").withColumnRenamed("both", "same")
    met = shared(codes, "code").join(plain, ["left", "right"], "left")
    met = met.join(F.broadcast(facts.withColumnRenamed("col", "left")), "left").join(F.broadcast(sizes.withColumnRenamed("col", "left")), "left")
    met = met.select("left", "right", (F.coalesce("same", F.lit(0)) / F.col("d")).alias("plain"), (F.col("both") / F.col("codes")).alias("residual"), (F.col("d") / F.col("rows")).alias("unique"))
    return met.where((F.col("residual") >= least) & (F.col("residual") >= gain * F.col("plain")) & (F.col("unique") >= unique)).drop("unique")
