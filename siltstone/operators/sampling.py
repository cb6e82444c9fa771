"""Subsets of several tables that keep their joins, stratified samples, and join-preserving tokenization."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.numbering import numbered


def apportion(sizes: dict[str, int], budget: int) -> dict[str, int]:
    """Rows of each table within a budget, in proportion to size by largest remainder, at least one of each."""
    total = sum(sizes.values())
    if total <= budget:
        return dict(sizes)
    exact = {t: budget * n / total for t, n in sizes.items()}
    out = {t: max(1 if sizes[t] else 0, int(x)) for t, x in exact.items()}
    for t in sorted(sizes, key=lambda t: (-(exact[t] - int(exact[t])), t)):
        if sum(out.values()) >= budget:
            break
        out[t] = min(sizes[t], out[t] + 1)
    return out


def joinable_subset(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """(parents, children) within a budget: children by hash of their key, then exactly the parents they refer to
    as far as the budget goes, so that the subset joins as the whole does."""
    sizes = apportion({"parent": parent.count(), "child": child.count()}, budget)
    keys = child.select(child_key).where(F.col(child_key).isNotNull()).distinct().orderBy(F.xxhash64(child_key), child_key).limit(sizes["parent"])
    p = parent.join(keys.withColumnRenamed(child_key, "_k"), parent[parent_key] == F.col("_k"), "left_semi")
    c = child.join(keys, child_key, "left_semi").orderBy(F.xxhash64(*child.columns)).limit(sizes["child"])
    return p, c


def stratified(df: DataFrame, key: str, rows: int, strata: int = 16) -> DataFrame:
    """About rows rows, the same from each hash stratum of the key; null keys are a stratum of their own."""
    part = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(strata))).cast("int")
    parted = df.withColumn("_s", part)
    sizes = {r["_s"]: r["count"] for r in parted.groupBy("_s").count().collect()}  # a row a stratum
    if sum(sizes.values()) <= rows:
        return df
    each = -(-rows // (strata + 1))
    # the smallest hashes of a stratum stand below a share of their range that follows from its size: few rows are sorted
    bounds = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, (4 * each + 60) / n))])
    likely = parted.withColumn("_h", F.xxhash64(*df.columns)).where(F.pmod("_h", F.lit(2**32)) <= F.element_at(bounds, F.col("_s")) * 2**32)
    order = Window.partitionBy("_s").orderBy(F.pmod("_h", F.lit(2**32)), "_h")
    return likely.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_s", "_n", "_h")


def tokenize(c: Column, secret: bytes) -> Column:
    """A keyed token of a text: equal texts give equal tokens, so joins stay; letters stay letters, digits digits."""

    @F.pandas_udf("string")
    def token(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            stream, out, i = b"", [], 0
            for ch in v:
                if i >= len(stream):
                    stream += hmac.new(secret, f"{len(stream)}\0{v}".encode(), hashlib.sha256).digest()
                b = stream[i]
                i += 1
                out.append(chr(65 + b % 26) if ch.isupper() else chr(97 + b % 26) if ch.islower() else chr(48 + b % 10) if ch.isdigit() else ch)
            return "".join(out)

        return values.map(one)

    return token(c)


def affine(c: Column, a: int, b: int) -> Column:
    """An order-preserving injective map of whole numbers, a > 0."""
    if a < 1:
        raise ValueError("a must be at least 1")
    return c * a + b


def shift_dates(c: Column, days: int, low: str, span: int) -> Column:
    """Dates shifted by days inside [low, low + span), wrapping around."""
    start = F.lit(low).cast("date")
    return F.date_add(start, F.pmod(F.datediff(c, start) + days, F.lit(span)))


def even_sample(df: DataFrame, column: str, k: int) -> DataFrame:
    """(column): k distinct values at even distances of their sorted order, halves rounded to even places; all if there are
    no more. Nulls aren't values. The order is counted by ranges, without a task that sees all values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    n = values.count()
    if n <= k:
        return values
    places = [round(i * (n - 1) / (k - 1)) for i in range(k)] if k > 1 else [0]
    spark = df.sparkSession
    wanted = spark.createDataFrame([(p,) for p in sorted(set(places))], "_place long")
    return numbered(values, [column], 0, "_place").join(F.broadcast(wanted), "_place", "left_semi").select(column)
