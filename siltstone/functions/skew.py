"""Splitting hot keys: one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: At most this many keys are ever treated as hot, as a hot key holds at least 1 / MOST_HOT of all rows.
MOST_HOT = 200


def hot_keys(df: DataFrame, keys: Sequence[str], floor: int = 50_000) -> tuple[list[tuple], int]:
    """Keys with more rows than max(floor, rows / MOST_HOT), and the number of rows: at most MOST_HOT keys come to the
    driver. Both are taken in one pass."""
    seen = Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).observe(seen, F.sum("__n").alias("rows"))
    rows = counts.orderBy(F.desc("__n")).limit(MOST_HOT).collect()
    total = seen.get["rows"] or 0
    limit = max(floor, total // MOST_HOT)
    return [tuple(r[k] for k in keys) + (r["__n"],) for r in rows if r["__n"] > limit], total


def join_unique(big: DataFrame, unique: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join big to a side that is unique on key. Rows with a hot key meet their few partners by broadcast
    (at most MOST_HOT rows), the rest by an ordinary join, so no task gets a hot key whole."""
    if not hot:
        return big.join(unique, key, how)
    values = [h[0] if isinstance(h, tuple) else h for h in hot]
    # a null key is not in the list and takes the ordinary join
    is_hot = F.coalesce(F.col(key).isin(values), F.lit(False))
    cold = big.where(~is_hot).join(unique.where(~is_hot), key, how)
    warm = big.where(is_hot).join(F.broadcast(unique.where(is_hot)), key, how)
    return cold.unionByName(warm)


def pairs_within(df: DataFrame, block: str, key: str, largest: int = 2000) -> DataFrame:
    """(a, b), a < b: the keys that share a block. Blocks of more than largest rows are dealt out in parts that meet each
    other once, so no task holds a hot block whole. Null blocks pair nothing."""
    rows = df.select(F.col(block).alias("_b"), F.col(key).alias("a")).where("_b is not null")
    sizes = rows.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / largest).cast("int").alias("_n")).where("_n > 1")
    rows = rows.join(sizes, "_b", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    mine, each = F.pmod(F.xxhash64("a"), F.col("_n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = rows.select("_b", "a", mine.alias("_i"), each.alias("_j"))
    right = rows.select("_b", F.col("a").alias("b"), mine.alias("_j"), each.alias("_i"))
    return left.join(right, ["_b", "_i", "_j"]).where("a < b").select("a", "b")
