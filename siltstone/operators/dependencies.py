"""Functional and inclusion dependencies, executed join validation, relationship signals and verdicts.

Metadata decides on the driver what to test; the data is read by one job per level of candidates, never one per pair.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL = "\0null"


def _filled(c: str) -> Column:
    """Nulls equal each other in dependencies."""
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL))


def functional_dependencies(df: DataFrame, columns: list[str] | None = None, max_lhs: int = 3, approximate: float = 0.98) -> DataFrame:
    """(lhs, rhs, confidence): minimal dependencies; exact ones by counts of distinct values, approximate ones by
    the share of rows that stay when each lhs keeps its most frequent rhs. Constant columns have an empty lhs."""
    names = list(columns or df.columns)
    spark = df.sparkSession
    d = df.select(*[_filled(c).alias(c) for c in names])
    base = d.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(c).alias(c) for c in names]).first()
    n = base["_n"]
    found: list[tuple[tuple[str, ...], str, float]] = [((), c, 1.0) for c in names if n and base[c] == 1]
    for width in range(1, max_lhs + 1):
        tests = [(lhs, rhs) for lhs in combinations(names, width) for rhs in names if rhs not in lhs and base[rhs] > 1 and all(base[c] > 1 for c in lhs)]
        tests = [(lhs, rhs) for lhs, rhs in tests if not any(set(f) <= set(lhs) and r == rhs for f, r, _ in found)]
        # each lhs value keeps one rhs value: where rhs has many more, too many rows go whatever the data
        most = lambda lhs: min(n, math.prod(base[c] for c in lhs))
        tests = [(lhs, rhs) for lhs, rhs in tests if n - max(0, base[rhs] - most(lhs)) >= approximate * n]
        if not n:
            break
        if not tests:
            continue
        # rows kept: for each lhs value the count of its most frequent rhs; all candidates in one job
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.concat_ws("\x1f", *lhs).alias("x"), F.col(rhs).alias("a")) for i, (lhs, rhs) in enumerate(tests)]))
        counts = d.select(each.alias("t")).select("t.*").groupBy("i", "x", "a").agg(F.count(F.lit(1)).alias("c"))
        kept = counts.groupBy("i", "x").agg(F.max("c").alias("m")).groupBy("i").agg(F.sum("m").alias("kept")).collect()  # a row per candidate
        for r in kept:
            confidence = r["kept"] / n
            if confidence >= approximate:
                found.append((*tests[r["i"]], round(confidence, 4)))
    return spark.createDataFrame([(",".join(lhs), rhs, c) for lhs, rhs, c in found], "lhs string, rhs string, confidence double")


def inclusion_dependencies(tables: dict[str, tuple[DataFrame, list[str]]], min_coverage: float = 0.95, min_distinct: int = 2) -> DataFrame:
    """(lhs, rhs, lhs_distinct, rhs_distinct, common, coverage) over all columns of all tables.

    Distinct values of all columns make one long table; columns that share a value meet by it. A value's columns
    are gathered in a set first, so a value that every column has costs columns squared, not rows squared."""
    parts = None
    for t, (df, columns) in tables.items():
        each = F.explode(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("col"), F.col(c).cast("string").alias("value")) for c in columns]))
        part = df.select(each.alias("x")).select("x.*").where("value is not null").distinct()
        parts = part if parts is None else parts.unionByName(part)
    sizes = parts.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    together = parts.groupBy("value").agg(F.collect_set("col").alias("cols")).where(F.size("cols") > 1)
    pairs = together.select(F.explode("cols").alias("lhs"), "cols").select("lhs", F.explode("cols").alias("rhs")).where("lhs <> rhs")
    common = pairs.groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("common"))
    left = sizes.select(F.col("col").alias("lhs"), F.col("n").alias("lhs_distinct"))
    right = sizes.select(F.col("col").alias("rhs"), F.col("n").alias("rhs_distinct"))
    out = common.join(F.broadcast(left), "lhs").join(F.broadcast(right), "rhs").withColumn("coverage", F.col("common") / F.col("lhs_distinct"))
    return out.where((F.col("coverage") >= min_coverage) & (F.col("lhs_distinct") >= min_distinct)).select("lhs", "rhs", "lhs_distinct", "rhs_distinct", "common", "coverage")


def validate_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """One row of metrics of an executed join, keys compared as strings. Only the multiplicities of both keys are
    joined, never the rows, so a hot key costs nothing."""
    a = left.groupBy(F.col(left_key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(F.col(right_key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("r")).where("k is not null")
    both = a.join(b, "k", "left")
    hit = F.col("r").isNotNull()
    total, matched = F.sum("l"), F.sum(F.when(hit, F.col("l")).otherwise(0))
    null = F.sum(F.when(F.col("k").isNull(), F.col("l")).otherwise(0))
    m = both.agg(total.alias("left_rows"), null.alias("null_rows"), matched.alias("matched_rows"), F.sum(F.col("l") * F.col("r")).alias("joined_rows"), F.max("r").alias("fan_out_max"), F.max(F.when(hit, F.col("l"))).alias("reverse_fan_out_max"))
    keys = b.agg(F.count(F.lit(1)).alias("right_keys"), F.sum("r").alias("right_rows"))
    present = F.col("left_rows") - F.col("null_rows")
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return m.join(F.broadcast(keys)).select(
        "left_rows", ratio(F.col("matched_rows"), present).alias("match_rate"), (1 - ratio(F.col("matched_rows"), present)).alias("orphan_rate"), ratio(F.col("null_rows"), F.col("left_rows")).alias("null_rate"),
        ratio(F.col("joined_rows"), F.col("matched_rows")).alias("fan_out_avg"), F.coalesce("fan_out_max", F.lit(0)).alias("fan_out_max"), F.coalesce("reverse_fan_out_max", F.lit(0)).alias("reverse_fan_out_max"), ratio(F.col("right_keys"), F.col("right_rows")).alias("right_uniqueness"), "right_keys",
    )


def verdict(metrics: DataFrame) -> DataFrame:
    """metrics with a verdict by ordered rules."""
    m = F.col("match_rate")
    rule = (
        F.when(m < 0.05, "UNRELATED")
        .when((m >= 0.9) & (F.col("right_uniqueness") >= 0.999) & (F.col("right_keys") <= 32), "LOOKUP_DIMENSION")
        .when((m >= 0.9) & (F.col("right_uniqueness") >= 0.999), "FK_JOIN")
        .when((F.col("fan_out_avg") > 1.5) & (F.col("reverse_fan_out_max") > 1), "M2M_BRIDGE")
        .when(m >= 0.9, "DENORMALIZATION")
        .otherwise("UNKNOWN")
    )
    return metrics.withColumn("verdict", rule)


def value_overlap(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """One row: distinct values of both columns, common ones, containment both ways, Jaccard, and the Jensen-Shannon
    divergence of their value distributions in bits (1 if a side is empty)."""
    p = a.groupBy(F.col(x).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    q = b.groupBy(F.col(y).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("m")).where("v is not null")
    totals = p.agg(F.sum("n").alias("tn")).join(F.broadcast(q.agg(F.sum("m").alias("tm"))))
    both = p.join(q, "v", "full_outer").join(F.broadcast(totals))
    pn, qn = F.coalesce(F.col("n") / F.col("tn"), F.lit(0.0)), F.coalesce(F.col("m") / F.col("tm"), F.lit(0.0))
    mid = (pn + qn) / 2
    term = F.when(pn > 0, 0.5 * pn * F.log2(pn / mid)).otherwise(0.0) + F.when(qn > 0, 0.5 * qn * F.log2(qn / mid)).otherwise(0.0)
    s = both.agg(F.count("n").alias("left_distinct"), F.count("m").alias("right_distinct"), F.sum((F.col("n").isNotNull() & F.col("m").isNotNull()).cast("int")).alias("common"), F.count(F.lit(1)).alias("either"), F.sum(term).alias("js"))
    r = lambda u, v: F.coalesce(F.try_divide(F.col(u), F.col(v)), F.lit(0.0))
    return s.select("left_distinct", "right_distinct", "common", r("common", "left_distinct").alias("containment_left"), r("common", "right_distinct").alias("containment_right"), r("common", "either").alias("jaccard"), F.when((F.col("left_distinct") == 0) | (F.col("right_distinct") == 0), 1.0).otherwise(F.col("js")).alias("divergence"))


def name_similarity(a: str, b: str) -> float:
    """Jaccard of the tokens of two column names, plural endings dropped."""
    import re

    def tokens(s: str) -> set[str]:
        return {t[:-1] if len(t) > 3 and t.endswith("s") else t for t in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", s).lower()) if t}

    x, y = tokens(a), tokens(b)
    return len(x & y) / len(x | y) if x | y else 0.0
