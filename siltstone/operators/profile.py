"""Column profiles: counts, types, quantiles, entropy, tokens, sketches, keys, units.

All columns of a table are unpivoted to (column, value) and profiled by one aggregation, whatever their number.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut

#: Patterns of the datatypes and semantic types.
INTEGER, NUMBER = r"^[-+]?\d+$", r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
BOOLEAN = r"^(?i:true|false|yes|no|t|f|y|n)$"
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}-[A-Za-z]{3}-\d{2,4}|\d{2}\.\d{2}\.\d{4})$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?$"
#: The codes of the states of the USA, the District of Columbia and Puerto Rico.
STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA PR RI SC SD TN TX UT VT VA WA WV WI WY".split()
SEMANTIC = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "tail_number": r"^N[1-9]\d{0,4}[A-Z]{0,2}$",
    "us_state": "^(" + "|".join(STATES) + ")$",
    "currency_amount": r"^(?:[$€£]|USD|EUR|GBP)\s?\d[\d,]*(\.\d+)?$",
    "date": DATE,
}
AGREEMENT = 0.97


def unpivot(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value string) of every cell."""
    names = columns or df.columns
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])).alias("x")).select("x.*")


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, exact distinct values, shortest and longest text, datatype, share that agrees with it."""
    counted = unpivot(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.trim(F.col("value")), F.col("n")
    hit = lambda c: F.sum(F.when(c, n).otherwise(0))
    stats = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("n_null"), F.count("value").alias("n_distinct"),
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.sum(F.length("value") * n).alias("chars"),
        hit(v.rlike(INTEGER) & ~v.rlike(r"^[-+]?0\d")).alias("ints"), hit(v.rlike(NUMBER) & ~v.rlike(r"^[-+]?0\d+$")).alias("numbers"), hit(v.rlike(BOOLEAN)).alias("bools"), hit(v.rlike(DATE)).alias("dates"), hit(v.rlike(DATETIME)).alias("datetimes"),
    )
    full = F.col("n_rows") - F.col("n_null")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), full), F.lit(0.0))
    kind = F.when(full == 0, "string")
    for name, c in (("boolean", "bools"), ("integer", "ints"), ("float", "numbers"), ("date", "dates"), ("datetime", "datetimes")):
        kind = kind.when(share(c) >= AGREEMENT, name)
    kind = kind.when(F.try_divide(F.col("chars"), full) > 80, "text").otherwise("string")
    return stats.select("column", "n_rows", "n_null", "n_distinct", "min_length", "max_length", F.coalesce(F.try_divide(F.col("n_null"), F.col("n_rows")), F.lit(0.0)).alias("null_rate"), F.coalesce(F.try_divide(F.col("n_distinct"), full), F.lit(0.0)).alias("uniqueness"), kind.alias("datatype"))


def semantic_types(df: DataFrame, columns: list[str] | None = None, floor: float = 0.6) -> DataFrame:
    """(column, semantic_type, share) where at least floor of a column's values have the type's pattern."""
    rows = unpivot(df, columns).where("value is not null")
    shares = rows.groupBy("column").agg(*[F.avg(F.trim("value").rlike(p).cast("double")).alias(k) for k, p in SEMANTIC.items()])
    long = shares.select("column", F.explode(F.array(*[F.struct(F.lit(k).alias("semantic_type"), F.col(k).alias("share")) for k in SEMANTIC])).alias("x"))
    return long.select("column", "x.*").where(F.col("share") >= floor)


def deciles(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, decile 0..10, value): the smallest value whose cumulative share reaches the decile. The exact form
    ranks distinct values by their counts, without one task sorting a column; else a sketch is used."""
    steps = [i / 10 for i in range(11)]
    if not exact:
        each = [F.percentile_approx(c, steps, 10_000).alias(c) for c in columns]
        wide = df.agg(*each)
        return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in columns])).alias("x")).select("x.column", F.posexplode("x.q").alias("decile", "value"))
    number = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]))
    counts = df.select(number.alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return exact_quantiles(counts, steps).withColumnRenamed("i", "decile")


def exact_quantiles(counts: DataFrame, steps: list[float]) -> DataFrame:
    """(column, i, value): for each step the least value that at least this share of a column's values doesn't exceed.

    counts: column, value double, n. Values are sorted by ranges over all tasks; each range adds up its own counts, and
    only its sums, a number a range and column, come to the driver. No task holds a column."""
    here = F.spark_partition_id()
    rows = cut(counts.orderBy("column", "value").withColumn("_p", here))
    spark, offsets, totals = counts.sparkSession, [], {}
    for p, c, n in sorted(tuple(r) for r in rows.groupBy("_p", "column").agg(F.sum("n")).collect()):
        offsets.append((p, c, totals.get(c, 0)))
        totals[c] = totals.get(c, 0) + n
    known = spark.createDataFrame([(p, c, o, totals[c]) for p, c, o in offsets], "_p int, column string, before long, total long")
    own = F.sum("n").over(Window.partitionBy("_p", "column").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.join(F.broadcast(known), ["_p", "column"]).withColumn("upto", F.col("before") + own).withColumn("below", F.col("upto") - F.col("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(steps)])
    hit = F.filter(wanted, lambda w: (F.col("upto") >= w["s"] * F.col("total")) & ((F.col("below") < w["s"] * F.col("total")) | (F.col("below") == 0)))
    return ranked.select("column", F.explode(hit).alias("w"), "value").select("column", "w.i", "value")


def approx_distinct(df: DataFrame, columns: list[str], precision: int = 14) -> DataFrame:
    """(column, estimate) by HyperLogLog sketches of 2^precision registers, which merge across tasks and loads."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), precision)).alias("estimate")) for c in columns])
    return df.agg(each.alias("a")).select(F.explode("a").alias("x")).select("x.*")


def value_key(c: Column, kind: str) -> Column:
    """The form in which values of any type are compared: whole numbers are equal in every numeric type, dates, times,
    booleans and texts keep apart. kind is the Spark type's name."""
    if kind == "boolean":
        return F.when(c, "b:1").when(~c, "b:0")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.concat(F.lit("n:"), c.cast("string"))
    if kind in ("float", "double") or kind.startswith("decimal"):
        d = c.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < 2.0**63), F.concat(F.lit("n:"), d.cast("long").cast("string"))).otherwise(F.concat(F.lit("f:"), d.cast("string")))
    if kind == "date":
        return F.concat(F.lit("d:"), c.cast("string"))
    if kind.startswith("timestamp"):
        return F.concat(F.lit("t:"), F.replace(c.cast("string"), F.lit(" "), F.lit("T")))
    return F.concat(F.lit("s:"), c.cast("string"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct, entropy in nats, normalized by the logarithm of the distinct values)."""
    counts = unpivot(df, columns).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # sum(-p ln p) from sums of n and n ln n: one aggregation
    sums = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    h = F.ln("total") - F.col("nlogn") / F.col("total")
    return sums.select("column", "n_distinct", h.alias("entropy"), F.when(F.col("n_distinct") > 1, h / F.ln("n_distinct")).otherwise(0.0).alias("normalized"))


def token_stats(df: DataFrame, text: str, top: int = 10) -> DataFrame:
    """(token, n, share): the most frequent tokens of a text column, ties by token."""
    tokens = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z0-9]+)"), F.lit(1))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("token", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "token").limit(top)


def candidate_keys(df: DataFrame, columns: list[str] | None = None, width: int = 2) -> DataFrame:
    """(key, width): minimal column sets without nulls whose values are unique. One job per width."""
    names = list(columns or df.columns)
    first = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c_{c}") for c in names], *[F.count_distinct(c).alias(f"d_{c}") for c in names]).first()
    whole = [c for c in names if first[f"c_{c}"] == first["_n"]]
    found = [(c,) for c in whole if first["_n"] and first[f"d_{c}"] == first["_n"]]
    for w in range(2, width + 1):
        sets = [s for s in combinations(whole, w) if not any(set(f) <= set(s) for f in found)]
        # a set whose distinct counts can't multiply to the rows is no key
        sets = [s for s in sets if _product(first[f"d_{c}"] for c in s) >= first["_n"]]
        if sets:
            row = df.agg(*[F.count_distinct(F.struct(*s)).alias(f"k{i}") for i, s in enumerate(sets)]).first()
            found += [s for i, s in enumerate(sets) if row[f"k{i}"] == first["_n"]]
    return df.sparkSession.createDataFrame([(",".join(f), len(f)) for f in found], "key string, width int")


def _product(values) -> int:
    out = 1
    for v in values:
        out *= v
    return out


PRIME = 2**61 - 1


def portable_hash(c: Column) -> Column:
    """A hash that other engines can compute, too: 60 bits of the MD5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")


def minhash(df: DataFrame, column: str, lanes: int = 64) -> DataFrame:
    """(lane, value): the minimum of (a h + b) mod p over the column's distinct values, a and b by the lane's number."""
    h = df.select(portable_hash(F.col(column)).alias("h")).where("h is not null").distinct()
    a = lambda i: 2 * i * 40_503 + 1
    b = lambda i: i * 2_654_435_761 + 12_345
    big = "decimal(38,0)"
    mins = [F.min(F.pmod(F.col("h").cast(big) * F.lit(a(i)).cast("decimal(12,0)") + F.lit(b(i)).cast("decimal(18,0)"), F.lit(PRIME).cast("decimal(20,0)")).cast("long")).alias(str(i)) for i in range(lanes)]
    return h.agg(*mins).select(F.explode(F.array(*[F.struct(F.lit(i).alias("lane"), F.col(str(i)).alias("value")) for i in range(lanes)])).alias("x")).select("x.*")


def unit_suffixes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, suffix, n, share, mixed): units written after numbers; mixed where two have at least 5 % and 2 values."""
    rows = unpivot(df, columns).withColumn("suffix", F.lower(F.regexp_extract(F.trim("value"), r"^[-+]?[\d.,]+\s*([A-Za-z%°]+)$", 1))).where("suffix <> ''")
    counts = rows.groupBy("column", "suffix").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("column"))
    counts = counts.withColumn("share", share)
    strong = F.sum(((F.col("share") >= 0.05) & (F.col("n") >= 2)).cast("int")).over(Window.partitionBy("column"))
    return counts.withColumn("mixed", strong >= 2)
