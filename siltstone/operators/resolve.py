"""Entity resolution inside one source: blocking, agreement levels, Fellegi-Sunter weights, evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.operators.profile import portable_hash
from siltstone.functions.skew import pairs_within
from siltstone.session import cut


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, halved transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro raised by a common prefix of up to four characters, whatever the Jaro value."""
    j, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + prefix * weight * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def block_pairs(df: DataFrame, key: str, block: Column) -> DataFrame:
    """(a, b), a < b: records that share a block value; null blocks pair nothing."""
    return pairs_within(df.select(F.col(key).alias("a"), block.alias("_block")), "_block", "a").distinct()


def sorted_neighborhood(df: DataFrame, key: str, order: Column, window: int = 4, parts: int = 64) -> DataFrame:
    """(a, b), a < b: records within window - 1 places of each other in sort order. The order is cut into ranges;
    each range also gets the last places of the one before, so no task sees the whole order."""
    rows = df.select(F.col(key).alias("k"), order.alias("s")).where("s is not null")
    ranged = rows.repartitionByRange(parts, "s", "k").sortWithinPartitions("s", "k").withColumn("p", F.spark_partition_id())
    ranged = cut(ranged)
    place = ranged.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("s", "k")))
    sizes = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, upto = {}, 0
    for p in sorted(sizes):
        before[p], upto = upto, upto + sizes[p]
    if not before:
        return rows.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0)
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    ranked = place.select("k", (F.col("i") + F.element_at(offset, F.col("p"))).alias("rank"))
    near = ranked.select(F.col("k").alias("x"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + window - 1)).alias("rank"))
    met = near.join(ranked, "rank")
    return met.select(F.least("x", "k").alias("a"), F.greatest("x", "k").alias("b")).distinct()


def lsh_pairs(df: DataFrame, key: str, text: str, bands: int = 10, rows: int = 6, gram: int = 3) -> DataFrame:
    """(a, b), a < b: records whose MinHash signatures of character grams agree in all rows of a band."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - gram + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(gram))))
    h = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.explode(grams).alias("g")).withColumn("h", portable_hash(F.col("g")) % F.lit(2**31 - 1))
    lanes = [F.min(F.pmod(F.col("h") * F.lit(2 * i * 40_503 + 1) + F.lit(i * 2_654_435 + 12_345), F.lit(2**31 - 1))).alias(f"l{i}") for i in range(bands * rows)]
    sig = h.groupBy("k").agg(*lanes)
    keys = F.explode(F.array(*[F.concat_ws("-", F.lit(b), *[F.col(f"l{b * rows + r}") for r in range(rows)]) for b in range(bands)]))
    banded = sig.select(F.col("k").alias("a"), keys.alias("band"))
    return pairs_within(banded, "band", "a").distinct()


def agreement_level(a: Column, b: Column, similarity: Column, agree: float, partial: float) -> Column:
    """-1 missing, 0 different, 1 partly the same, 2 the same."""
    missing = a.isNull() | b.isNull() | (F.trim(a) == "") | (F.trim(b) == "")
    return F.when(missing, -1).when(similarity >= agree, 2).when(similarity >= partial, 1).otherwise(0)


def fellegi_sunter(patterns: Sequence[tuple[tuple[int, ...], int]], iterations: int = 300, tolerance: float = 1e-8) -> dict:
    """m and u probabilities by EM over counted agreement patterns: few rows, whatever the number of pairs. Missing
    fields tell nothing. Of the two classes, the one with more agreement is the match."""
    fields = len(patterns[0][0])
    m = [[0.1, 0.2, 0.7] for _ in range(fields)]
    u = [[0.7, 0.2, 0.1] for _ in range(fields)]
    prior, total = 0.1, sum(n for _, n in patterns)
    for _ in range(iterations):
        post = []
        for levels, _n in patterns:
            x, y = math.log(prior), math.log(1 - prior)
            for f, v in enumerate(levels):
                if v >= 0:
                    x += math.log(m[f][v])
                    y += math.log(u[f][v])
            post.append(1 / (1 + math.exp(min(700, y - x))))
        fresh = sum(p * n for p, (_, n) in zip(post, patterns, strict=True)) / total
        for f in range(fields):
            sm, su = [0.5] * 3, [0.5] * 3
            for p, (levels, n) in zip(post, patterns, strict=True):
                if levels[f] >= 0:
                    sm[levels[f]] += p * n
                    su[levels[f]] += (1 - p) * n
            m[f], u[f] = [v / sum(sm) for v in sm], [v / sum(su) for v in su]
        fresh = min(max(fresh, 1e-6), 1 - 1e-6)
        done, prior = abs(fresh - prior) < tolerance, fresh
        if done:
            break
    if sum(x[2] for x in u) > sum(x[2] for x in m):
        m, u, prior = u, m, 1 - prior
    return {"m": m, "u": u, "prior": prior}


def posterior(levels: list[str], model: dict) -> Column:
    """Match probability of a pair from the columns that hold its levels."""
    weight = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for f, name in enumerate(levels):
        w = F.lit(0.0)
        for v in range(3):
            w = F.when(F.col(name) == v, math.log(model["m"][f][v] / model["u"][f][v])).otherwise(w)
        weight = weight + w
    return 1 / (1 + F.exp(-weight))


def pairwise_quality(assigned: DataFrame, truth: DataFrame, key: str, cluster: str) -> DataFrame:
    """(true_positive, assigned_pairs, true_pairs, precision, recall, f1) from cluster sizes: no pairs are made."""
    both = assigned.select(key, F.col(cluster).alias("a")).join(truth.select(key, F.col(cluster).alias("t")), key)
    pairs = lambda n: n * (n - 1) / 2

    def count(*by: str) -> DataFrame:
        return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("p"))

    tp, ap, tr = count("a", "t"), count("a"), count("t")
    row = tp.select(F.col("p").alias("true_positive")).join(F.broadcast(ap.select(F.col("p").alias("assigned_pairs")))).join(F.broadcast(tr.select(F.col("p").alias("true_pairs"))))
    row = row.withColumn("precision", F.coalesce(F.try_divide("true_positive", "assigned_pairs"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("true_positive", "true_pairs"), F.lit(0.0)))
    return row.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
