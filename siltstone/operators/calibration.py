"""Calibration of decisions: expected calibration error, split-conformal thresholds, tiers, weighted votes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calibration_error(df: DataFrame, probability: str, outcome: str, bins: int = 15) -> DataFrame:
    """One row: expected calibration error over equal bins of the probability, and the rows it is taken over."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    each = df.where(F.col(probability).isNotNull() & F.col(outcome).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg(F.col(outcome).cast("double")).alias("hit"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("hit"))) / F.sum("n")).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def conformal_threshold(df: DataFrame, score: str, alpha: float = 0.1) -> float | None:
    """The quantile of the held-out scores that covers 1 - alpha of new ones; None if there are too few rows."""
    n = df.where(F.col(score).isNotNull()).count()
    rank = math.ceil((n + 1) * (1 - alpha))
    if n == 0 or rank > n:
        return None
    return df.select(F.percentile(score, rank / n)).first()[0] if rank == n else df.select(F.percentile_approx(score, rank / n, 1_000_000)).first()[0]


def banded(df: DataFrame, probability: str, accept: float = 0.95, reject: float = 0.05) -> DataFrame:
    """df with decision: yes, no, or review between the thresholds; a null probability is 'no'."""
    p = F.col(probability)
    return df.withColumn("decision", F.when(p >= accept, "yes").when(p.isNull() | (p <= reject), "no").otherwise("review"))


def vote(verdicts: dict[str, tuple[str, float]], weights: dict[str, float], consensus: float = 0.6) -> tuple[str, float]:
    """(verdict, share): the weighted plurality of experts' (verdict, confidence); 'UNKNOWN' below the consensus."""
    mass: dict[str, float] = {}
    for expert, (verdict, confidence) in verdicts.items():
        mass[verdict] = mass.get(verdict, 0.0) + weights.get(expert, 1.0) * confidence
    total = sum(mass.values())
    if not total:
        return ("UNKNOWN", 0.0)
    best = max(sorted(mass), key=lambda v: mass[v])
    share = mass[best] / total
    return (best, share) if share >= consensus else ("UNKNOWN", share)


def reweigh(weights: dict[str, float], verdicts: dict[str, tuple[str, float]], truth: str, rate: float = 0.5) -> dict[str, float]:
    """Multiplicative update: experts that were wrong lose weight; weights sum to their number again."""
    new = {e: weights.get(e, 1.0) * (1.0 if v == truth else math.exp(-rate * c)) for e, (v, c) in verdicts.items()}
    total = sum(new.values())
    return {e: w * len(new) / total for e, w in new.items()}
