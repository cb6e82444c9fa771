"""Format signatures: what the values of a column have in common, by aligning their tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value of more tokens has no format: its signature is *.
LONGEST = 200
#: Patterns of a column are first aligned in so many groups.
GROUPS = 64


def tokens(value: str) -> list[str]:
    """Runs of digits, upper, lower and mixed letters as D, A, a and L; other characters as themselves."""
    out = []
    for t in re.findall(r"[0-9]+|[^\W\d_]+|.", value, flags=re.S):
        out.append("D" if t.isdigit() else ("A" if t.isupper() else "a" if t.islower() else "L") if t.isalpha() else t)
    return out


def _kind(x: str, y: str) -> str:
    if x == y:
        return x
    letters = {"A", "a", "L"}
    if x in letters and y in letters:
        return "L"
    return "X" if {x, y} <= letters | {"D", "X"} else "*"


def align(a: list[str], b: list[str]) -> list[str]:
    """The more general of two token lists: a global alignment, where a token that only one has becomes *."""
    n, m = len(a), len(b)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                cost[i][j] = 2 * (i + j)
            else:
                k = _kind(a[i - 1], b[j - 1])
                step = 0 if a[i - 1] == b[j - 1] else 1 if k != "*" else 3
                cost[i][j] = min(cost[i - 1][j - 1] + step, cost[i - 1][j] + 2, cost[i][j - 1] + 2)
    out, i, j = [], n, m
    while i or j:
        k = _kind(a[i - 1], b[j - 1]) if i and j else "*"
        step = 0 if i and j and a[i - 1] == b[j - 1] else 1 if k != "*" else 3
        if i and j and cost[i][j] == cost[i - 1][j - 1] + step:
            out, i, j = [*out, k], i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 2:
            out, i = [*out, "*"], i - 1
        else:
            out, j = [*out, "*"], j - 1
    merged: list[str] = []
    for t in reversed(out):
        if not (t == "*" and merged and merged[-1] == "*"):
            merged.append(t)
    return merged


def aligned(patterns: list[list[str]]) -> list[str]:
    """What some token lists have in common. Nothing is more general than *, so it is not aligned further."""
    out = patterns[0]
    for p in patterns[1:]:
        if out == ["*"]:
            break
        out = align(out, p) if max(len(out), len(p)) <= LONGEST else ["*"]
    return out if len(out) <= LONGEST else ["*"]


def signature(values: list[str]) -> str:
    """The signature of some values: DAaLX and * for anything."""
    return "".join(aligned(sorted({tuple(tokens(v)) for v in values}, key=list)) if values else [])


def format_signatures(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, signature) over all values of each column; a column of nulls has ''.

    Values become lists of tokens, of which a column has few; these are aligned in GROUPS by hash, then their results."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    rows = df.select(each.alias("x")).select("x.*").where("value is not null").distinct()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            patterns = [tokens(v) for v in batch["value"]]
            yield pd.DataFrame({"column": batch["column"].to_numpy(), "tokens": [p if len(p) <= LONGEST else ["*"] for p in patterns]}).assign(tokens=lambda t: t["tokens"].map("\x1f".join))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        lists = sorted(t.split("\x1f") for t in group["tokens"])
        return pd.DataFrame({"column": [group["column"].iloc[0]], "tokens": ["\x1f".join(aligned(lists))]})

    patterns = rows.mapInPandas(cut_up, "column string, tokens string").distinct()
    parts = patterns.groupBy("column", F.pmod(F.xxhash64("tokens"), F.lit(GROUPS)).alias("g")).applyInPandas(fold, "column string, tokens string")
    whole = parts.groupBy("column").applyInPandas(fold, "column string, tokens string")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return F.broadcast(names).join(whole, "column", "left").select("column", F.coalesce(F.replace("tokens", F.lit("\x1f"), F.lit("")), F.lit("")).alias("signature"))
