"""References to records that do not exist.

Parents and references stand in one order, by key and time, and are cut into ranges of about the same number of rows by
bounds from a random sample of both. A key that holds many rows thus spans several ranges by itself, and rows of one key
and time too many for a range are dealt out over as many ranges as the sample shows bounds at it. Each range holds its
parents as sorted arrays and probes its references in vectorised batches by binary search; what earlier ranges know of
the key with which a range begins is one number, carried into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOREVER = 2**62
#: Rows of a range, and rows of the sample for each range.
ROWS_PER_RANGE, SAMPLED_PER_RANGE = 250_000, 50


class Ranges:
    """Bounds (key, at), ascending: range i holds what is above bound i - 1 and not above bound i."""

    def __init__(self, bounds: list[tuple[str, int]]):
        self.bounds = bounds
        self.keys = np.array([k for k, _ in bounds], dtype=object)
        self.times = np.array([t for _, t in bounds], dtype=np.int64)

    def place(self, key: pd.Series, at: pd.Series, draw: pd.Series) -> pd.DataFrame:
        """The range (cell) of each row, and whether a bound stands at its key (edge). Rows that equal several bounds
        are dealt out by draw, which is 0 to 1."""
        if not len(self.keys):
            return pd.DataFrame({"cell": np.zeros(len(key), dtype=np.int32), "edge": np.zeros(len(key), dtype=bool)})
        codes, distinct = pd.factorize(key)
        distinct = np.asarray(distinct, dtype=object)
        low, high = np.searchsorted(self.keys, distinct, "left"), np.searchsorted(self.keys, distinct, "right")
        out = low[codes].astype(np.int64)
        time, share = at.to_numpy(dtype=np.int64), draw.to_numpy(dtype=np.float64)
        for c in np.flatnonzero(high > low):  # keys at which a bound stands
            rows = np.flatnonzero(codes == c)
            times = self.times[low[c] : high[c]]
            first, last = np.searchsorted(times, time[rows], "left"), np.searchsorted(times, time[rows], "right")
            out[rows] += first + (share[rows] * np.maximum(last - first, 1)).astype(np.int64)
        return pd.DataFrame({"cell": out.astype(np.int32), "edge": (high > low)[codes]})


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A range's rows, parents (kind 0) first: its references with nothing behind them."""
    held, arrays = [], None

    def build() -> tuple:
        p = pd.concat(held) if held else pd.DataFrame({"key": [], "at": [], "end": []})
        keys, codes = np.unique(p["key"].to_numpy(dtype=object), return_inverse=True)
        times, ranks = np.unique(p["at"].to_numpy(dtype=np.int64), return_inverse=True)
        place = codes.astype(np.int64) * (len(times) + 1) + ranks
        order = np.argsort(place, kind="stable")
        # how long anything that began before or at a place was there
        reach = p["end"].iloc[order].astype("int64").groupby(codes[order]).cummax().to_numpy()
        return keys, times, place[order], reach

    for batch in batches:
        parents, refs = batch[batch["kind"] == 0], batch[batch["kind"] == 1]
        if len(parents):
            held.append(parents[["key", "at", "end"]])
        if not len(refs):
            continue
        if arrays is None:
            arrays, held = build(), []
        keys, times, place, reach = arrays
        if len(keys):
            at = refs["at"].to_numpy(dtype=np.int64)
            codes, distinct = pd.factorize(refs["key"])  # a batch has few keys; each is searched once
            distinct = np.asarray(distinct, dtype=object)
            found = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            known, code = (keys[found] == distinct)[codes], found[codes]
            rank = np.searchsorted(times, at, side="right")  # times at or before the reference
            last = np.searchsorted(place, code * (len(times) + 1) + rank) - 1
            at_last = np.maximum(last, 0)
            refs = refs[~(known & (last >= 0) & (place[at_last] // (len(times) + 1) == code) & (reach[at_last] > at))]
        if len(refs):
            yield refs[["key", "at", "row_key"]]


def _ranges(spark: SparkSession, parents: DataFrame, references: DataFrame, rows_per_range: int) -> Ranges:
    """Bounds by rank of a sample; SAMPLED_PER_RANGE short rows for each range come to the driver."""
    total = references.count() + parents.count()
    ranges = -(-total // rows_per_range)
    if ranges <= 1:
        return Ranges([])
    share = min(1.0, SAMPLED_PER_RANGE * ranges / total)
    sample = references.select("key", "at").unionByName(parents.select("key", F.col("start").alias("at"))).sample(share, seed=11)
    rows = sorted(tuple(r) for r in sample.collect())
    return Ranges([rows[i * len(rows) // ranges] for i in range(1, ranges)] if len(rows) >= ranges else rows)


def orphans(references: DataFrame, parents: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """References (row_key, key, at) for whose key no parent existed at that time.

    references: key string, at long (microseconds), row_key string. parents: key string, start long, end long
    (exclusive, null: still there). A null key refers to nothing and is no case; a null time is checked as the
    latest one. Parents with a null key or start never existed. Repeated rows give repeated results.
    No parents at all: every reference is an orphan.
    """
    spark = references.sparkSession
    known = parents.where("key is not null and start is not null").select("key", "start", F.coalesce("end", F.lit(FOREVER)).alias("end")).where("end > start")
    known = known.groupBy("key", "start").agg(F.max("end").alias("end"))
    refs = references.where("key is not null").select("key", F.coalesce("at", F.lit(FOREVER - 1)).alias("at"), F.col("row_key").cast("string").alias("row_key"))
    ranges = _ranges(spark, known, refs, rows_per_range)
    @F.pandas_udf("cell int, edge boolean")
    def place(key: pd.Series, at: pd.Series, draw: pd.Series) -> pd.DataFrame:
        return ranges.place(key, at, draw)  # the bounds travel with the function

    place = place.asNondeterministic()  # not to be evaluated twice
    held = known.select("key", F.col("start").alias("at"), "end", place("key", "start", F.lit(0.0)).alias("p")).select("key", "at", "end", "p.*")
    asked = refs.select("key", "at", "row_key", place("key", "at", F.rand(13)).alias("p")).select("key", "at", "row_key", "p.cell")
    nothing = F.lit(None)
    both = held.select("cell", F.lit(0).alias("kind"), "key", "at", "end", nothing.cast("string").alias("row_key")).unionByName(asked.select("cell", F.lit(1).alias("kind"), "key", "at", nothing.cast("long").alias("end"), "row_key"))
    carried = _carried(held, ranges)
    if carried:
        both = both.unionByName(spark.createDataFrame(carried, "cell int, key string, end long").select("cell", F.lit(0).alias("kind"), "key", F.lit(-FOREVER).alias("at"), "end", nothing.cast("string").alias("row_key")))
    ordered = both.repartitionById(len(ranges.bounds) + 1, "cell").sortWithinPartitions("kind")
    return ordered.select("kind", "key", "at", "end", "row_key").mapInPandas(_probe, "key string, at long, row_key string")


def _carried(held: DataFrame, ranges: Ranges) -> list[tuple[int, str, int]]:
    """(range, key, end): how long the key at the bound below a range was there, by its parents in earlier ranges."""
    if not ranges.bounds:
        return []
    # a row for each range and key with a bound: at most two a bound
    reach = {(r["cell"], r["key"]): r["end"] for r in held.where("edge").groupBy("cell", "key").agg(F.max("end").alias("end")).collect()}
    out, ends = [], {}
    for i, (key, _) in enumerate(ranges.bounds):
        if (i, key) in reach:
            ends[key] = max(ends.get(key, -FOREVER), reach[i, key])
        if key in ends:
            out.append((i + 1, key, ends[key]))
    return out


def orphan_report(found: DataFrame, by: list[str]) -> DataFrame:
    """Orphans per group and month of the reference's time: rows and distinct missing keys."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    return found.groupBy(*by, month).agg(F.count(F.lit(1)).alias("orphan_rows"), F.count_distinct("key").alias("missing_keys"))
