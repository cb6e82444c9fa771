"""Attributes as known at event time.

Each event gets the attribute version of its entity that was valid and already known at the event's time.
Versions become available at a time, end at a time, and have a priority; of the versions available and not ended
at an event, the one of highest priority counts, even if a later but lower one came after it.

Two steps. `timeline` turns the versions of each entity into disjoint segments (entity, start, end, version): one
pass over versions sorted by entity and availability, carrying the versions that can still win. `carry_forward`
unions events and segments, sorts by entity and time (a change before an event of the same time) and carries the
last segment forward in a window, inside the JVM.

A hot entity is cut into slices of time, in both steps; what a slice needs from earlier ones is pre-aggregated
(versions: the best per end; segments: they are disjoint, so at most one reaches into a slice from before).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.skew import hot_keys
from siltstone.session import cut

OPEN_END = 2**62
SLICES = 32


def _slices(df: DataFrame, hot: list[tuple], time: str) -> dict[str, list[int]]:
    """Time bounds that cut each hot entity into about equal slices: at most MOST_HOT rows of SLICES numbers."""
    if not hot:
        return {}
    steps = [i / SLICES for i in range(1, SLICES)]
    rows = df.where(F.col("entity").isin([h[0] for h in hot])).groupBy("entity").agg(F.percentile_approx(time, steps, 1000).alias("bounds")).collect()
    return {r["entity"]: sorted(set(r["bounds"])) for r in rows}


def _slice_of(time: Column, bounds: dict[str, list[int]]) -> Column:
    """Number of bounds of the entity that lie at or before time; 0 for entities that are not hot."""
    if not bounds:
        return F.lit(0)
    known = F.create_map(*[x for k, v in bounds.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
    return F.coalesce(F.size(F.filter(F.try_element_at(known, F.col("entity")), lambda b: b <= time)), F.lit(0))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of versions that come sorted by entity, slice and availability.

    stair holds the versions that can still win, by falling priority; their ends then rise, as a version that ends
    no later than one of higher priority can never win again. Distinct ends bound its length.
    """
    stair: list[tuple[tuple, int, str]] = []
    out: list[tuple[str, int, int, int, str]] = []
    group: tuple = ("", -1)
    since = 0

    def leave(until: int) -> None:
        nonlocal since
        while stair and stair[0][1] <= until:
            _, end, version = stair.pop(0)
            if end > since:
                out.append((*group, since, end, version))
                since = end

    for batch in batches:
        for entity, part, start, end, major, minor, version in zip(batch.entity, batch.part, batch.start, batch.end, batch.major, batch.minor, batch.version, strict=True):
            if (entity, part) != group:
                leave(OPEN_END)
                stair.clear()
                group, since = (entity, part), start
            leave(start)
            if end <= start:
                continue
            rank = (major, minor, version)
            at = 0
            while at < len(stair) and stair[at][0] >= rank:
                at += 1
            if at and stair[at - 1][1] >= end:
                continue
            beaten = at
            while beaten < len(stair) and stair[beaten][1] <= end:
                beaten += 1
            if at == 0:
                if stair and start > since:
                    out.append((*group, since, start, stair[0][2]))
                since = start
            stair[at:beaten] = [(rank, end, version)]
        if out:
            yield pd.DataFrame(out, columns=["entity", "part", "start", "end", "version"])
            out.clear()
    leave(OPEN_END)
    if out:
        yield pd.DataFrame(out, columns=["entity", "part", "start", "end", "version"])


def timeline(versions: DataFrame, hot_floor: int = 50_000) -> DataFrame:
    """Disjoint segments (entity, start, end, version) in which a version is the one that counts.

    versions: entity string, version string, start and end in microseconds (end exclusive, OPEN_END if open),
    major and minor long: the priority is (major, minor, version), the highest wins. Rows with a null entity,
    version or start, or with end <= start, count as never valid. Repeated rows change nothing. An empty table
    gives no segments.
    """
    rows = versions.select("entity", F.col("version").cast("string").alias("version"), "start", F.coalesce("end", F.lit(OPEN_END)).alias("end"), F.coalesce("major", F.lit(-(2**62))).alias("major"), F.coalesce("minor", F.lit(-(2**62))).alias("minor"))
    # read for the hot entities, their slices and the sweep: written once
    rows = cut(rows.where("entity is not null and version is not null and start is not null and end > start").distinct())
    hot, _ = hot_keys(rows, ["entity"], hot_floor)
    bounds = _slices(rows, hot, "start")
    rows = rows.withColumn("part", _slice_of(F.col("start"), bounds))
    if bounds:
        starts = F.create_map(*[x for k, v in bounds.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
        best = F.max_by(F.struct("version", "start", "major", "minor"), F.struct("major", "minor", "version")).alias("best")
        early = rows.where(F.col("entity").isin(list(bounds))).groupBy("entity", "part", "end").agg(best)
        early = early.withColumn("bounds", F.element_at(starts, F.col("entity"))).where(F.col("part") < F.size("bounds"))
        early = early.withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.size("bounds"))))
        early = early.groupBy("entity", "part", "end", "bounds").agg(F.max_by("best", F.struct("best.major", "best.minor", "best.version")).alias("best"))
        early = early.select("entity", "best.version", F.element_at("bounds", F.col("part")).alias("start"), "end", "best.major", "best.minor", "part").where("end > start")
        rows = rows.unionByName(early)
    schema = "entity string, part int, start long, end long, version string"
    ordered = rows.repartition("entity", "part").sortWithinPartitions("entity", "part", "start", "major", "minor", "version")
    segments = ordered.select("entity", "part", "start", "end", "major", "minor", "version").mapInPandas(_sweep, schema)
    if bounds:
        # a slice's last segments reach beyond it; later slices have them as carried in
        cap = F.coalesce(F.try_element_at(F.try_element_at(starts, F.col("entity")), F.col("part") + 1), F.lit(OPEN_END))
        segments = segments.withColumn("end", F.least("end", cap)).where("end > start")
    return segments.drop("part")


def carry_forward(events: DataFrame, segments: DataFrame, hot_floor: int = 200_000) -> DataFrame:
    """events with the column version: that of the segment which holds the event's time, or null.

    events: entity string, at in microseconds, any other columns (none named start, end, version, part or kind).
    Events with a null entity or time keep a null version. Nothing is dropped.
    """
    hot, _ = hot_keys(events.where("entity is not null"), ["entity"], hot_floor)
    bounds = _slices(events, hot, "at")
    carried = events.withColumn("part", _slice_of(F.col("at"), bounds)).withColumn("kind", F.lit(1)).withColumn("segment", F.lit(None).cast("struct<end:long,version:string>"))
    changes = segments.withColumn("part", _slice_of(F.col("start"), bounds))
    if bounds:
        changes = changes.withColumn("part", F.explode(F.sequence(F.col("part"), _slice_of(F.col("end") - 1, bounds))))
    changes = changes.select("entity", "part", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("end", "version").alias("segment"))
    both = carried.unionByName(changes, allowMissingColumns=True)
    # events without a key must not meet in one task: they carry nothing
    spread = F.when(F.col("entity").isNull(), F.pmod(F.hash(*[c for c in carried.columns if c != "segment"]), F.lit(1024))).otherwise(F.col("part"))
    order = Window.partitionBy("entity", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("part", spread).withColumn("segment", F.last("segment", ignorenulls=True).over(order)).where("kind = 1")
    return last.withColumn("version", F.when(F.col("entity").isNotNull() & (F.col("at") < F.col("segment.end")), F.col("segment.version"))).drop("part", "kind", "segment")
