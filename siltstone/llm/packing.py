"""Filling containers of fixed capacity with texts.

Sum-of-squares packing: each text goes where the sum over all residual gaps of the squared number of open
containers with that gap becomes smallest. Texts are spread over shards by a hash of their key; each shard packs on
its own and is bounded by shard_items, so more texts mean more shards, not larger ones. A text beyond the capacity is cut
into full containers and a rest; no other text is cut. As an option, when a shard's texts are placed, its emptier
containers are opened again, whose texts then go best-fit, largest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut

SHARD_ITEMS = 40_000


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The container (0, 1, ...) of each size, 1 <= size <= capacity, placed in the order given."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    where, n = [], 0
    for s in sizes:
        # change of the sum if placed in a container of gap g, and if in a new one (a full container has no gap)
        gaps = np.flatnonzero(count[s:]) + s
        rest = capacity - s
        fresh = 2 * count[rest] + 1 if rest else 0
        best, least = -1, fresh
        if len(gaps):
            change = 1 - 2 * count[gaps] + np.where(gaps > s, 2 * count[gaps - s] + 1, 0)
            at = int(np.argmin(change))
            if change[at] <= fresh:
                best, least = int(gaps[at]), int(change[at])
        if best < 0:
            container, left = n, rest
            n += 1
        else:
            container, left = open_at[best].pop(), best - s
            count[best] -= 1
        where.append(container)
        if left:
            open_at[left].append(container)
            count[left] += 1
    return where


def best_fit(sizes: list[int], gaps: list[tuple[int, int]], capacity: int, fresh: int) -> list[int]:
    """The container of each size, largest first, into (gap, container) or new ones numbered from fresh."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    for gap, container in gaps:
        by_gap[gap].append(container)
        count[gap] += 1
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fits = int(np.argmax(count[s:] > 0)) + s
        if count[fits] and fits >= s:
            container = by_gap[fits].pop()
            count[fits] -= 1
            left = fits - s
        else:
            container, left = fresh, capacity - s
            fresh += 1
        where[i] = container
        by_gap[left].append(container)
        count[left] += 1
    return where


def pack_shard(sizes: list[int], capacity: int, full_enough: float | None = None) -> list[int]:
    """Containers of a shard's sizes by sum of squares; with full_enough those filled less are packed again."""
    where = np.array(sum_of_squares(sizes, capacity), dtype=np.int64)
    size = np.array(sizes, dtype=np.int64)
    if not len(size):
        return []
    load = np.bincount(where, weights=size).astype(np.int64)
    again = load[where] < (full_enough or 0.0) * capacity
    if again.any():
        kept = np.unique(where[~again])
        gaps = [(capacity - int(load[k]), int(k)) for k in kept if load[k] < capacity]
        where[again] = best_fit([int(x) for x in size[again]], gaps, capacity, int(where.max()) + 1)
    return [int(x) for x in np.unique(where, return_inverse=True)[1]]


def pack(sizes: DataFrame, capacities: dict[int, int], key: str, shard_items: int = SHARD_ITEMS, full_enough: float | None = None) -> DataFrame:
    """(pack_id, container, doc key, piece, n_tokens) for every text of at least one token and every capacity.

    sizes: key, n_tokens. Texts without tokens need no room and stand in no container: they have a row with a null
    container and piece 0. Equal keys are packed as separate texts. Capacities below 1 are refused.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a container must hold at least one token")
    rows = cut(sizes.select(F.col(key).alias("doc"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens")))
    doc_type = rows.schema["doc"].dataType.simpleString()
    options = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity")) for p, c in sorted(capacities.items())]))
    items = rows.withColumn("o", options).select("doc", "n_tokens", "o.*")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1, F.lit(0)))
    cuts = items.select("pack_id", "capacity", "doc", F.col("n_tokens").alias("all_tokens"), F.explode(pieces).alias("piece"))
    cuts = cuts.withColumn("n_tokens", F.least(F.col("capacity"), F.col("all_tokens") - F.col("piece") * F.col("capacity")))
    full = cuts.where("n_tokens = capacity").select("pack_id", F.concat_ws("-", F.lit("full"), "doc", "piece").alias("container"), "doc", "piece", "n_tokens")
    none = cuts.where("n_tokens < 1").select("pack_id", F.lit(None).cast("string").alias("container"), "doc", "piece", "n_tokens")
    loose = cuts.where("n_tokens > 0 and n_tokens < capacity").drop("all_tokens")
    shards = max(1, -(-rows.count() // shard_items))
    loose = loose.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc", "piece", "n_tokens"], kind="stable").sample(frac=1.0, random_state=7)
        where = pack_shard([int(x) for x in group["n_tokens"]], int(group["capacity"].iloc[0]), full_enough)
        shard = int(group["shard"].iloc[0])
        return group[["pack_id", "doc", "piece", "n_tokens"]].assign(container=[f"{shard}-{c}" for c in where])[["pack_id", "container", "doc", "piece", "n_tokens"]]

    schema = f"pack_id int, container string, doc {doc_type}, piece int, n_tokens int"
    placed = loose.groupBy("pack_id", "shard").applyInPandas(place, schema)
    return placed.unionByName(full).unionByName(none).withColumnRenamed("doc", key)


def fill(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per pack_id: containers, tokens, and the share of the containers' room that is used."""
    sizes = F.create_map(*[F.lit(x) for p, c in capacities.items() for x in (p, c)])
    held = packed.where("container is not null").groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("held"))
    return held.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest")).withColumn("used_share", F.col("tokens") / (F.col("containers") * F.element_at(sizes, F.col("pack_id"))))
