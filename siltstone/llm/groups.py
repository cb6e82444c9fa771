"""Consolidating pairwise matches into groups.

Minimum labels are propagated along edges and chains of labels are shortened by pointer jumping. After each round
the edges are relabelled: an edge whose ends got the same label is done and dropped, the others are joined with the
labels of their ends, so edges shrink from round to round until no label changes. Each round is written to the shared
folder.

Every step is a hash aggregation or a join to a side that is unique on its key; hot nodes (hubs) are joined apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.skew import MOST_HOT, join_unique
from siltstone.session import cut, cut_counting, discard

#: Up to so many edges, taking the nearest nodes twice is cheaper than writing them.
FEW = 1_000_000


def latest_matches(pairs: DataFrame, left: str, right: str, verdict: str, decided_at: str) -> DataFrame:
    """Edges (a, b), a < b, whose latest decision, in either order, is a match.

    Null ends and self pairs tie nothing. A null verdict is a decision that ties nothing. Of decisions of the
    same time a match counts last. Repeated rows change nothing.
    """
    a, b = F.least(left, right), F.greatest(left, right)
    is_match = F.coalesce(F.lower(F.trim(F.col(verdict))) == "match", F.lit(False))
    rows = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    last = rows.select(a.alias("a"), b.alias("b"), F.struct(F.col(decided_at).alias("at"), is_match.alias("match")).alias("decision")).groupBy("a", "b").agg(F.max("decision").alias("last"))
    return last.where("last.match").select("a", "b")


def _hot(rows: DataFrame, key: str, total: int) -> list:
    """Values of key that a fair part of all rows share; none as long as all rows together are few."""
    limit = max(50_000, total // MOST_HOT)
    if total <= limit:
        return []
    crowd = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[key] for r in crowd.where(F.col("n") > limit).collect()]


def _compose(first: DataFrame, second: DataFrame, hot: list) -> DataFrame:
    """first (node, label) with each label replaced by its label in second, where it has one."""
    asked = first.select(F.col("node").alias("child"), F.col("label").alias("node"))
    found = join_unique(asked, second.select("node", "label"), "node", hot, "left")
    return found.select(F.col("child").alias("node"), F.coalesce("label", "node").alias("label"), (F.coalesce("label", "node") != F.col("node")).alias("moved"))


def _jump(parents: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """parents (node, label), label <= node: every label replaced by the root of its chain; the number of nodes.
    rows is how many there are at most."""
    while True:
        # a label that many nodes have (a hub's) is joined apart
        hot = _hot(parents, "label", rows)
        stepped, seen = cut_counting(_compose(parents, parents, hot), moved=F.col("moved"), rows=F.lit(1))
        discard(parents)
        parents, rows = stepped, seen["rows"]
        if not seen["moved"]:
            return parents, rows


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node linked to it directly or indirectly.

    Nodes are of any orderable type. Null ends and self loops are dropped, repeated edges change nothing, no edges
    give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, seen = cut_counting(edges, rows=F.lit(1))
    none, rounds = edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("label")), []
    while seen["rows"]:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        nearest = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
        if seen["rows"] > FEW:
            nearest = cut(nearest)
        roots, nodes = _jump(nearest, 2 * seen["rows"])
        rounds.append((roots, nodes))
        hubs = _hot(ends, "node", 2 * seen["rows"])
        first = join_unique(edges.select(F.col("a").alias("node"), "b"), roots, "node", hubs).select(F.col("label").alias("a"), F.col("b").alias("node"))
        both = join_unique(first, roots, "node", hubs).select(F.least("a", "label").alias("a"), F.greatest("a", "label").alias("b"))
        done = edges
        edges, seen = cut_counting(both.where("a <> b").distinct(), rows=F.lit(1))
        discard(done)
    if not rounds:
        return none
    labels, nodes = rounds[0]
    for roots, _ in rounds[1:]:
        labels = _compose(labels, roots, _hot(labels, "label", nodes)).drop("moved")
    return labels


def group_records(records: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(group_id, key) for every distinct non-null key of records; a key without a link is its own group."""
    ids = records.select(F.col(key).alias("node")).where("node is not null").distinct()
    found = ids.join(connected(edges), "node", "left")
    return found.select(F.coalesce("label", "node").alias("group_id"), F.col("node").alias(key))
