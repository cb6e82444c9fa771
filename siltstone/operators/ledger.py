"""The ledger: what was made, decided and spent, only ever appended to; the trail from a cell back to its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.numbering import numbered

TABLES = {
    "artifact": ["artifact_id", "kind", "payload", "prov_ref", "created_at"],
    "decision": ["decision_id", "outcome", "confidence", "tier", "cost_tokens", "deferred_to_human", "quarantined", "rationale", "created_at"],
    "cost": ["task", "tokens", "created_at"],
}


def append(table: str, held: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """What is to be appended to a table of the ledger: fresh, numbered by time and content after the last of held. Rows with
    a missing field are refused, and all of their batch with them."""
    columns = TABLES[table]
    if not fresh.where(" or ".join(f"`{c}` is null" for c in columns)).isEmpty():
        raise ValueError(f"refused: a row for {table} lacks a field")
    last = 0 if held is None else held.agg(F.max("seq")).first()[0] or 0
    return numbered(fresh.select(*columns), ["created_at", *[c for c in columns if c != "created_at"]], last + 1, "seq")


def newest(table: DataFrame, k: int) -> DataFrame:
    """The audit view: the k newest rows."""
    return table.orderBy(F.desc("seq")).limit(k)


def cost_rollup(costs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(task, tier, n, tokens): what was spent by task; decisions count under the task 'decision', by tier."""
    out = costs.groupBy("task", F.lit(None).cast("int").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    if decisions is not None:
        out = out.unionByName(decisions.groupBy(F.lit("decision").alias("task"), F.col("tier").cast("int").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost_tokens").alias("tokens")))
    return out


def cell_lineage(cells: DataFrame, leaves: DataFrame, atoms: DataFrame) -> DataFrame:
    """(entity_uri, prop, seq, atom_id, source, table, row, column): the atoms behind each cell and where they were read.

    leaves: (prov_ref, atom_id). atoms: (atom_id, uri), uri being source/table/row/column. An atom that isn't registered
    keeps null places; a cell whose provenance has no atoms has no row."""
    part = lambda i: F.get(F.split("uri", "/"), i)
    found = cells.select("entity_uri", "prop", "seq", "prov_ref").join(leaves.distinct(), "prov_ref").join(atoms.dropDuplicates(["atom_id"]), "atom_id", "left")
    return found.select("entity_uri", "prop", "seq", "atom_id", part(0).alias("source"), part(1).alias("table"), part(2).alias("row"), part(3).alias("column"))
