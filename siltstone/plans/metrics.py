"""The metric layer: what can be measured in an ontology, and one measure broken down by one dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.algebra import Aggregate, Ontology, Select, World, compile_term, extent


def metrics(ontology: Ontology) -> list[tuple[str, str, str | None]]:
    """(class, aggregate, measure): a count per class, sum and average per numeric property that isn't a key."""
    out: list[tuple[str, str, str | None]] = []
    for name in sorted(ontology.classes):
        c = ontology.classes[name]
        out.append((name, "count", None))
        keys = {c.key, *(link.column for link in ontology.links.values() if link.source == name)}
        for p, kind in sorted(ontology.properties(name).items()):
            if kind in ("integer", "float") and p not in keys:
                out += [(name, "sum", p), (name, "avg", p)]
    return out


def dimensions(ontology: Ontology, cls: str) -> dict[str, list[str]]:
    """categorical, temporal and link dimensions of a class."""
    kinds = ontology.properties(cls)
    return {
        "categorical": sorted(p for p, k in kinds.items() if k in ("string", "boolean")),
        "temporal": sorted(p for p, k in kinds.items() if k in ("date", "datetime")),
        "link": sorted(f"{n}.{p}" for n, link in ontology.links.items() if link.source == cls for p, k in ontology.properties(link.target).items() if k == "string"),
    }


def breakdown(world: World, cls: str, agg: str, measure: str | None, by: str) -> DataFrame:
    """A measure by a dimension; a temporal one by month."""
    if world.ontology.properties(cls).get(by) in ("date", "datetime"):
        rows = extent(world, cls).withColumn("_month", F.date_format(by, "yyyy-MM"))
        value = F.count(F.lit(1)) if measure is None else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](F.col(measure).cast("double"))
        return rows.groupBy(F.col("_month").alias(by)).agg(value.alias(f"{agg}_{measure or 'rows'}"))
    return compile_term(Aggregate(Select(cls), agg, measure, (by,)), world)
