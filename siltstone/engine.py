"""One object for the usual course: read tables, profile them, find how they hang together, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import cleaning, dependencies, profile, quality
from siltstone.plans import algebra, grounding, metrics
from siltstone.sources import bundle, snapshots


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def ingest(self, folder: str) -> list[str]:
        """Tables of all CSV and Parquet files of a folder."""
        self.tables |= snapshots.discover_sources(self.spark, folder)
        return sorted(self.tables)

    def profile(self, name: str) -> DataFrame:
        return profile.profile_columns(self.tables[name])

    def proposals(self, name: str) -> DataFrame:
        return cleaning.proposals(self.tables[name], self.tables[name].columns)

    def fds(self, name: str, max_lhs: int = 3) -> DataFrame:
        return dependencies.functional_dependencies(self.tables[name], max_lhs=max_lhs)

    def inds(self, min_coverage: float = 0.95) -> DataFrame:
        return dependencies.inclusion_dependencies({t: (df, df.columns) for t, df in self.tables.items()}, min_coverage)

    def relationships(self, min_coverage: float = 0.95) -> DataFrame:
        """Inclusions with the metrics and verdict of the executed join: one row per candidate, few."""
        out = None
        for r in self.inds(min_coverage).collect():
            (lt, lc), (rt, rc) = r["lhs"].split(".", 1), r["rhs"].split(".", 1)
            m = dependencies.verdict(dependencies.validate_join(self.tables[lt], lc, self.tables[rt], rc))
            row = m.selectExpr(f"'{r['lhs']}' as lhs", f"'{r['rhs']}' as rhs", "*")
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], "lhs string, rhs string")

    def check(self, name: str, expectations: list[quality.Expectation]) -> DataFrame:
        return quality.evaluate(self.tables[name], expectations)

    def query(self, term, ontology: algebra.Ontology) -> DataFrame:
        return algebra.compile_term(term, algebra.World(ontology, self.tables))

    def ask(self, question: str, ontology: algebra.Ontology) -> tuple[str, DataFrame | None]:
        """('answer', rows), or 'clarify' or 'abstain' without rows."""
        world = algebra.World(ontology, self.tables)
        verdict, best = grounding.decide(grounding.candidates(question, ontology, grounding.value_index(world)))
        return (verdict, algebra.compile_term(best.term, world) if verdict == "answer" and best else None)

    def metrics(self, ontology: algebra.Ontology) -> list[tuple[str, str, str | None]]:
        return metrics.metrics(ontology)

    def export(self, folder: str) -> None:
        bundle.write_bundle(self.tables, folder)
