"""Provenance terms in normal form: sums of products of atom ids, array<array<string>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plus(a: Column, b: Column) -> Column:
    """Alternatives: the union of both sums."""
    return F.array_distinct(F.concat(a, b))


def times(a: Column, b: Column) -> Column:
    """Joint use: every product of one with every product of the other."""
    return F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_union(x, y))))))


def cited(term: Column) -> Column:
    """All atoms that occur in a term, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(term)))


def derivable(term: Column, present: Column) -> Column:
    """Whether some product has all of its atoms among those present."""
    return F.exists(term, lambda m: F.forall(m, lambda x: F.array_contains(present, x)))


def best_confidence(term: Column, confidence: Column) -> Column:
    """Viterbi: the highest product of the atoms' confidences (a map; 1 where an atom isn't in it)."""
    value = lambda m: F.aggregate(m, F.lit(1.0), lambda acc, x: acc * F.coalesce(F.try_element_at(confidence, x), F.lit(1.0)))
    return F.array_max(F.transform(term, value))


def register_atoms(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Atoms (atom_id, ...) that aren't known yet, each once: what is to be appended."""
    return fresh.dropDuplicates(["atom_id"]).join(known.select("atom_id"), "atom_id", "left_anti")


def intern_terms(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes, terms): a term is stored as the hash of its shape (atoms numbered by first use) and its atoms."""
    atoms = F.array_distinct(F.flatten("term"))
    shape = F.to_json(F.transform("term", lambda m: F.transform(m, lambda x: F.array_position(atoms, x) - 1)))
    t = terms.withColumn("leaf_ids", atoms).withColumn("shape_json", shape).withColumn("shape_hash", F.md5("shape_json"))
    return t.select("shape_hash", "shape_json").distinct(), t.drop("term", "shape_json")


def invalidated(changed: DataFrame, leaves: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts (artifact_id) whose terms use a changed atom: two equi-joins."""
    hit = leaves.join(changed.select("atom_id").distinct(), "atom_id", "left_semi").select("prov_ref").distinct()
    return artifacts.join(hit, "prov_ref", "left_semi").select("artifact_id").distinct()
