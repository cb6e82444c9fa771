"""Bundles, induction, calibration, clusters, cache."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import calibration, clusters
from siltstone.plans import cache, induce
from siltstone.plans import reference_queries as rq
from siltstone.plans.algebra import Aggregate, Select, World
from siltstone.sources import bundle


def test_bundle_round_trip(spark, data, tmp_path):
    cells = rq.event_cells(spark, data)
    bundle.write_bundle({"cells": cells, "nation": spark.read.parquet(f"{data}/nation.parquet")}, str(tmp_path / "b"))
    assert all(r["ok"] for r in bundle.verify_bundle(spark, str(tmp_path / "b")).collect())
    n = bundle.query_bundle(spark, str(tmp_path / "b"), "select count(*) n from survivors").first()["n"]
    assert n == cells.select("entity_uri", "prop").where("expired_at >= 4611686018427387904").distinct().count()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "b" / "nation"))
    with pytest.raises(ValueError, match="nation"):
        bundle.read_bundle(spark, str(tmp_path / "b"))


def test_triples_and_extract(spark, data):
    lines = [r["line"] for r in bundle.triples(rq.event_cells(spark, data).limit(50)).collect()]
    assert lines == sorted(lines) and all(x.endswith(" .") for x in lines)
    df = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", None), ("d", "x")], "k string, v string")
    assert [r["k"] for r in bundle.extract(df, "k", ["v"], [("v", ">", "9")], 10).collect()] == ["a", "d"]
    assert [r["k"] for r in bundle.extract(df, "k", ["v"], [("v", "!=", "9")], 10).collect()] == ["a", "c", "d"]


def test_concepts():
    has = {("t1", "id"), ("t1", "name"), ("t2", "id"), ("t2", "price"), ("t3", "id"), ("t3", "name"), ("t3", "price")}
    c = induce.Context(("t1", "t2", "t3"), ("id", "name", "price"), frozenset(has))
    found = induce.concepts(c)
    assert {tuple(sorted(i)) for _, i in found} == {("id",), ("id", "name"), ("id", "price"), ("id", "name", "price")}
    assert len(induce.covers(found)) == 4
    assert 0 < induce.stability(c, *found[0]) <= 1


def test_synonyms_and_classes():
    assert induce.synonyms(["a.custKey", "b.cust_keys", "b.price"], set()) == {"a.custKey": "a.custKey", "b.cust_keys": "a.custKey", "b.price": "b.price"}
    assert induce.dependency_classes([("city", "zip", 1.0), ("", "x", 1.0)], {"city": 3}, 10) == {"city": ["zip"]}


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.1, 0), (0.1, 0), (None, 1)], "p double, y int")
    assert calibration.calibration_error(df, "p", "y").first()["ece"] == pytest.approx(0.1)
    assert calibration.conformal_threshold(spark.range(99).select((F.col("id") / 99).alias("s")), "s") == pytest.approx(89 / 99)
    assert [r["decision"] for r in calibration.banded(df, "p", 0.85, 0.2).collect()] == ["yes", "yes", "no", "no", "no"]
    assert calibration.vote({"a": ("FK", 0.9), "b": ("FK", 0.8), "c": ("NO", 0.4)}, {})[0] == "FK"
    assert calibration.reweigh({}, {"a": ("FK", 0.9), "b": ("NO", 0.9)}, "FK")["a"] > 1


def test_pivot_clusters(spark):
    comp = spark.createDataFrame([(i, 0) for i in range(6)] + [(9, 9)], "record long, component long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], "a long, b long")
    got = clusters.pivot_clusters(comp, edges)
    assert got.count() == 7 and got.select("record").distinct().count() == 7
    prior = spark.createDataFrame([(0, "ent/x"), (1, "ent/x"), (9, "ent/y")], "record long, uri string")
    uris = {r["record"]: r["uri"] for r in clusters.assign_identifiers(got, prior).collect()}
    assert uris[9] == "ent/y" and "ent/x" in uris.values()


def _pivots(component, edges):
    """Record by record in the order of the hashes."""
    import hashlib

    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken = {}
    for r in sorted(component, key=lambda r: hashlib.md5(str(r).encode()).hexdigest()):
        if r not in taken:
            members = [r, *(x for x in near.get(r, ()) if x not in taken and component.get(x) == component[r])]
            taken.update((m, min(map(str, members))) for m in members)
    return taken


def test_pivot_clusters_equal_the_order_one_by_one(spark):
    import random

    rnd = random.Random(8)
    # a chain longer than any one task was given, and a dense part of its own
    component = {i: 0 for i in range(20_500)} | {i: 1 for i in range(30_000, 30_200)}
    edges = [(i, i + 1) for i in range(20_499)] + [(rnd.randrange(30_000, 30_200), rnd.randrange(30_000, 30_200)) for _ in range(800)] + [(5, 30_005)]
    got = clusters.pivot_clusters(spark.createDataFrame(list(component.items()), "record long, component long"), spark.createDataFrame(edges, "a long, b long"))
    found = {r["record"]: r["cluster"] for r in got.collect()}
    assert found == _pivots(component, edges) and len(set(found.values())) > 6000


def test_cache_never_stale(spark, data):
    w = rq.world(spark, data)
    kept = cache.AnswerCache(w)
    term = Aggregate(Select("Order"), "count")
    first = kept.answer(term).collect()
    assert kept.answer(term).collect() == first and kept.hits == 1
    kept.world = World(w.ontology, {**w.tables, "Order": w.tables["Order"].limit(5)})
    assert kept.answer(term).first()[0] == 5 and kept.hits == 1
