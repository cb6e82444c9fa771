"""Operators on metadata, refusals and awkward input, beside the queries that have SQL twins."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.numbering import numbered
from siltstone.functions.skew import hot_keys, pairs_within
from siltstone.operators import bitemporal, drift, identity, ledger, privacy, profile, programs, relationships, sampling
from siltstone.operators.quality import Expectation, ewma
from siltstone.operators.signatures import format_signatures
from siltstone.plans.algebra import Aggregate, ClassDef, Condition, EmptyResult, Ontology, Select, World, answered, compile_term, typecheck


def _pair(spark, left, right, **shapes):
    a = spark.createDataFrame([(v,) for v in left], f"{shapes.get('x', 'x')} {'long' if isinstance(left[0], int) else 'string'}")
    b = spark.createDataFrame([(v,) for v in right], f"{shapes.get('y', 'y')} {'long' if isinstance(right[0], int) else 'string'}")
    tables = {"l": (a, a.columns), "r": (b, b.columns)}
    return relationships.classify(relationships.signals(tables, [(f"l.{a.columns[0]}", f"r.{b.columns[0]}")]), shapes.get("shapes")).first()


def test_relationship_kinds(spark):
    fk = _pair(spark, [(i % 200) + 1 for i in range(2000)], list(range(1, 201)), x="customer_id", y="id")
    assert fk["rel_type"] == "FK_JOIN" and fk["confidence"] >= 0.6 and not fk["key_conflict"]
    apart = _pair(spark, [f"AAA{i:04}" for i in range(300)], [f"BBB{i:04}" for i in range(300)], x="code", y="code")
    assert apart["rel_type"] == "UNRELATED" and apart["confidence"] < 0.3
    city = ["NYC"] * 500 + ["LA"] * 300 + ["SF"] * 200
    assert _pair(spark, city, city, x="city", y="city")["rel_type"] == "DENORMALIZATION"
    base = [f"sku-{i % 120:03}" for i in range(600)]
    derived = _pair(spark, [b.upper() for b in base], base, x="code_upper", y="code")
    assert derived["rel_type"] == "DERIVED_FIELD" and derived["transform"] == "uppercase"
    shape = spark.createDataFrame([("r", 3, 0, 2, 8, 8, True)], '"table" string, total_columns long, fk_like long, descriptive long, most_distinct long, rows long, is_small boolean'.replace('"', "`"))
    codes = ["US", "GB", "FR", "DE", "JP", "CN", "BR", "IN"]
    assert _pair(spark, codes * 100, codes, x="country_code", y="code", shapes=shape)["rel_type"] == "LOOKUP_DIMENSION"
    skewed = _pair(spark, ["a"] * 90 + ["b"] * 5 + ["c"] * 5, ["a"] * 5 + ["b"] * 5 + ["c"] * 90, x="grade", y="grade")
    assert skewed["divergence_conflict"] and skewed["rel_type"] == "UNRELATED"


def test_estate_weights_keep_the_guard():
    for kind in relationships.ESTATE_WEIGHTS:
        assert set(relationships.estate_weights(kind)) == set(relationships.WEIGHTS)
    assert relationships.quantile_divergence([1.0], None) == 1.0 and relationships.quantile_divergence([1.0, 1.0], [1.0, 1.0]) == 0.0


ONE = Ontology({"C": ClassDef("C", "k", {"k": "integer", "name": "string", "mass": "float"}, units={"mass": "kg"})}, {})


def test_answers_relax_and_abstain(spark):
    world = World(ONE, {"C": spark.createDataFrame([(1, "Acme Airlines, Inc.", 5.0), (2, "BETA", 7.0), (3, None, None)], "k int, name string, mass double")})
    found = lambda v: answered(Select("C", (Condition("name", "=", v),)), world)
    assert [found(v)[1] for v in ("BETA", "beta", "ACME AIR LINES")] == [0, 1, 2]
    with pytest.raises(EmptyResult):
        found("nobody")
    with pytest.raises(EmptyResult):  # nothing to count is no zero
        answered(Aggregate(Select("C", (Condition("name", "=", "nobody"),)), "count"), world)
    assert answered(Aggregate(Select("C"), "sum", "mass"), world)[0].first()[0] == 12.0
    heavy = Select("C", (Condition("mass", ">", 6000, "g"),))
    assert [r["k"] for r in compile_term(heavy, world).collect()] == [2]
    assert typecheck(Select("C", (Condition("mass", ">", 1, "sqft"),)), ONE) == ["units don't convert: sqft to kg"]
    assert typecheck(Select("C", (Condition("name", "=", "x", "kg"),)), ONE) == ["not a quantity: x kg"]


def test_commits_number_over_the_whole_store(spark):
    cell = lambda seq, e, start: (seq, e, "p", "1", "1", 1.0, start, bitemporal.FOREVER, 5, bitemporal.FOREVER, "a", None, 1)
    store = spark.createDataFrame([cell(1, "x", 0), cell(2, "y", 0)], bitemporal.CELL_SCHEMA)
    batch = spark.createDataFrame([cell(3, "x", 10)[:11] + (1.0, 1), cell(4, "y", 10)[:11] + (1.0, 1)], bitemporal.CELL_SCHEMA)
    rows = bitemporal.commit(store.fillna(0.5, ["confidence"]), batch, 100).collect()
    assert sorted(r["seq"] for r in rows) == [1, 2, 3, 4, 5, 6]
    # a missing confidence never wins
    both = spark.createDataFrame([cell(1, "x", 0), cell(2, "x", 0)[:11] + (0.1, 1)], bitemporal.CELL_SCHEMA)
    assert bitemporal.winners(both).first()["seq"] == 2
    with pytest.raises(ValueError):
        bitemporal.human_edits(store, spark.createDataFrame([("x", "p", '"text"', "why")], "entity_uri string, prop string, value_json string, evidence string"), {"p": "number"}, 7)
    with pytest.raises(ValueError):
        bitemporal.human_edits(store, spark.createDataFrame([("x", "p", "1", "")], "entity_uri string, prop string, value_json string, evidence string"), {"p": "number"}, 7)


def test_programs_are_refused(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "k int, v string")
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "key string, n int")
    score = lambda p, checks: programs.accepted(programs.verify(p, {"t": t, "d": dim}, checks), p).first()["accepted"]
    assert not score(programs.Program("t", {"k": "s.k", "n": "r.n"}, lookup=programs.Lookup("d", "v", "key")), {})  # multiplies rows
    many = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    p = programs.Program("t", {"k": "s.k", "v": "s.v"})
    verified = lambda check: programs.accepted(programs.verify(p, {"t": many}, {"v": check}), p).first()
    assert verified("v = 'a'")["accepted"] and not verified("v = 'b'")["accepted"] and 100 < verified("v = 'a'")["held_out"] < 200
    assert programs.match_columns(["cust_name", "zip"], ["name", "customer", "zip_code"]) == {"cust_name": "name", "zip": "zip_code"}


def test_contract_roundtrip(spark):
    rules = [Expectation("k", "not_null"), Expectation("v", "in", ("a", "b")), Expectation("k", "range", (1, 9))]
    text = drift.contract("t", spark.createDataFrame([(1, "a")], "k int, v string"), rules)
    assert drift.parse_contract(text) == ("t", {"k": "int", "v": "string"}, rules)


def test_ledger_refuses_and_numbers(spark):
    fresh = spark.createDataFrame([("x", 1, 5), ("y", 2, 4)], "task string, tokens int, created_at int")
    assert [(r["seq"], r["task"]) for r in ledger.newest(ledger.append("cost", None, fresh), 5).collect()] == [(2, "x"), (1, "y")]
    with pytest.raises(ValueError):
        ledger.append("cost", None, fresh.withColumn("task", F.lit(None).cast("string")))


def test_privacy(spark):
    df = spark.createDataFrame([("a@b.de", None, 1), ("c", None, 2)], "x string, street string, n int")
    assert {r["column"]: r["sensitivity"] for r in privacy.sensitivity(df).collect()} == {"x": "pii", "street": "quasi", "n": "none"}
    assert privacy.leaks({"t": (df, ["x"])}, df.limit(0).select(F.col("x").alias("value"))).count() == 0
    assert privacy.masked("call 555-123-4567 or a@b.de") == "call <phone> or <email>"


@pytest.mark.parametrize("name,form", [("U.S. Air, L.L.C.", "US AIR LLC"), (" o'neil & sons ", "ONEIL SONS"), ("", ""), (None, None)])
def test_norm_name(spark, name, form):
    assert spark.createDataFrame([(name,)], "n string").select(identity.norm_name(F.col("n"))).first()[0] == form


def test_pairs_within_hot_block(spark):
    df = spark.createDataFrame([("b", i) for i in range(40)] + [("c", 1), (None, 2), ("c", 2)], "b string, k int")
    expected = sorted([(i, j) for i in range(40) for j in range(i + 1, 40)] + [(1, 2)])
    assert sorted(map(tuple, pairs_within(df, "b", "k", 7).collect())) == expected
    hot, total = hot_keys(df.where("b is not null"), ["b"], 10)
    assert hot == [("b", 40)] and total == 42


def test_numbers_and_quantiles(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("v")).repartition(7)
    assert sorted(map(tuple, numbered(df, ["v"], 5, "n").collect())) == [(i, i + 5) for i in range(1000)]
    counts = spark.createDataFrame([("c", 1.0, 9), ("c", 5.0, 1), ("d", 2.0, 1)], "column string, value double, n long")
    got = {(r["column"], r["i"]): r["value"] for r in profile.exact_quantiles(counts, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {("c", 0): 1.0, ("c", 1): 1.0, ("c", 2): 1.0, ("c", 3): 5.0, ("d", 0): 2.0, ("d", 1): 2.0, ("d", 2): 2.0, ("d", 3): 2.0}
    assert profile.exact_quantiles(counts.limit(0), [0.5]).count() == 0


def test_signatures_and_samples_of_awkward_values(spark):
    df = spark.createDataFrame([("A1", "x" * 5000), ("B22", "y 1 " * 400), (None, None)], "a string, b string")
    assert {r["column"]: r["signature"] for r in format_signatures(df, ["a", "b"]).collect()} == {"a": "AD", "b": "*"}
    many = spark.range(5000).select((F.col("id") % 40).alias("k"), "id")
    assert 90 <= sampling.stratified(many, "k", 100).count() <= 120
    assert sampling.even_sample(many, "k", 5).count() == 5


def test_ewma_alarms(spark):
    rows = [("a", i, 1.0 if i < 10 else 9.0) for i in range(12)] + [("b", 0, None), ("b", 1, 2.0), (None, 0, 1.0)]
    got = ewma(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v").collect()
    assert {(r["k"], r["t"]) for r in got if r["alarm"]} == {("a", 10), ("a", 11)} and len(got) == 13
