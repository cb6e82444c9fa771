"""Grounding, commands, signatures, engine."""

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.operators import signatures
from siltstone.plans import commands, grounding
from siltstone.plans import reference_queries as rq
from siltstone.plans.algebra import Aggregate, World


def test_ask(spark, data):
    w = rq.world(spark, data)
    engine = Engine(spark, w.tables)
    verdict, rows = engine.ask("average totalprice of order by orderstatus", rq.ONTOLOGY)
    assert verdict == "answer" and {"o_orderstatus", "avg_o_totalprice"} == set(rows.columns)
    assert engine.ask("colour of the moon", rq.ONTOLOGY) == ("abstain", None)
    best = grounding.candidates("how many customers in building", rq.ONTOLOGY, grounding.value_index(w))[0]
    assert isinstance(best.term, Aggregate) and best.term.source.conditions[0].value == "building"


def test_value_index_keeps_properties_of_many_values(spark):
    names = spark.range(12_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("name"), "id").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    w = World(rq.ONTOLOGY, {"Customer": names})
    index = grounding.value_index(w)
    assert index.where("property = 'c_name'").count() == 12_000
    best = grounding.candidates("how many customers name777", rq.ONTOLOGY, index)[0]
    assert best.term.source.conditions[0].value == "name777"


@pytest.mark.parametrize("text,kind", [("rename T.a to b", "rename"), ("retype T.a as double", "retype"), ("split T by a = 1 into X and Y", "split"), ("merge T and U into V", "merge"), ("link T.a to U.k", "link"), ("T.a is the same as b", "synonym"), ("make tea", None)])
def test_parse_command(text, kind):
    c = commands.parse_command(text)
    assert (c.kind if c else None) == kind


def test_apply_and_undo(spark):
    t = {"T": spark.createDataFrame([("1", 1), ("x", 2)], "a string, k int"), "U": spark.createDataFrame([("1",)], "k string")}
    after, op, state = commands.apply("split T by k = 1 into One and Rest", t)
    assert state == "done" and after["One"].count() == 1 and commands.undo(after, op)["T"].count() == 2
    assert commands.apply("retype T.a as double", t)[2] == "warned"
    assert commands.apply("retype T.a as date", t)[2] == "vetoed"
    with pytest.raises(ValueError):
        commands.apply("make tea", t)


@pytest.mark.parametrize("values,sig", [(["N12AB", "N7C"], "ADA"), (["2024-01-02", "1999-12-31"], "D-D-D"), (["ab", "AB"], "L"), (["a1", "a1 (x)"], "aD*"), ([], ""), (["", "x"], "*")])
def test_signature(values, sig):
    assert signatures.signature(values) == sig


def test_format_signatures(spark):
    df = spark.createDataFrame([("N12AB", None), ("N7C", None), (None, None)], "a string, b string")
    assert {r["column"]: r["signature"] for r in signatures.format_signatures(df, ["a", "b"]).collect()} == {"a": "ADA", "b": ""}


def test_engine_relationships(spark, data):
    e = Engine(spark, {"nation": spark.read.parquet(f"{data}/nation.parquet").select("n_regionkey"), "region": spark.read.parquet(f"{data}/region.parquet").select("r_regionkey")})
    assert {(r["lhs"], r["verdict"]) for r in e.relationships().collect()} >= {("nation.n_regionkey", "LOOKUP_DIMENSION")}
