"""The engine's own operators: properties, edges, streams."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import bitemporal, dependencies, provenance, quality, resolve, search
from siltstone.plans import reference_queries as rq
from siltstone.plans.algebra import Aggregate, Condition, Select, TopK, Traverse, typecheck
from siltstone.plans.transforms import Runner, Transform, TransformError, affected, lineage, ordered, validate_sql
from siltstone.sources import snapshots
from siltstone.streaming import changes


@pytest.mark.parametrize(
    "term,error",
    [
        (Select("Nothing"), "unknown class"), (Select("Order", (Condition("nope", "=", 1),)), "unknown property"), (Select("Order", (Condition("in_nation.n_name", "=", "x"),)), "phantom traversal"),
        (Traverse(Select("Nation"), "placed_by"), "phantom traversal"), (Aggregate(Select("Order"), "sum", "o_orderstatus"), "not a number"), (TopK(Select("Order"), "o_totalprice", 0), "k must be"), (Traverse(Aggregate(Select("Order"), "count"), "placed_by"), "wrong grain"),
    ],
)
def test_typecheck_refuses(term, error):
    assert any(error in e for e in typecheck(term, rq.ONTOLOGY))


@pytest.mark.parametrize(
    "sql,code",
    [
        ("select 1 as a; select 2", "multiple_statements"), ("drop table t", "ddl"), ("insert into t values (1)", "dml"), ("select a from t union select a from u", "set_operation"), ("select row_number() over (order by a) as n from t", "window_function"),
        ("select a from t right join u on t.a = u.a", "bad_join"), ("select a from t having a > 1", "disallowed_construct"), ("select sleep(1) as s", "disallowed_function"), ("selekt 1", "not_select"), ("select (a from t", "parse_error"),
    ],
)
def test_validate_sql_refuses(spark, sql, code):
    with pytest.raises(TransformError) as e:
        validate_sql(spark, sql)
    assert e.value.code == code


def test_validate_sql_accepts(spark):
    validate_sql(spark, "select upper(a) as a, count(*) as n from t left join u on t.k = u.k where a in ('x; drop', 'y') group by upper(a)")


def test_lineage(spark):
    t = spark.createDataFrame([(1, 2)], "a int, b int")
    assert lineage(spark, "select a + b as c, a as d from lt", {"lt": t}) == {"c": {("lt", "a"), ("lt", "b")}, "d": {("lt", "a")}}


def test_runner_memo_and_failure(spark, tmp_path):
    src = spark.createDataFrame([(1,), (2,)], "a int")
    ts = [Transform("twice", "select a * 2 as b from src", ("src",)), Transform("bad", "select nope as c from src", ("src",)), Transform("after", "select c as d from bad", ("bad",))]
    runner = Runner(spark, str(tmp_path))
    assert runner.run(ts, {"src": src}) == {"bad": "failed", "after": "upstream_failed", "twice": "success"}
    assert runner.run(ts[:1], {"src": src}) == {"twice": "memo"}
    assert affected(ts, {"bad"}) == {"after"}
    with pytest.raises(TransformError):
        ordered([Transform("x", "", ("y",)), Transform("y", "", ("x",))])


def test_commit_keeps_one_open_cell(spark):
    rnd = random.Random(2)
    cell = lambda i, low, high, rank: (i, "e", "p", str(i), str(i), float(i), low, high, i, bitemporal.FOREVER, f"r{i}", 0.5, rank)
    store = spark.createDataFrame([cell(0, 0, bitemporal.FOREVER, 2)], bitemporal.CELL_SCHEMA)
    for now in range(100, 600, 100):
        low = rnd.randrange(50)
        batch = spark.createDataFrame([cell(now, low, low + rnd.randrange(1, 60), rnd.choice([1, 2, 3]))], bitemporal.CELL_SCHEMA)
        store = spark.createDataFrame(bitemporal.commit(store, batch, now).collect(), bitemporal.CELL_SCHEMA)
        for at in (0, 20, 49, 70, 1000):
            assert store.where(bitemporal.as_of(at)).count() == 1
    with pytest.raises(ValueError):
        bitemporal.commit(store, store.limit(1).withColumn("prov_ref", F.lit("")), 900)


def test_snapshot_mirror(spark, tmp_path):
    a, b = spark.range(5).withColumn("x", F.lit("a")), spark.range(5).withColumn("x", F.lit("b"))
    first = snapshots.write_snapshot(a, str(tmp_path), 1)
    snapshots.write_snapshot(b, str(tmp_path), 2)
    assert snapshots.write_snapshot(a.orderBy(F.desc("id")), str(tmp_path), 3) == first
    assert {r["x"] for r in snapshots.read_snapshot(spark, str(tmp_path), 2).collect()} == {"b"}
    assert snapshots.snapshot_diff(snapshots.with_row_key(a, ["id"]), snapshots.with_row_key(a, ["id"])).count() == 0


def test_csv_source(spark, tmp_path):
    (tmp_path / "My File.csv").write_text("a,b\n1,\n2,x\n3\n")
    t = snapshots.discover_sources(spark, str(tmp_path))["my_file"]
    assert [tuple(r) for r in t.orderBy("a").collect()] == [("1", ""), ("2", "x"), ("3", None)]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "one\r\ntwo\r\n\r\n\r\nthree\n \none\ntwo"), (2, None), (3, "  ")], "k int, t string")
    assert [(r["paragraph"], r["occurrence"]) for r in snapshots.paragraphs(df, "k", "t").orderBy("place").collect()] == [("one\ntwo", 1), ("three", 1), ("one\ntwo", 2)]


def test_functional_dependencies_with_nulls(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "x", 2), ("a", "y", 1), ("b", "x", 2)], "a string, b string, c int")
    found = {(r["lhs"], r["rhs"]) for r in dependencies.functional_dependencies(df).collect()}
    assert ("a", "b") in found and ("b", "a") not in found


def _tfidf(texts):
    """Unit vectors of token weights, by the definition."""
    import hashlib
    import math
    import re
    from collections import Counter

    tf = {}
    for k, text in texts.items():
        words = re.findall("[a-z0-9]+", (text or "").lower())
        v = Counter()
        for t, n in Counter([*words, *(w[i : i + 3] for w in words if len(w) > 3 for i in range(len(w) - 2))]).items():
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 4096] += 1 + math.log(n)
        tf[k] = v
    df = Counter(b for v in tf.values() for b in v)
    vectors = {k: {b: w * (math.log((1 + len(texts)) / (1 + df[b])) + 1) for b, w in v.items()} for k, v in tf.items()}
    return {k: {b: w / math.sqrt(sum(x * x for x in v.values())) for b, w in v.items()} for k, v in vectors.items() if v}


def test_search_finds_parts_of_words(spark):
    df = spark.createDataFrame([(1, "weatherstation"), (2, "unrelated"), (3, None)], "k int, t string")
    found = search.tfidf_search(df, "k", "t", "weather").collect()
    assert found[0]["id"] == 1 and found[0]["score"] > 0.3


def test_search_of_rows_equals_brute_force(spark, data):
    texts = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    vectors = _tfidf(texts)
    dot = lambda a, b: round(sum(w * b.get(i, 0.0) for i, w in a.items()), 6)
    df = spark.read.parquet(f"{data}/documents.parquet").repartition(3)
    found = {}
    for r in search.tfidf_search_rows(df, "doc_id", "text", F.col("doc_id") % 20 == 0, block=2).collect():
        found.setdefault(r["query"], {})[r["id"]] = round(r["score"], 6)
    assert set(found) == {k for k in vectors if k % 20 == 0} and found
    for q, rows in found.items():
        every = {k: s for k, v in vectors.items() if (s := dot(vectors[q], v)) > 0}
        assert sorted(rows.values()) == pytest.approx(sorted(every.values())[-10:], abs=2e-6)
        assert all(every[k] == pytest.approx(s, abs=2e-6) for k, s in rows.items())


WEIGHTS = [
    ("7.381,0 kg", None, 7381.0), ("1,002.0 KGM", "LB", 1002.0), ("10kgs", None, 10.0), ("2 pounds", "", 0.9072), ("9.2 tonnes", None, 9200.0), ("3 t", None, 3000.0), ("1.5MT", None, 1500.0), ("2 short tons", None, 1814.3695),
    ("2 sh tn", None, 1814.3695), ("995,000 G", None, 995.0), (" 1,187 ", "GRM", 1.187), ("100", "Lb.", 45.3592), ("100", "N/A", None), ("heavy", "KG", None), ("", "KG", None), (None, "KG", None), ("5 furlongs", "KG", None), ("1.2.3 kg", None, None),
]


def test_unit_suffixes_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(i, *w[:2]) for i, w in enumerate(WEIGHTS)], "shipment_id int, gross_weight string, weight_uom string").write.parquet(str(tmp_path / "shipments.parquet"))
    found = {r["shipment_id"]: r["kg"] for r in rq.QUERIES["clean_unit_suffix_all"](spark, str(tmp_path)).collect()}
    assert found == {i: w[2] if w[2] is None else pytest.approx(w[2], abs=1e-4) for i, w in enumerate(WEIGHTS)}


def test_dates_of_all_rows(spark, data):
    from datetime import datetime

    def read(text):
        for f in ("%Y%m%d", "%Y-%m-%d", "%d-%b-%Y", "%m/%d/%Y"):
            try:
                return datetime.strptime((text or "").strip(), f).date().isoformat()
            except ValueError:
                pass
        return None

    rows = spark.read.parquet(f"{data}/faa_master.parquet").select("reg_key", "cert_issue_date").collect()
    found = rq.QUERIES["clean_dates_all"](spark, data).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], read(r[1]))) for r in rows)


def test_links_from_every_customer(spark, data):
    customers = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    nations = spark.read.parquet(f"{data}/nation.parquet").select("n_nationkey", "n_regionkey").distinct().collect()
    near = {}
    for a, b in [(f"c{k}", f"n{n}") for k, n in customers] + [(f"n{n}", f"r{r}") for n, r in nations] + [(f"r{r}", f"n{n}") for n, r in nations]:
        near.setdefault(a, set()).add(b)
    expected = set()
    for start in {f"c{k}" for k, _ in customers}:
        seen, ring = {start}, {start}
        for hops in (1, 2, 3):
            ring = {b for a in ring for b in near.get(a, ())} - seen
            seen |= ring
            expected |= {(start, b, hops) for b in ring}
    assert set(map(tuple, rq.QUERIES["link_bfs_depth3_all"](spark, data).select("start", "uri", "hops").collect())) == expected


def test_jaro_winkler():
    assert round(resolve.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert resolve.jaro_winkler("", "A") == 0.0 and resolve.jaro_winkler("A", "A") == 1.0


def test_fellegi_sunter_separates():
    model = resolve.fellegi_sunter([((2, 2), 90), ((0, 0), 900), ((2, 0), 30), ((0, 2), 30), ((-1, 2), 10)])
    assert model["m"][0][2] > model["u"][0][2]


def test_provenance_semirings(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]],)], "t array<array<string>>")
    conf = F.create_map(F.lit("a"), F.lit(0.9), F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(0.4))
    r = df.select(provenance.cited(F.col("t")), provenance.best_confidence(F.col("t"), conf), provenance.derivable(F.col("t"), F.array(F.lit("a"), F.lit("b")))).first()
    assert list(r[0]) == ["a", "b", "c"] and r[1] == pytest.approx(0.45) and r[2]


def test_expectations_skip_nulls(spark):
    df = spark.createDataFrame([(None,), ("1",), ("x",)], "a string")
    r = quality.evaluate(df, [quality.Expectation("a", "type", "int"), quality.Expectation("a", "not_null")]).collect()
    assert [(x["n_evaluated"], x["violations"]) for x in r] == [(2, 1), (3, 1)]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = changes.windowed_counts(stream, "ts", "event_type", late="3650 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, changes.windowed_counts(events, "ts", "event_type").collect()))


def test_batches_apply_once(spark, tmp_path):
    feed = spark.createDataFrame([("1", "a", "insert", "x"), ("1", "b", "insert", "y")], "row_key string, col string, kind string, value string")
    feed.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    changes.apply_batches(stream, str(tmp_path / "cp"), changes.versioned_writer(str(tmp_path / "out"))).awaitTermination(120)
    held = spark.read.parquet(str(tmp_path / "out"))
    assert changes.latest_cells(held).count() == 2
