"""The dealt core operators against brute force and on awkward input."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from siltstone.operators import event_time, load_profile, orphans, unit_conversion
from siltstone.plans import core_problems

VERSIONS = "entity string, version string, start long, end long, major long, minor long"


def _brute(events, versions):
    out = {}
    for i, entity, at in events:
        live = [v for v in versions if v[0] is not None and v[0] == entity and v[2] is not None and at is not None and v[2] <= at < (v[3] if v[3] is not None else 2**62)]
        out[i] = max(live, key=lambda v: (v[4], v[5], v[1]))[1] if live else None
    return out


@pytest.mark.parametrize("floor", [10**9, 5])
def test_event_time_equals_brute_force(spark, floor):
    rnd = random.Random(floor)
    versions = [(rnd.choice("abc"), f"v{i}", (s := rnd.randrange(100)), rnd.choice([None, s, s + rnd.randrange(1, 60)]), rnd.randrange(5), rnd.randrange(3)) for i in range(150)]
    versions += versions[:10] + [(None, "x", 1, None, 9, 9), ("a", "y", None, None, 9, 9)]
    events = [(i, rnd.choice(["a", "b", "c", "d", None]), rnd.choice([None, *range(120)])) for i in range(400)]
    segments = event_time.timeline(spark.createDataFrame(versions, VERSIONS), hot_floor=floor)
    got = event_time.carry_forward(spark.createDataFrame(events, "id int, entity string, at long"), segments, hot_floor=floor)
    assert {r["id"]: r["version"] for r in got.collect()} == _brute(events, versions)


def test_event_time_empty(spark):
    none = spark.createDataFrame([], VERSIONS)
    assert event_time.timeline(none).count() == 0
    events = spark.createDataFrame([(1, "a", 5)], "id int, entity string, at long")
    assert [r["version"] for r in event_time.carry_forward(events, event_time.timeline(none)).collect()] == [None]
    assert event_time.carry_forward(events.limit(0), event_time.timeline(none)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_orphans_equal_brute_force(spark, small):
    rnd = random.Random(3)
    keys = [f"k{i:03}" for i in range(60)]
    parents = [(rnd.choice(keys), rnd.randrange(100), rnd.choice([None, 50, 90, 0])) for _ in range(80)] + [(None, 1, None), ("k001", None, None)]
    refs = [(rnd.choice([*keys, "k001", "k001", "k001", None, "nowhere"]), rnd.choice([None, *range(110)]), f"r{i}") for i in range(500)]
    live = lambda k, t: any(p[0] == k and p[1] is not None and p[1] <= t and (p[2] is None or p[2] > t) and (p[2] is None or p[2] > p[1]) for p in parents)
    expected = sorted(r[2] for r in refs if r[0] is not None and not live(r[0], 2**62 - 1 if r[1] is None else r[1]))
    sizes = {"rows_per_range": 11} if small else {}
    got = orphans.orphans(spark.createDataFrame(refs, "key string, at long, row_key string"), spark.createDataFrame(parents, "key string, start long, end long"), **sizes)
    assert sorted(r["row_key"] for r in got.collect()) == expected


def test_orphans_hot_key_and_time(spark):
    """A key, and one time of it, with most rows: they span several ranges, and all of them know its parents."""
    refs = spark.range(3000).selectExpr("if(id % 3 = 0, concat('k', id % 50), 'hot') as key", "if(id % 2 = 0, 7L, id % 40) as at", "cast(id as string) as row_key")
    parents = spark.range(400).selectExpr("if(id % 4 = 0, concat('k', id % 50), 'hot') as key", "10 + id % 13 as start", "12 + id % 19 as end")
    ranges = orphans._ranges(spark, parents, refs, 100)
    assert sum(k == "hot" for k, _ in ranges.bounds) > 10 and len(set(ranges.bounds)) < len(ranges.bounds)
    got = sorted(r["row_key"] for r in orphans.orphans(refs, parents, 100).collect())
    assert got == sorted(r["row_key"] for r in orphans.orphans(refs, parents).collect())
    expected = refs.join(parents, "key", "left").groupBy("row_key").agg(F.max(F.expr("coalesce(start <= at and at < end, false)")).alias("there")).where("not there")
    assert got == sorted(r["row_key"] for r in expected.collect())


def test_orphans_empty(spark):
    refs = spark.createDataFrame([("a", 1, "r")], "key string, at long, row_key string")
    parents = spark.createDataFrame([], "key string, start long, end long")
    assert [r["row_key"] for r in orphans.orphans(refs, parents).collect()] == ["r"]
    assert orphans.orphans(refs.limit(0), parents).count() == 0


FIGURES = [
    ("1.009,7 kg", "LB", "kg", 1009.7), ("1,002.0", "KGS", "kg", 1002.0), ("2451.5lbs", "KG", "lb", 2451.5), ("9.2 tonnes", None, "t", 9.2), ("12 short tons", "", "short_ton", 12.0),
    ("  1,187 ", "GRM", "g", 1187.0), ("1213", "N/A", None, 1213.0), ("", "KG", "kg", None), (None, "KG", "kg", None), ("heavy", "KG", "kg", None), ("9" * 400, "KG", "kg", None), ("5", "furlong", None, 5.0),
]


def _weights(spark, rows):
    df = spark.createDataFrame([(f"s{i}", f, u, "OCEAN", "X", "1,200.00") for i, (f, u, *_) in enumerate(rows)], "shipment_id string, gross_weight string, weight_uom string, transport_mode string, origin_port string, freight_cost string")
    return core_problems.weight_records(df.withColumn("value", F.lit("clash")).withColumn("unit", F.lit("clash")))


def test_units_read(spark):
    out = {r["row_key"]: r for r in unit_conversion.convert(_weights(spark, FIGURES), None).collect()}
    for i, (_, _, unit, value) in enumerate(FIGURES):
        assert out[f"s{i}"]["stated_unit"] == unit, FIGURES[i]
        if value is None:
            assert out[f"s{i}"]["value"] is None or out[f"s{i}"]["value"] > 1e300
        else:
            assert out[f"s{i}"]["value"] == pytest.approx(value)
    # nobody is sure of anything without a model
    assert all(r["basis"] == "review" and r["unit"] is None and r["canon_value"] is None for r in out.values())


def test_units_depend_on_the_model(spark):
    rnd = random.Random(2)
    records = _weights(spark, [(f"{rnd.uniform(200, 900):.1f}", rnd.choice(["KG", "LB"])) for _ in range(800)])
    model = unit_conversion.fit(records, train_rows=2000)
    assert {(r["basis"], r["unit"]) for r in unit_conversion.convert(records, model).select("basis", "unit").distinct().collect()} == {("model", "kg"), ("model", "lb")}
    model.trees.chances[:] = 0.0
    model.trees.chances[:, unit_conversion.CODES["g"]] = 1.0  # a model that always says grams: no row is converted
    assert {r["basis"] for r in unit_conversion.convert(records, model).select("basis").distinct().collect()} == {"review"}


def test_units_of_all_records_held_out(spark):
    """On the test tables: nearly all stated units come through the model, and confident guesses without statements hold."""
    records = core_problems.quantity_records(spark, "/root/testdata/sf0.01")
    model = unit_conversion.fit(records)
    out = unit_conversion.convert(records, model).where("stated_unit is not null and value is not null")
    n, through = out.agg(F.count(F.lit(1)), F.sum((F.col("basis") == "model").cast("int"))).first()
    assert through > 0.998 * n
    # rows of the fold that no tree has seen, with all their statements hidden
    held = unit_conversion.training_sample(records).where("fold = 0")
    guess = model.predict(held, F.lit(True)).where(F.col("confidence") >= unit_conversion.CONFIDENT)
    by = {r["family"]: (r["n"], r["right"]) for r in guess.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted_unit") == F.col("stated")).cast("int")).alias("right")).collect()}
    assert all(right >= 0.9 for n, right in by.values() if n >= 20) and by["count"][1] > 0.99 and by["area"][1] > 0.97


@pytest.mark.parametrize("text,unit", [("UoM GRO: flex cable", "gross"), ("per 100 pcs: x", "hundred"), ("x / 1000 pcs units - rush", "thousand"), ("by the dozen: x", "dozen"), ("connector 9p", None), (None, None), ("", None)])
def test_count_unit_in_text(spark, text, unit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(unit_conversion.count_unit_in_text(F.col("t"))).first()[0] == unit


def test_units_predicted_on_held_out_rows(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(1500):
        kg = rnd.uniform(200, 900)
        rows.append(rnd.choice([(f"{kg:.1f}", "KG"), (f"{kg * 1000:.0f}", "GRM"), (f"{kg / 1000:.4f}", "MT")]))
    records = _weights(spark, rows)
    model = unit_conversion.fit(records, train_rows=2000)
    hidden = unit_conversion.convert(_weights(spark, [(f, None) for f, _ in rows]), model)
    truth = {"KG": "kg", "GRM": "g", "MT": "t"}
    sure = [(r["unit"], truth[rows[int(r["row_key"][1:])][1]]) for r in hidden.collect() if r["basis"] == "predicted"]
    assert len(sure) > 1200 and sum(a == b for a, b in sure) / len(sure) > 0.95


def test_units_empty(spark):
    records = _weights(spark, FIGURES[:1]).limit(0)
    assert unit_conversion.fit(records) is None
    assert unit_conversion.convert(records, None).count() == 0


@pytest.mark.parametrize("text,mask", [("N73125MG", "A9+AA"), ("rev. 2", "aaa. 9"), ("", ""), ("ÄÖ-ß", "AA-a"), ("-1.0", "-9.9"), ("x" * 5000, "a+")])
def test_mask(spark, text, mask):
    assert spark.createDataFrame([(text,)], "t string").select(load_profile.mask(F.col("t"))).first()[0] == mask


def _loads(spark, change=None):
    rnd = random.Random(5)
    rows = []
    for load in range(30):
        for _ in range(200):
            sex, mass = rnd.choice(["MALE", "FEMALE", "MALE", "FEMALE", None if rnd.random() < 0.1 else "MALE"]), rnd.gauss(4000, 500)
            if load == 7 and change:
                sex, mass = change(sex, mass)
            rows.append((load, sex, mass))
    return load_profile.cells(spark.createDataFrame(rows, "load_no int, sex string, mass double"), "t", "load_no", ["sex", "mass"])


@pytest.mark.parametrize(
    "change,column",
    [(None, None), (lambda s, m: (None, m), "sex"), (lambda s, m: (s and s.lower(), m), "sex"), (lambda s, m: (s and s + "  ", m), "sex"), (lambda s, m: ("FEMALE", m), "sex"), (lambda s, m: (s, m * 2.2), "mass"), (lambda s, m: (s, None), "mass"), (lambda s, m: (s, -1.0), "mass")],
)
def test_departures(spark, change, column):
    found = [(r["load_no"], r["column_name"]) for r in load_profile.departures(_loads(spark, change)).collect()]
    assert found == ([(7, column)] if column else [])


def test_profile_awkward(spark):
    df = spark.createDataFrame([(1, None, None), (1, "", float("nan")), (2, "x" * 100_000, 1.0), (2, "x" * 100_000, 1.0)], "load_no int, value string, number double")
    cells = load_profile.cells(df, "t", "load_no", ["value", "number"])
    described = {(r["load_no"], r["column_name"]): r for r in load_profile.describe(cells).collect()}
    assert described[(1, "value")]["n_null"] == 1 and described[(2, "value")]["n_distinct"] == 1
    load_profile.departures(cells).count()
    load_profile.rare_masks(cells).count()
    empty = cells.limit(0)
    assert load_profile.departures(empty).count() == 0 and load_profile.describe(empty).count() == 0


@pytest.mark.parametrize("text,day", [("20140521", date(2014, 5, 21)), ("2014-05-21", date(2014, 5, 21)), ("21-MAY-2014", date(2014, 5, 21)), ("05/21/2014", date(2014, 5, 21)), (" 20140521 ", date(2014, 5, 21)), ("00000000", None), ("20141341", None), ("", None), (None, None), ("31-FEB-2014", None)])
def test_parse_day(spark, text, day):
    from siltstone.functions.text import parse_day

    assert spark.createDataFrame([(text,)], "t string").select(parse_day(F.col("t"))).first()[0] == day
