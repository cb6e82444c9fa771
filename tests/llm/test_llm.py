"""The dealt operators tagged llm against brute force, exact round trips and awkward input."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sql_twins import assert_same  # noqa: E402

from siltstone.llm import groups, matching, metric_join, mixing, name_variants, packing, queries, text_stats, tokens  # noqa: E402


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        assert_same(df, queries.SQL[name], data)
    else:
        df.count()


# groups


def _union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(99, i) for i in range(40)], [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (7, 7)], []])
def test_connected(spark, edges):
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (3, None)], "a long, b long")
    assert {r["node"]: r["label"] for r in groups.connected(df).collect()} == _union_find([e for e in edges if e[0] != e[1]])


def test_latest_matches(spark):
    rows = [(1, 2, "match", 1), (2, 1, "nonmatch", 2), (3, 4, "nonmatch", 1), (4, 3, " MATCH ", 2), (5, 6, None, 1), (7, 7, "match", 1), (None, 1, "match", 1), (8, 9, "match", 1), (8, 9, "defer", 1), (10, 11, "match", 1), (11, 10, None, 2)]
    df = spark.createDataFrame(rows, "l long, r long, v string, t int").withColumn("a", F.lit("clash"))
    assert sorted(map(tuple, groups.latest_matches(df, "l", "r", "v", "t").collect())) == [(3, 4), (8, 9)]


def test_group_records_empty(spark):
    none = spark.createDataFrame([], "a long, b long")
    records = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    assert sorted(map(tuple, groups.group_records(records, "id", none).collect())) == [(1, 1), (2, 2)]
    assert groups.group_records(records.limit(0), "id", none).count() == 0


# metric join


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("radius,cell", [(1, 400), (2, 5), (3, 8), (1, 1), (3, 1)])
def test_radius_join_equals_brute_force(spark, radius, cell):
    rnd = random.Random(radius)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 9))) for _ in range(120)] + ["", "x" * 300]
    rows = [(rnd.choice(["p", "q"]), w) for w in words] * 2 + [(None, "abcd"), ("p", None)]
    blocks = {b: sorted({w for k, w in rows if k == b and w is not None}) for b in "pq"}
    expected = {(b, x, y, n) for b, ws in blocks.items() for i, x in enumerate(ws) for y in ws[i + 1 :] if (n := _levenshtein(x, y)) <= radius}
    got = metric_join.radius_join(spark.createDataFrame(rows, "block string, s string"), radius, cell)
    assert {tuple(r) for r in got.collect()} == expected


def test_registered_names_have_pivots(spark):
    """The cores of the registered query's table are divided among pivots, more of them as the table grows."""
    def pivots(sf):
        faa = spark.read.parquet(f"/root/testdata/{sf}/faa_master.parquet")
        names = faa.select(name_variants.fold(name_variants.present(F.col("registrant_name"))).alias("name"), F.concat_ws("|", "state_code", "county").alias("block")).where("name is not null").distinct()
        points = names.join(name_variants.parsed_names(names), "name").select("block", F.lit("").alias("path"), F.col("core").alias("s"), F.lit(True).alias("home")).distinct()
        return metric_join.draw_pivots(points, 3).agg(F.sum(F.size("pivots")), F.max(F.size("pivots"))).first()

    few, many = pivots("sf0.01"), pivots("sf0.1")
    assert (few[0] or 0) < many[0] and many[1] >= 3


def test_pairs_of_a_hot_group(spark):
    rows = [("g", f"k{i:03}", f"n{i % 7}") for i in range(60)] + [("h", "a", "x"), ("h", "b", "y"), ("h", "b", "y"), ("i", "c", "z")]
    expected = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2])
    for largest in (5, 2000):
        got = name_variants.variant_pairs(spark.createDataFrame(rows, "group_id string, key string, name string"), largest)
        assert sorted(map(tuple, got.collect())) == sorted(set(expected))


def test_county_loses_no_link(spark):
    """Against all pairs without a block: names that read alike at one street address are never in two counties."""
    faa = spark.read.parquet("/root/testdata/sf0.01/faa_master.parquet")
    line = F.upper(F.trim(F.regexp_replace("street", r"[^A-Za-z0-9]+", " ")))
    rows = faa.where(F.length(F.trim("street")) > 5).select(F.concat_ws("|", F.trim("state_code"), F.trim("county")).alias("block"), F.regexp_extract(line, r"^(\d+)", 1).alias("number"), F.regexp_extract(line, r"^\d+ (\S+)", 1).alias("street"), name_variants.fold(F.col("registrant_name")).alias("name")).where("number <> '' and name <> ''").distinct()
    names = name_variants.parsed_names(rows)
    x = rows.join(names, "name").select("block", "number", "street", "core").distinct()
    y = x.select(*[F.col(c).alias(c + "2") for c in x.columns])
    met = x.join(y, (F.col("number") == F.col("number2")) & (F.levenshtein("street", "street2", 2) >= 0) & (F.levenshtein("core", "core2", 3) >= 0))
    linked, lost = met.agg(F.count(F.lit(1)), F.sum((F.col("block") != F.col("block2")).cast("int"))).first()
    assert linked > 1000 and lost == 0


# names


@pytest.mark.parametrize(
    "a,b",
    [("SORNBERG LAWRENCE K III", "Larry K. Sornberg Iii"), ("THALNOVA,FREDERICK F.", "FREDDY F THALNOVA"), ("X AIRWAYS, L.L.C.", "THE X AWYS LIMITED LIABILITY CO"), ("EQUIPMENT, NORTH LLC", "NORTH EQPT LLC"), ("OAK & ELM AIR SERVICES", "OAK AND ELM AIR SVC INC")],
)
def test_parse_name_same(a, b):
    assert name_variants.parse_name(a) == name_variants.parse_name(b)


@pytest.mark.parametrize("name", ["", ",", "JR", "A", "X Y Z W V U T", "É" * 3000, "123", "& AND &", "L L C"])
def test_parse_name_awkward(name):
    assert len(name_variants.parse_name(name)) == 5


def _registrants(spark, rows):
    df = spark.createDataFrame(rows, "reg_key string, registrant_name string, street string, city string, zip_code string")
    return df.withColumn("state_code", F.lit("TX")).withColumn("county", F.lit("001")).withColumn("name", F.lit("clash"))


def _groups(spark, rows):
    df = name_variants.link_registrants(_registrants(spark, rows), "reg_key", "registrant_name", "street", "city", "state_code", "zip_code", "county")
    found = {}
    for r in df.collect():
        found.setdefault(r["group_id"], set()).add(r["key"])
    return sorted(sorted(g) for g in found.values())


def test_registrants(spark):
    home, other = ("12 Oak Lane", "Elmville", "12345"), ("99 Pine Road", "Elmville", "12345")
    rows = [
        ("1", "THALNOVA FREDERICK F", *home), ("2", "Freddy Thalnova", "12 OAK LN", "Elmville", "12345-6789"), ("3", "THLANOVA, FREDERICK", *home), ("4", "THALNOVA SUSAN", *home), ("5", "THALNOVA FREDERICK F", *other),
        ("6", "OAKTON EQUIPMENT LLC", *home), ("7", "OAKTON EQPT", *home), ("8", "OAKTON LEASING LLC", *home), ("9", None, *home), ("10", "TBD", *home), ("1", "THALNOVA FREDERICK F", *home), ("11", "THALNOVA F", *home), ("12", "NOWHERE MAN", None, None, None),
    ]
    assert _groups(spark, rows) == sorted([["1", "11", "2", "3"], ["4"], ["5"], ["6", "7"], ["8"], ["12"]])
    assert _groups(spark, rows[:0]) == []


@pytest.mark.parametrize("text,model", [("Zephora 5 Ultra", "Z5U"), ("utlra zephora V", "Z5U"), ("main assy ZEPH. 05-ULT (rev B)", "Z5U"), ("Zehpora gen 5", "Z5"), ("Zephora 6", None), ("test fixture 5", None), ("", None), ("5 " * 3000, None)])
def test_models(spark, text, model):
    known = spark.createDataFrame([("ZEPHORA 5", "Z5"), ("ZEPHORA 5 ULTRA", "Z5U"), ("CORVANE 5", "C5"), ("CORVANE 5", "C5")], "name string, model string")
    got = name_variants.link_models(spark.createDataFrame([(text,), (None,)], "name string"), known).collect()
    assert [r["model"] for r in got] == ([model] if model else [])


def test_pairs_have_a_small_plan(spark, data):
    """The driver plans the pairs over groups and models that are cut off, not all that led to them several times over."""
    plan = queries.p2_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [") <= 6


# matching


def test_retrieve_equals_brute_force(spark):
    """BM25 by its formula over all pairs in force; every record that reaches the share is found, with its score."""
    import math

    rnd = random.Random(4)
    docs = {f"d{i}": (sorted({rnd.choice("abcdefghij") + str(rnd.randrange(4)) for _ in range(rnd.randrange(3, 8))}), rnd.choice([None, 10, 50]), rnd.choice([None, 60, 90]), rnd.choice(["TX", "VT", None])) for i in range(90)}
    asked = {f"q{i}": (sorted({rnd.choice("abcdefghij") + str(rnd.randrange(4)) for _ in range(6)}), rnd.choice([20, 70, None]), rnd.choice(["TX", None])) for i in range(30)}
    expected = {}
    docs = {k: (v[0] + ([f"state:{v[3]}"] if v[3] else []), *v[1:]) for k, v in docs.items()}
    asked = {k: (v[0] + ([f"state:{v[2]}"] if v[2] else []), *v[1:]) for k, v in asked.items()}
    live = {k: v for k, v in docs.items() if v[1] is not None}
    df = Counter(t for ts, *_ in live.values() for t in ts)
    w = {t: math.log(1 + (len(live) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean, least = sum(len(v[0]) for v in docs.values()) / len(docs), min(len(v[0]) for v in docs.values())
    damp = lambda n: 1 + matching.K1 * (1 - matching.B + matching.B * n / mean)
    for q, (ts, seen, of) in asked.items():
        total = sum(w.get(t, 0) for t in ts)
        for d, (own, since, until, state) in live.items():
            score = damp(least) / damp(len(own)) * sum(w[t] for t in ts if t in own)
            if seen is not None and since <= seen <= (until or 2**62) and (of is None or state is None or of == state) and score >= 0.3 * total:
                expected[q, d] = pytest.approx(score)
    queries = spark.createDataFrame([(k, *v) for k, v in asked.items()], "id string, terms array<string>, seen long, state string")
    records = matching.with_factors(spark.createDataFrame([(k, *v) for k, v in docs.items()], "id string, terms array<string>, since long, until long, state string"))
    assert len(expected) > 30 and {(r["q"], r["d"]): r["score"] for r in matching.retrieve(queries, records, 0.3).collect()} == expected
    best = matching.retrieve(queries, records, 0.3, 1).collect()
    assert len(best) == len({q for q, _ in expected}) and all(r["score"] >= max(s.expected for (q, _), s in expected.items() if q == r["q"]) - 1e-9 for r in best)


def test_retrieve_in_parts(spark, monkeypatch):
    """The index made and what is met scored in many parts give the same as in one; no part leaves its shuffle files."""
    import time

    from siltstone import session

    rnd, made = random.Random(5), []
    draw = lambda n: sorted({rnd.choice("abcdefgh") + str(rnd.randrange(5)) for _ in range(n)})
    docs = [(f"d{i}", draw(7), 10, rnd.choice([None, 60]), rnd.choice(["TX", None])) for i in range(200)]
    asked = [(f"q{i}", draw(rnd.choice([1, 6])), 20, rnd.choice(["TX", None])) for i in range(60)]
    queries = spark.createDataFrame(asked, "id string, terms array<string>, seen long, state string")
    records = matching.with_factors(spark.createDataFrame(docs, "id string, terms array<string>, since long, until long, state string"))
    whole = {tuple(r) for r in matching.retrieve(queries, records, 0.3).collect()}
    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    session.release(spark)
    time.sleep(2)
    before = shuffles().size()

    def counted(parts):
        made.append(0)
        for part in parts:
            made[-1] += 1
            yield part

    monkeypatch.setattr(matching, "POSTINGS", 0)
    monkeypatch.setattr(matching, "CANDIDATES", 0)
    monkeypatch.setattr(matching, "cut_in_parts", lambda parts: session.cut_in_parts(counted(parts)))
    found = matching.retrieve(queries, records, 0.3, few=1000)
    time.sleep(2)
    assert min(made) > 2 and shuffles().size() < before + sum(made)
    assert len(whole) > 30 and {tuple(r) for r in found.collect()} == whole


FAA = "reg_key string, registrant_name string, street string, city string, state_code string, zip_code string, mfr_mdl_code string, year_mfr string, serial_number string, cert_issue_date string, expiration_date string"
IDENTITY = "identity_id long, raw_value string, place_text string, postal_text string, house_number string, model_text string, year_text string, serial_tail string, seen_on string"


def test_match_finds_the_record_in_force_among_many_equal_ones(spark):
    faa = [(f"R{i:02}", "OAKTON EQUIPMENT LLC", "12 Oak Lane", "Elmville", "TX", "12345", "1234567", "1999", f"000{i:04}", f"{1980 + i}0101", f"{1980 + i}1231") for i in range(25)]
    asked = [(i, "OAKTON EQUIPMENT LLC", "Elmville TX", "12345", "12", "123-4567", "1999", None, f"{1980 + i}-06-15") for i in range(25)]
    found = matching.match(spark.createDataFrame(asked, IDENTITY), spark.createDataFrame(faa, FAA))
    assert {r["identity_id"]: r["reg_key"] for r in found.collect()} == {i: f"R{i:02}" for i in range(25)}


def _matched(spark, sf):
    ids, faa = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("er_identity", "faa_master"))
    return ids, faa, {(r["identity_id"], r["reg_key"]): r for r in matching.match(ids, faa).collect()}


def test_match_against_all_pairs(spark):
    """Recall and precision against the check on every pair of the tables, whatever its score."""
    ids, faa, found = _matched(spark, "sf0.01")
    x = matching.identity_records(ids).select(F.col("id").alias("q"), F.struct(*matching.PARTS, "seen").alias("x"))
    y = matching.register_records(faa).select(F.col("id").alias("d"), F.struct(*matching.PARTS, "since", "until").alias("y"))
    near = x.crossJoin(y).where("y.since <= x.seen and x.seen <= coalesce(y.until, 4611686018427387904)")
    agreed = {}
    for q, d in map(tuple, near.withColumn("fits", matching.agreement("x", "y")).where("fits > 0").select("q", "d").collect()):
        agreed.setdefault(q, set()).add(d)
    hits = {q for q, d in found if d in agreed[q]}
    assert len(agreed) > 200 and len(found) == len({q for q, _ in found}) == len(hits) >= 0.995 * len(agreed)


def test_confidence_is_calibrated(spark):
    """Its labels are known by construction; the mean error on held-out queries is small, and it changes the result."""
    ids, faa = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("er_identity", "faa_master"))
    q = matching.identity_records(ids).withColumn("terms", matching.terms(True))
    d = matching.with_factors(matching.register_records(faa).withColumn("terms", matching.terms()).dropDuplicates(["id"])).cache()
    p = matching.practice(q, d).cache()
    found = matching.retrieve(p, d).join(p.select(F.col("id").alias("q"), "origin", "absent"), "q").where("not (absent and d = origin)")
    pairs = matching.compared(found.select("q", "d", "score", "weight"), matching.ALPHA).where("place = 1").join(p.select(F.col("id").alias("q"), "origin"), "q")
    model, error = matching.fit_confidence(pairs.withColumn("label", (F.col("d") == F.col("origin")).cast("double")))
    assert error < 0.06 and all(c > 0 for c in model[:3])


def test_match_after_an_observation(spark, data):
    """Counting in the same session before doesn't keep the fitted confidence from travelling."""
    groups.connected(spark.createDataFrame([(1, 2)], "a long, b long")).count()
    assert queries.p6_found(spark, data).count() > 0


def test_match_of_awkward_rows(spark):
    faa = [("R1", None, None, None, None, None, None, None, None, None, None), ("R2", "OAKTON LLC", "12 Oak", "Elm", "TX", "12345", "11", "1999", "777", "20000101", ""), ("R2", "OAKTON LLC", "12 Oak", "Elm", "TX", "12345", "11", "1999", "777", "20000101", "")]
    asked = [(1, None, None, None, None, None, None, None, None), (2, "x" * 5000, "", "", "", "", "", "", "never"), (3, "OAKTON LLC", "Elm TX", "12345", "12", "11", "1999", "777", "2005-01-01"), (3, "OAKTON LLC", "Elm TX", "12345", "12", "11", "1999", "777", "2005-01-01"), (None, "OAKTON LLC", "Elm TX", "12345", "12", "11", "1999", "777", "2005-01-01")]
    ids = spark.createDataFrame(asked, IDENTITY).withColumn("terms", F.lit("clash")).withColumn("id", F.lit("clash"))
    assert [(r["identity_id"], r["reg_key"]) for r in matching.match(ids, spark.createDataFrame(faa, FAA)).collect()] == [(3, "R2")]


def test_match_empty(spark, data):
    faa, ids = spark.read.parquet(f"{data}/faa_master.parquet"), spark.read.parquet(f"{data}/er_identity.parquet")
    assert matching.match(ids.limit(0), faa).count() == 0
    assert matching.match(ids.limit(5), faa.limit(0)).count() == 0


# packing


@pytest.mark.parametrize("capacity", [1, 7, 100])
def test_pack_shard(capacity):
    rnd = random.Random(capacity)
    sizes = [rnd.randrange(1, capacity + 1) for _ in range(400)]
    load = Counter()
    for s, c in zip(sizes, packing.pack_shard(sizes, capacity), strict=True):
        load[c] += s
    assert max(load.values()) <= capacity
    assert len(load) <= 1.1 * sum(sizes) / capacity + 4
    assert packing.pack_shard([], capacity) == []


def test_sum_of_squares_takes_the_smallest_sum():
    rnd, capacity = random.Random(9), 12
    sizes = [rnd.randrange(1, 13) for _ in range(60)]
    where, load = packing.sum_of_squares(sizes, capacity), {}

    def total(loads):
        return sum(n * n for n in Counter(capacity - v for v in loads.values() if v < capacity).values())

    for s, c in zip(sizes, where, strict=True):
        options = [total({**load, k: load.get(k, 0) + s}) for k in [*load, "new"] if load.get(k, 0) + s <= capacity]
        load[c] = load.get(c, 0) + s
        assert total(load) == min(options)


def test_pack(spark):
    rows = [(1, 5), (2, 23), (3, 10), (4, 0), (5, None), (6, 10), (7, 1), (7, 1), (8, 20)]
    out = packing.pack(spark.createDataFrame(rows, "doc long, n_tokens int").withColumn("container", F.lit("clash")), {1: 10, 2: 100}, "doc", shard_items=4).collect()
    for pack, capacity in ((1, 10), (2, 100)):
        mine = [r for r in out if r["pack_id"] == pack]
        load = Counter()
        for r in mine:
            if r["container"] is not None:
                load[r["container"]] += r["n_tokens"]
        assert max(load.values()) <= capacity
        assert sum(load.values()) == sum(n or 0 for _, n in rows)
        assert {r["doc"] for r in mine} == {d for d, _ in rows}
        assert all(len([r for r in mine if r["doc"] == d]) == 1 for d, n in rows if n and n <= capacity and d != 7)
    assert packing.pack(spark.createDataFrame([], "doc long, n_tokens int"), {1: 10}, "doc").count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(rows, "doc long, n_tokens int"), {1: 0}, "doc")


def test_token_counts(spark):
    enc = tokens.load()
    texts = ["hello world", "", None, "ünïcode 漢字", "a" * 20_000, "<|endoftext|>"]
    out = tokens.with_token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert [r["n_tokens"] for r in out] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


# mixing


def _corpus(spark, sizes):
    rows = [(f"{s}-{i}", s, f"{s} document {i} " + "word " * (5 + i % 9)) for s, n in sizes.items() for i in range(n)]
    rows += [("n1", "a", None), ("n2", "a", ""), ("n3", None, "x"), ("twin", " A ", "a document 0 word word word word word ")]
    return spark.createDataFrame(rows, "doc_id string, source string, text string").withColumn("copies", F.lit("clash"))


def test_mix_meets_targets(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(_corpus(spark, {"a": 300, "b": 80, "c": 90, "other": 50}), targets)
    rows = mixed.collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert not {"n1", "n2", "n3"} & {r["doc_id"] for r in rows} and len({"twin", "a-0"} & {r["doc_id"] for r in rows}) <= 1
    for r in mixing.shares(mixed, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01 and r["most_copies"] <= r["max_repeats"]
    again = mixing.mix(_corpus(spark, {"a": 300, "b": 80, "c": 90, "other": 50}).repartition(5), targets).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_awkward(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("missing", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    docs = _corpus(spark, {"a": 20})
    assert [r["actual_share"] for r in mixing.shares(mixing.mix(docs, targets, total_tokens=10**9), targets).orderBy("source").collect() if r["source"]] == [1.0, 0.0]
    assert mixing.mix(docs.limit(0), targets).count() == 0


# text quality

PROSE = "The engine had been running for an hour when the pilot noticed that the oil pressure was low. We landed at the next field and asked for help."
NOT_PROSE = ["a,b,c\n1,2,3\n4,5,6", "* gasket\n* ring\n* bolt M4", "|x|y|\n|-|-|\n|1|2|", "3fa9c0d1e8b7\n9bb2c3d4e5f6", "<tr><td>A</td></tr>\n<tr><td>B</td></tr>", "Home > Parts\nLog in | Register | Help\nNext Previous Top", "qx zrtp wvk bnm\nplk jhg fds", "=====\n-----"]
LANGUAGES = [PROSE, PROSE.upper(), PROSE.lower(), "Der Motor lief nicht mehr, und wir haben die Pumpe mit dem neuen Teil wieder eingesetzt.", "Le moteur ne tournait plus et nous avons remis la pompe dans la machine.", "El motor ya no funcionaba y la tienda no supo ayudarnos con la bomba."]


@pytest.mark.parametrize("text", LANGUAGES)
def test_prose(text):
    totals = text_stats.finish(text_stats.chunk_state(text, "", ""))
    assert totals[-1] * 2 >= totals[0]


@pytest.mark.parametrize("text", NOT_PROSE)
def test_not_prose(text):
    totals = text_stats.finish(text_stats.chunk_state(text, "", ""))
    assert totals[-1] * 2 < totals[0]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_chunks_equal_whole(size):
    text = "\n".join([*LANGUAGES, *NOT_PROSE, "", "   ", "word's e-mail ((a)) \t x", 'He said "stop." '] * 2)
    whole = text_stats.finish(text_stats.chunk_state(text, "", ""))
    states = [text_stats.chunk_state(text[i : i + size], text[i - 1 : i] if i else "", text[i + size : i + size + text_stats.LOOK_AHEAD]) for i in range(0, len(text), size)]
    left = states[0]
    for s in states[1:]:
        left = text_stats.merge(left, s)
    while len(states) > 1:
        states = [text_stats.merge(*states[i : i + 2]) if len(states[i : i + 2]) == 2 else states[i] for i in range(0, len(states), 2)]
    assert text_stats.finish(left) == whole == text_stats.finish(states[0])


@pytest.mark.parametrize("text,words,digits,items", [("a-b c_d e1f", 6, 1, 0), ("It's 12 o'clock", 4, 2, 0), (" " * 100 + "- x\n(12) y\n[ ] z\n(b) w\n1234) n\na. b", 8, 6, 4), ("", 0, 0, 0), ("Ä ß é²", 3, 0, 0)])
def test_counts_by_hand(text, words, digits, items):
    t = dict(zip(text_stats.TOTALS, text_stats.whole_totals([text])[0], strict=True))
    assert (t["words"], t["digits"], t["list_lines"], t["visible"]) == (words, digits, items, len("".join(text.split())))


def test_whole_texts_equal_pieces_counted_by_pattern():
    """Against a plain reading of the same definitions with patterns."""
    import re

    texts = [*LANGUAGES, *NOT_PROSE, PROSE * 50, "x" * 70_000 + " the"]
    for text, got in zip(texts, text_stats.whole_totals(texts), strict=True):
        found = re.findall(r"[^\W\d_]+", text)
        assert got[5] == len(found) and got[6] == sum(w.lower() in text_stats.COMMON_WORDS for w in found)
        assert got[0] == len(re.sub(r"\s", "", text)) and got[1] == len("".join(found)) and got[4] == sum(text.count(c) for c in "|;\t<>")


def test_text_quality(spark):
    long = (PROSE + "\n") * 4000
    rows = [(1, PROSE), (2, None), (3, "  "), (4, ""), (5, long), (6, NOT_PROSE[0]), (7, "x" * 300_000), (1, PROSE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("doc", F.lit("clash"))
    out = {r["doc_id"]: r for r in text_stats.text_quality(df.distinct()).collect()}
    assert {k: r["kind"] for k, r in out.items()} == {1: "prose", 2: "empty", 3: "empty", 4: "empty", 5: "prose", 6: "not_prose", 7: "not_prose"}
    assert out[5]["n_words"] == 4000 * out[1]["n_words"] and out[5]["n_lines"] == 4000
    assert text_stats.text_quality(df.limit(0)).count() == 0
    # rows with one key and long texts stay apart
    twice = spark.createDataFrame([(1, long), (1, "x" * 20_000), (1, long)], "doc_id long, text string")
    assert sorted(r["n_words"] for r in text_stats.text_quality(twice).collect()) == [1, out[5]["n_words"], out[5]["n_words"]]


def test_time_is_proportional_to_a_texts_length(spark):
    import time

    def seconds(n):
        began = time.perf_counter()
        text_stats.text_quality(spark.createDataFrame([(1, (PROSE + "\n") * n)], "doc_id long, text string")).collect()
        return time.perf_counter() - began

    size = 2_000_000 // len(PROSE)
    seconds(size)
    assert seconds(8 * size) < 12 * seconds(size) + 5
