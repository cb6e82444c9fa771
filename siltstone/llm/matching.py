"""Matching entities across sources without keys.

Every record of both tables becomes a set of terms, one or more for each attribute it has (parsed name, parts of the
name, city, state, postal code, house number, model, year, end of the serial number). Records are retrieved by BM25 over
an inverted index of these terms: a term stands once in a record, so its frequency in it is 1, and the score of a record
is the sum of the shared terms' inverse document frequencies times a factor that falls with the record's number of
terms (scaled so that it is 1 at most). Only records in force when the query was seen, of no other state, and with at
least ALPHA of the query's own weight, are matches at all. That makes pruning exact: if the most common terms of a query and its single
heaviest one together stay below this, a record that reaches it shares at least two of the other, rarer terms. The index
therefore holds pairs of terms, is made part by part, and is only read for pairs of rarer ones; what is met is scored with all terms. A query
whose heaviest term alone is enough reads the postings of single terms. The state, the most common term of nearly all
queries, always counts as common, so it is in no pair.

A pair is mutual if the record's own best query points back to it. The confidence of a query's best record comes from its
share of the query's weight, its gap to the next and mutuality, through a logistic model. The model learns from
queries made of a bounded sample of the records themselves, with attributes lost and exchanged as often as in real
queries, and with the record itself missing for a third of them; so what is right is known by construction, not from
the rule below. Of the retrieved records an exact check rules out those whose attributes contradict the query; the
best of the rest by score is the match, if the attributes confirm it or its confidence is not below CONFIDENT or it is
mutual.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import fold, micros, parse_day, present
from siltstone.llm.name_variants import near, parsed_names
from siltstone.session import cut, cut_counting, cut_in_parts, discard, release

#: Least share of a query's own weight: less in common is no match.
ALPHA = 0.25
#: BM25's k1 and b.
K1, B = 1.2, 0.2
#: Records of which queries are made to fit the confidence, at most about twice this.
TRAIN_ROWS = 3_000
#: How often an attribute of such a query is that of another record.
EXCHANGED = 0.08
#: Least confidence of a match that the attributes don't confirm and that isn't mutual.
CONFIDENT = 0.05
#: Postings that stand on disk at a time for each record and query, and candidates that are scored at a time; up to FEW
#: of either in all, one part is cheaper.
POSTINGS, CANDIDATES, FEW = 6, 1, 250_000

PARTS = ["kind", "core", "given", "middle", "generation", "state", "city", "post", "number", "model", "year", "serial"]


def _letters(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), r"[^\p{L}]+", "")
    return F.when(t != "", t)


def _digits(c: Column) -> Column:
    t = F.regexp_replace(c, r"[^0-9]+", "")
    return F.when(t != "", t)


def _with_names(df: DataFrame) -> DataFrame:
    names = parsed_names(df.where("name is not null"))
    # small files hold many names: a file's size would have them broadcast
    return df.join(names.hint("merge"), "name", "left")


def register_records(faa: DataFrame) -> DataFrame:
    """Records in the common form, one per key: id, PARTS, since and until (days in force, in microseconds)."""
    c = lambda n: present(F.col(n))
    rows = faa.select(
        F.col("reg_key").cast("string").alias("id"), fold(c("registrant_name")).alias("name"),
        fold(c("state_code")).alias("state"), _letters(c("city")).alias("city"), F.substring(_digits(c("zip_code")), 1, 5).alias("post"),
        F.when(c("street").rlike(r"^\s*\d"), F.regexp_extract(c("street"), r"^\s*(\d+)", 1)).alias("number"),
        _digits(c("mfr_mdl_code")).alias("model"), _digits(c("year_mfr")).alias("year"), _digits(c("serial_number")).alias("serial"),
        micros(parse_day(F.col("cert_issue_date"))).alias("since"), (micros(parse_day(F.col("expiration_date"))) + 86_399_999_999).alias("until"),
    ).distinct()
    return _with_names(rows)


def identity_records(rows: DataFrame) -> DataFrame:
    """Queries in the common form: id, PARTS, seen (microseconds)."""
    c = lambda n: present(F.col(n))
    place = F.upper(c("place_text"))
    state = F.when(place.rlike(r"(^|[ ,])[A-Z]{2}\s*$"), F.regexp_extract(place, r"([A-Z]{2})\s*$", 1))
    city = F.when(state.isNotNull(), F.regexp_replace(place, r"[A-Z]{2}\s*$", "")).otherwise(place)
    rows = rows.select(
        F.col("identity_id").alias("id"), fold(c("raw_value")).alias("name"), state.alias("state"), _letters(city).alias("city"),
        F.substring(_digits(c("postal_text")), 1, 5).alias("post"), _digits(c("house_number")).alias("number"), _digits(c("model_text")).alias("model"),
        _digits(c("year_text")).alias("year"), _digits(c("serial_tail")).alias("serial"), micros(parse_day(F.col("seen_on"))).alias("seen"),
    ).where("id is not null").dropDuplicates(["id"])
    return _with_names(rows)


def terms(query: bool = False) -> Column:
    """The terms of a record, each once. A query with a whole postal code doesn't ask for its first digits as well."""
    def term(mark: str, c: Column) -> Column:
        return F.concat(F.lit(mark + ":"), c)

    core, post = F.when(F.col("core") != "", F.col("core")), F.col("post")
    each = [
        term("name", core), term("head", F.substring(core, 1, 5)), term("tail", F.expr("right(nullif(core, ''), 5)")),
        term("given", F.when(F.length("given") > 1, F.col("given"))), term("state", F.col("state")), term("city", F.col("city")),
        term("zip", F.when(F.length(post) == 5, post)), term("zone", F.when(F.lit(not query) | (F.length(post) < 5), F.substring(post, 1, 3))), term("number", F.col("number")),
        term("model", F.col("model")), term("year", F.col("year")), term("serial", F.expr("right(serial, 4)")),
    ]
    return F.array_distinct(F.array_compact(F.array(*each)))


def _few(key: Column, bits: int = 40) -> Column:
    """A hash of an id, short as it stands in every posting; ids of the same hash only add candidates."""
    return F.xxhash64(key).bitwiseAND(F.lit(2**bits - 1))


def _day(c: Column) -> Column:
    return F.floor(c / 86_400_000_000).cast("int")


def _keys(singles: Column, halves: Column, part: int, parts: int) -> Column:
    """What one of the parts of the index holds of a record or query: its single terms and its pairs of terms, as hashes,
    by their smaller term; equal hashes of unequal terms or pairs only add candidates."""
    mine = lambda t: F.pmod(t, F.lit(parts)) == part
    of = lambda x: F.transform(F.filter(halves, lambda y: y > x), lambda y: F.xxhash64(x, y))
    return F.concat(F.filter(singles, mine), F.flatten(F.transform(F.filter(halves, mine), of)))


def _hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _pairable(terms: Column) -> Column:
    return F.filter(terms, lambda t: ~t.startswith("state:"))


def weights(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(q, term, w): the terms of each query that the index has, with their weights."""
    n = records.count()
    frequency = records.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).hint("merge")
    weight = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return queries.select(F.col("id").alias("q"), F.explode("terms").alias("term")).join(frequency, "term").select("q", "term", weight.alias("w"))


def with_factors(records: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """records with factor: BM25's (k1 + 1) / (1 + k1 * (1 - b + b * length / mean length)), divided by its largest
    value in the table."""
    mean, least = records.agg(F.avg(F.size("terms")), F.min(F.size("terms"))).first()
    damp = lambda n: 1 + k1 * (1 - b + b * n / (mean or 1.0))
    return records.withColumn("factor", F.lit(damp(max(least or 0, 0))) / damp(F.greatest(F.size("terms"), F.lit(0))))


def score(pairs: DataFrame, asked: DataFrame, records: DataFrame) -> DataFrame:
    """pairs (hq, hd) as (q, d) with score and weight, of records in force and of no other state. A query's terms are
    summed in one order, so equal records tie exactly."""
    shared = F.filter("asked", lambda x: F.array_contains(F.col("terms"), x["term"]))
    queries = asked.select("hq", "q", "seen", "of", "asked", "weight").hint("merge")
    held = records.select(_few(F.col("id")).alias("hd"), F.col("id").alias("d"), "since", "until", "state", "terms", "factor").hint("merge")
    possible = (F.col("since") <= F.col("seen")) & (F.col("seen") <= F.coalesce("until", F.lit(2**62))) & F.coalesce(F.col("state") == F.col("of"), F.lit(True))
    scored = pairs.join(queries, "hq").join(held, "hd").where(possible)
    return scored.select("q", "d", (F.col("factor") * F.aggregate(shared, F.lit(0.0), lambda a, x: a + x["w"])).alias("score"), "weight")


def asked_of(queries: DataFrame, records: DataFrame, alpha: float) -> DataFrame:
    """A row for each query that shares a term with the index and was seen: q, hq, seen, of (its state), asked (its terms
    and their weights), weight, and by which hashes of terms it reads the index: singles, or halves of pairs."""
    asked = weights(queries, records).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("asked"))
    asked = asked.join(queries.select(F.col("id").alias("q"), "seen", F.col("state").alias("of")).where("seen is not null").hint("merge"), "q")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["w"])
    of_state = lambda x: x["term"].startswith("state:")
    asked = asked.withColumn("weight", total("asked")).withColumn("place", total(F.filter("asked", of_state)))
    asked = asked.withColumn("most", F.coalesce(F.array_max(F.transform(F.filter("asked", lambda x: ~of_state(x)), lambda x: x["w"])), F.lit(0.0)))
    rising = F.array_sort(F.transform("asked", lambda x: F.struct((~of_state(x)).alias("other"), x["w"].alias("w"), x["term"].alias("term"))))
    asked = asked.withColumn("rising", rising).withColumn("rising", F.transform("rising", lambda x, i: F.struct(x["term"].alias("term"), total(F.slice("rising", F.lit(1), i + 1)).alias("common"))))
    least = F.lit(alpha * (1 - 1e-9)) * F.col("weight")  # sums in another order differ in their last bits
    rarer = lambda beside: F.transform(F.filter("rising", lambda x: x["common"] + beside >= least), lambda x: x["term"])
    lone, none = F.col("place") + F.col("most") >= least, F.array().cast("array<bigint>")
    singles, halves = F.when(lone, _hashes(rarer(F.lit(0.0)))).otherwise(none), F.when(lone, none).otherwise(_hashes(_pairable(rarer(F.col("most")))))
    return asked.select("q", _few(F.col("q")).alias("hq"), "seen", "of", "asked", "weight", singles.alias("singles"), halves.alias("halves"))


def retrieve(queries: DataFrame, records: DataFrame, alpha: float = ALPHA, top: int | None = None, few: int = FEW) -> DataFrame:
    """(q, d, score, weight): for each query the records that reach alpha of the query's own weight, all of them, or the
    best top, ties by id.

    queries: id, terms, seen and state; records: id, terms, factor (as with_factors), since, until and state. A record is
    only met while it is in force: since <= seen <= until, a null until is open; and if the states don't differ. weight is the sum over the query's terms that
    the index has. Queries that share no such record have no row.

    The index is never there as a whole: it is made and read in parts, each of at most few postings or POSTINGS for each
    record and query, and what is met is scored in parts as well. So the disk holds a bounded multiple of the tables.
    """
    records = records.where("since is not null")
    pairs_of = lambda c: F.size(c) * (F.size(c) - 1) / 2
    asked, sought = cut_counting(asked_of(queries, records, alpha), rows=F.lit(1), singles=F.size("singles"), pairs=pairs_of("halves"))
    release(records.sparkSession)
    held = records.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("singles"), F.sum(pairs_of(_pairable(F.col("terms")))).alias("pairs")).first()
    rows = held["rows"] + sought["rows"]
    postings = sum(sought[k] + (held[k] or 0) for k in ("singles", "pairs") if sought[k])
    # records in the index by what queries seek at all
    own = [_hashes(F.col("terms")) if sought["singles"] else F.array().cast("array<bigint>"), _hashes(_pairable(F.col("terms"))) if sought["pairs"] else F.array().cast("array<bigint>")]
    span = [_day(F.col("since")).alias("first"), F.coalesce(_day(F.col("until")), F.lit(2**31 - 1)).alias("last"), F.hash("state").alias("state"), F.col("state").isNull().alias("anywhere")]
    index = records.select(_few(F.col("id")).alias("hd"), *span, own[0].alias("singles"), own[1].alias("halves"))
    readers = asked.select("hq", _day(F.col("seen")).alias("day"), F.when(F.col("of").isNotNull(), F.hash("of")).alias("of"), "singles", "halves")
    possible = (F.col("first") <= F.col("day")) & (F.col("day") <= F.col("last")) & (F.col("anywhere") | F.coalesce(F.col("state") == F.col("of"), F.lit(True)))

    def met(part: int, parts: int) -> DataFrame:
        keys = F.explode(_keys(F.col("singles"), F.col("halves"), part, parts)).alias("key")
        x = readers.select("hq", "day", "of", keys)
        return x.join(index.select("hd", "first", "last", "state", "anywhere", keys).hint("merge"), "key").where(possible).select("hq", "hd").distinct()

    parts = max(1, math.ceil(postings / max(few, POSTINGS * rows)))
    candidates = cut_in_parts(met(i, parts) for i in range(parts))
    rounds = max(1, math.ceil(candidates.count() / max(few, CANDIDATES * rows)))
    chosen = lambda df, i: df.where(F.pmod("hq", F.lit(rounds)) == i)
    scored = cut_in_parts(score(chosen(candidates, i).distinct(), chosen(asked, i), records).where(F.col("score") >= alpha * F.col("weight")) for i in range(rounds))
    discard(candidates)
    discard(asked)
    if top is None:
        return scored
    order = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def agreement(q: str = "q", d: str = "d") -> Column:
    """Whether the attributes of query and record fit: 0 they contradict each other, 1 they may, 2 they do.

    Names agree up to a few edits, given names may be initials; a record without a name needs its place to agree.
    Nothing about the place may differ, postal codes may be shortened. Model or end of serial number agree, not more
    than one of the aircraft's attributes differs, where a year is off by one it counts as agreeing; the query was seen
    while the record was in force.
    """
    x, y = (lambda c: F.col(f"{q}.{c}")), (lambda c: F.col(f"{d}.{c}"))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    given_x, given_y = F.coalesce(x("given"), F.lit("")), F.coalesce(y("given"), F.lit(""))
    initial = F.least(F.length(given_x), F.length(given_y)) <= 1
    given = (given_x == "") | (given_y == "") | F.when(initial, F.substring(given_x, 1, 1) == F.substring(given_y, 1, 1)).otherwise((given_x == given_y) | near(given_x, given_y, 2))
    middle = (x("middle") == "") | (y("middle") == "") | (x("middle") == y("middle"))
    generation = (x("generation") == y("generation")) | (x("generation") == "?") | (y("generation") == "?")
    long = F.least(F.length(x("core")), F.length(y("core")))
    core = F.levenshtein(x("core"), y("core")) <= F.when(long >= 12, F.lit(4)).when(long >= 6, F.lit(3)).otherwise(F.lit(1))
    told = y("core").isNotNull() & (y("core") != "") & x("core").isNotNull() & (x("core") != "")
    name = F.when(told, (x("kind") == y("kind")) & core & ((x("kind") == "org") | (given & middle & generation)))
    state, number = x("state") == y("state"), x("number") == y("number")
    city = near(x("city"), y("city"), 3)
    post = y("post").startswith(x("post")) | x("post").startswith(y("post"))
    places = [state, city, post, number]
    place_ok = ~F.coalesce(~state, F.lit(False)) & ~F.coalesce(~city, F.lit(False)) & ~F.coalesce(~post, F.lit(False)) & ~F.coalesce(~number, F.lit(False))
    place_n = sum((one(p) for p in places), F.lit(0))
    model, serial = x("model") == y("model"), y("serial").endswith(x("serial")) | x("serial").endswith(y("serial"))
    apart = F.abs(x("year").try_cast("int") - y("year").try_cast("int"))
    plus = one(model) + one(serial) + one(apart <= 1)
    minus = one(~model) + one(~serial) + one(apart > 1)
    aircraft = (one(model) + one(serial) >= 1) & ((minus == 0) | ((minus == 1) & (plus == 2)))
    in_force = F.coalesce((y("since") <= x("seen")) & (x("seen") <= F.coalesce(y("until"), F.lit(2**62))), F.lit(False))
    fits = aircraft & place_ok & in_force & F.coalesce(name, place_n >= 2)
    return F.when(~F.coalesce(fits, F.lit(False)), 0).when((plus >= 2) & (minus == 0) & F.coalesce(name, F.lit(False)), 2).otherwise(1)


def practice(queries: DataFrame, records: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, terms, seen, state, origin, absent): queries made of a hash sample of records. Each kind of term is kept as often as
    the real queries have one that the index knows; some are those of another record. absent: the query's own record
    is to be left out."""
    kind = lambda t: F.substring_index(t, ":", 1)
    n, total = records.count(), queries.count()
    known = weights(queries, records).groupBy(kind(F.col("term")).alias("kind")).agg(F.count_distinct("q").alias("n")).collect()  # a row a kind of term
    if not known or not total:
        return records.limit(0).select("id", "terms", F.col("since").alias("seen"), "state", F.col("id").alias("origin"), F.lit(False).alias("absent"))
    rates = F.create_map(*[F.lit(x) for r in known for x in (r["kind"], r["n"] / total)])
    drawn = records.where((F.col("since").isNotNull()) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // rows))) == 0))
    # the sample is bounded; its rows are paired up in groups by another hash
    beside = Window.partitionBy(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(64))).orderBy(F.xxhash64("id", F.lit(5)))
    drawn = drawn.withColumn("other", F.coalesce(F.lead("terms").over(beside), F.col("terms")))
    chance = lambda t, seed: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(1000)) / 1000
    kept = F.filter("terms", lambda t: chance(t, 6) < F.coalesce(F.try_element_at(rates, kind(t)), F.lit(0.0)))
    said = F.transform(kept, lambda t: F.when(chance(t, 7) < EXCHANGED, F.coalesce(F.get(F.filter("other", lambda o: kind(o) == kind(t)), 0), t)).otherwise(t))
    return drawn.select(F.concat(F.lit("practice:"), "id").alias("id"), F.array_distinct(said).alias("terms"), (F.col("since") + 1).alias("seen"), F.when(F.array_contains(said, F.concat(F.lit("state:"), "state")), F.col("state")).alias("state"), F.col("id").alias("origin"), (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(3)) == 0).alias("absent"))


def compared(found: DataFrame, alpha: float) -> DataFrame:
    """found (q, d, score, weight) with place, share, gap, mutual and features. A runner-up below alpha isn't retrieved and
    may stand anywhere below it, so gaps are counted down to alpha only; records behind the best have a gap below 0."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    placed = found.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).withColumn("first", F.first("score").over(order))
    back = placed.groupBy("d").agg(F.max_by("q", F.struct("score", "q")).alias("back"))
    placed = placed.join(back, "d").withColumn("mutual", (F.col("back") == F.col("q")) & (F.col("place") == 1))
    share = lambda c: F.coalesce(F.try_divide(c, F.col("weight")), F.lit(0.0))
    against = F.when(F.col("place") == 1, F.greatest(F.coalesce("next", F.lit(0.0)), alpha * F.col("weight"))).otherwise(F.col("first"))
    placed = placed.select("q", "d", "place", "mutual", share(F.col("score")).alias("share"), share(F.col("score") - against).alias("gap"))
    return VectorAssembler(inputCols=["share", "gap", "back"], outputCol="features").transform(placed.withColumn("back", F.col("mutual").cast("double")))


def confidence_of(weights: list[float]) -> Column:
    """The logistic function of share, gap and mutuality; the last weight stands alone. An expression, as a fitted model
    drags its session along, which doesn't travel once that has observed anything."""
    *each, alone = weights
    return 1 / (1 + F.exp(-(alone + sum((w * F.col(c) for w, c in zip(each, ("share", "gap", "back"), strict=True)), F.lit(0.0)))))


def fit_confidence(practised: DataFrame) -> tuple[list[float] | None, float | None]:
    """The weights of a logistic model fitted on practised (share, gap, back, features, label), three quarters of them, and
    its mean calibration error on the rest in ten bands of confidence; (None, None) where all labels are equal or none
    are there."""
    rows = practised.select("share", "gap", "back", "features", "label", F.pmod(F.xxhash64("q", F.lit(9)), F.lit(4)).alias("fold")).cache()
    if rows.where("fold > 0").select("label").distinct().count() < 2:
        rows.unpersist()
        return None, None
    model = LogisticRegression(maxIter=25, regParam=1e-4).fit(rows.where("fold > 0"))
    fitted = [float(c) for c in model.coefficients] + [float(model.intercept)]
    held = rows.where("fold = 0").withColumn("p", confidence_of(fitted))
    bands = held.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9))).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("label")).alias("off"))
    error = bands.agg(F.sum(F.col("n") * F.col("off")) / F.sum("n")).first()[0]
    rows.unpersist()
    return fitted, error


def match(identities: DataFrame, register: DataFrame, alpha: float = ALPHA, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(identity_id, reg_key, confidence, mutual, fits): the record that each identity row describes, or no row.

    fits: as agreement, 2 where the attributes confirm the match, 1 where they only don't contradict it; such a match
    needs the confidence, or to be mutual. Without a model (nothing to learn from) the confidence is null and
    counts as high. At most one row per identity. Rows that repeat an identity's id count once; of rows that repeat a
    record's key each counts.
    """
    q = cut(identity_records(identities).withColumn("terms", terms(True)).withColumn("id", F.col("id").cast("string")))
    release(q.sparkSession)
    d = register_records(register).where("id is not null").withColumn("terms", terms()).withColumn("reg_key", F.col("id"))
    d = d.withColumn("id", F.concat_ws("|", "reg_key", F.hex(F.xxhash64(*[c for c in d.columns if c != "terms"]))))
    d = with_factors(cut(d))
    release(d.sparkSession)
    p = cut(practice(q, d, train_rows))
    release(d.sparkSession)
    both = q.select("id", "terms", "seen", "state").unionByName(p.select("id", "terms", "seen", "state"))
    found = retrieve(both, d, alpha)
    made = F.col("q").startswith("practice:")
    own = p.select(F.col("id").alias("q"), "origin", "absent")
    practised = found.where(made).join(own, "q").where(~(F.col("absent") & (F.col("d") == F.col("origin"))))
    practised = compared(practised.select("q", "d", "score", "weight"), alpha).where("place = 1").join(own, "q").withColumn("label", (F.col("d") == F.col("origin")).cast("double"))
    model, _ = fit_confidence(practised)
    pairs = cut(compared(found.where(~made), alpha))
    discard(found)
    discard(p)
    release(d.sparkSession)
    pairs = pairs.withColumn("confidence", F.lit(None).cast("double") if model is None else confidence_of(model))
    pairs = pairs.select("q", "d", "place", "mutual", "confidence")
    pairs = pairs.join(q.select(F.col("id").alias("q"), F.struct(*PARTS, "seen").alias("x")).hint("merge"), "q").join(d.select(F.col("id").alias("d"), "reg_key", F.struct(*PARTS, "since", "until").alias("y")).hint("merge"), "d")
    checked = pairs.withColumn("fits", agreement("x", "y")).where("fits > 0")
    best = checked.groupBy("q").agg(F.min_by(F.struct("reg_key", "confidence", "mutual", "fits"), F.struct("place", "reg_key")).alias("m")).select("q", "m.*")
    id_type = identities.schema["identity_id"].dataType
    return best.where(F.col("mutual") | (F.col("fits") == 2) | (F.coalesce("confidence", F.lit(1.0)) >= CONFIDENT)).select(F.col("q").cast(id_type).alias("identity_id"), "reg_key", "confidence", "mutual", "fits")
