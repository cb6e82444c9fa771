"""Signals of a relationship between two columns, their fusion into a confidence, and the type of the relationship.

The distinct values of all columns stand in one table (column, value, count), written once; every signal is an aggregation
over it or over a join of it with the pairs asked about, on all values, whatever the number of pairs. What is left is a row
for each pair, on which column expressions decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import profile
from siltstone.operators.dependencies import name_similarity
from siltstone.session import cut

# Weights of the signals in the fused confidence, and the components of the candidate score.
WEIGHTS = {"containment_lr": 0.30, "containment_rl": 0.30, "jaccard": 0.15, "rare_tokens": 0.12, "divergence": 0.35, "cardinality": 0.05, "key_uniqueness": 0.20, "entropy": 0.05, "name": 0.05, "type": 0.10, "shared_values": 0.10}
CANDIDATE = {"containment": 0.40, "key_uniqueness": 0.25, "cardinality": 0.15, "type": 0.15, "name": 0.05}
DECILES = [i / 10 for i in range(11)]
GROUPS = {"boolean": "boolean", "integer": "numeric", "float": "numeric", "string": "string", "text": "string", "date": "date", "datetime": "datetime"}
#: A table of at most so many rows, or distinct values per column, is small.
SMALL = 64
#: The transforms that are tried, in this order.
TRANSFORMS = ["uppercase", "lowercase", "strip", "first_token", "prefix_3", "drop_trailing_digits"]


def column_values(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(col, value, n): the distinct values of the given columns as texts, 'table.column' each, and how often they occur."""
    parts = None
    for t, (df, columns) in tables.items():
        each = F.explode(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
        part = df.select(each.alias("x")).select("x.*").where("value is not null").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def datatypes(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, str]:
    """The datatype of each column: that of the schema, of texts the one inferred from their values."""
    kinds = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    out = {}
    for t, (df, columns) in tables.items():
        types = dict(df.dtypes)
        out |= {f"{t}.{c}": kinds.get(types[c], "float") for c in columns if types[c] != "string"}
        texts = [c for c in columns if types[c] == "string"]
        if texts:
            out |= {f"{t}.{r['column']}": r["datatype"] for r in profile.profile_columns(df, texts).select("column", "datatype").collect()}  # a row a column
    return out


def column_facts(values: DataFrame) -> DataFrame:
    """Per column: non_null, distinct, entropy (of its values' shares, over that of equal shares), deciles."""
    totals = values.groupBy("col").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    entropy = F.when(F.col("distinct") > 1, (F.ln("non_null") - F.col("nln") / F.col("non_null")) / F.ln("distinct")).otherwise(0.0)
    return totals.select("col", "non_null", "distinct", entropy.alias("entropy"))


def _quantiles(values: DataFrame, types: dict[str, str]) -> dict[str, list[float]]:
    """Deciles of the numeric columns: eleven rows a column."""
    numbers = [c for c, t in types.items() if GROUPS.get(t) == "numeric"]
    counts = values.where(F.col("col").isin(numbers)).select(F.col("col").alias("column"), F.col("value").try_cast("double").alias("value"), "n").where("value is not null")
    out: dict[str, list[float]] = {}
    for r in profile.exact_quantiles(counts, DECILES).orderBy("column", "i").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out


def trigram_similarity(a: str, b: str) -> float:
    """Dice coefficient of the character trigrams of two names, two blanks before and one behind."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    x, y = ({p[i : i + 3] for i in range(len(p) - 2)} for p in (f"  {a} ", f"  {b} "))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def quantile_divergence(a: list[float] | None, b: list[float] | None) -> float:
    """Mean gap of the deciles over the width of both: 1 if a side has none, or the width is 0 and they differ."""
    if not a or not b or len(a) != len(b):
        return 1.0
    width, gap = max(a[-1], b[-1]) - min(a[0], b[0]), sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, gap / width) if width > 0 else float(gap > 0)


def _overlap(values: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, common, js): common values, and the Jensen-Shannon divergence in bits. Values of one side only add
    half their share to it, so only common ones are joined."""
    shares = values.join(F.broadcast(facts.select("col", "non_null")), "col").select("col", "value", (F.col("n") / F.col("non_null")).alias("p"))
    a = shares.join(F.broadcast(pairs), F.col("col") == F.col("left")).select("left", "right", "value", "p")
    b = shares.select(F.col("col").alias("right"), "value", F.col("p").alias("q"))
    p, q = F.col("p"), F.col("q")
    term = 0.5 * p * F.log2(2 * p / (p + q)) + 0.5 * q * F.log2(2 * q / (p + q))
    met = a.join(b, ["right", "value"]).groupBy("left", "right").agg(F.count(F.lit(1)).alias("common"), F.sum(term - 0.5 * (p + q)).alias("js"))
    return pairs.join(met, ["left", "right"], "left").select("left", "right", F.coalesce("common", F.lit(0)).alias("common"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 + F.coalesce("js", F.lit(0.0)))).alias("js"))


def _rare_tokens(values: DataFrame, facts: DataFrame, pairs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(left, right, rare_tokens): Jaccard of the tokens that at most fraction of the distinct values of both sides hold."""
    words = F.array_distinct(F.filter(F.split(F.lower("value"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))
    frequency = values.select("col", F.explode(words).alias("token")).groupBy("col", "token").agg(F.count(F.lit(1)).alias("df"))
    size = facts.select("col", "distinct")
    docs = pairs.join(size.withColumnRenamed("col", "left").withColumnRenamed("distinct", "l"), "left").join(size.withColumnRenamed("col", "right").withColumnRenamed("distinct", "r"), "right")
    docs = docs.select("left", "right", F.greatest(F.lit(1), F.floor(fraction * (F.col("l") + F.col("r")))).alias("most"))
    side = lambda name: frequency.withColumnRenamed("col", name).join(F.broadcast(docs), name).select("left", "right", "most", "token", "df", F.lit(int(name == "left")).alias("a"), F.lit(int(name == "right")).alias("b"))
    each = side("left").unionByName(side("right")).groupBy("left", "right", "token").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.max("a").alias("a"), F.max("b").alias("b")).where("df <= most")
    sums = each.groupBy("left", "right").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.count(F.lit(1)).alias("any"))
    return sums.select("left", "right", (F.col("both") / F.col("any")).alias("rare_tokens"))


def _transformed(values: DataFrame, pairs: DataFrame, fire_at: float = 0.9) -> DataFrame:
    """(left, right, transform): the first transform that takes nearly all values of right to values of left, and changes
    at least half of them."""
    v = F.col("value")
    forms = [F.upper(v), F.lower(v), F.trim(v), F.coalesce(F.regexp_extract(v, r"^\s*(\S+)", 1), v), F.substring(v, 1, 3), F.regexp_replace(v, r"[0-9]+$", "")]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f.alias("t"), (f != v).cast("int").alias("changed")) for i, f in enumerate(forms)]))
    made = values.join(F.broadcast(pairs), F.col("col") == F.col("right")).select("left", "right", each.alias("x")).select("left", "right", "x.*")
    held = values.select(F.col("col").alias("left"), F.col("value").alias("t"), F.lit(1).alias("hit"))
    counts = made.join(held, ["left", "t"], "left").groupBy("left", "right", "i").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("hits"), F.avg("changed").alias("changed"))
    names = F.array(*[F.lit(t) for t in TRANSFORMS])
    return counts.where((F.col("hits") >= fire_at) & (F.col("changed") >= 0.5)).groupBy("left", "right").agg(F.get(names, F.min("i")).alias("transform"))


def signals(tables: dict[str, tuple[DataFrame, Sequence[str]]], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each ordered pair of columns (left refers, right is referred to; 'table.column'): all signals, each 0 to
    1, the conflicts, and the transform that takes right to left, if any. Without pairs, those of columns of different
    tables whose types may be compared. Null values take no part; a column of nulls only has no row."""
    spark = next(iter(tables.values()))[0].sparkSession
    types = datatypes(tables)
    group = lambda c: GROUPS.get(types[c])
    if pairs is None:
        pairs = [(a, b) for a in types for b in types if a.split(".")[0] != b.split(".")[0] and group(a) == group(b)]
    values = cut(column_values(tables))
    quantiles = _quantiles(values, types)
    rows = []
    for a, b in pairs:
        x, y = a.rsplit(".", 1)[1], b.rsplit(".", 1)[1]
        trigrams = trigram_similarity(x, y)
        numeric = group(a) == group(b) == "numeric"
        fit = 1.0 if types[a] == types[b] else 0.6 if group(a) is not None and group(a) == group(b) else 0.0
        rows.append((a, b, max(float(x.lower() == y.lower()), name_similarity(x, y), trigrams), trigrams, fit, quantile_divergence(quantiles.get(a), quantiles.get(b)) if numeric else None))
    asked = spark.createDataFrame(rows, "left string, right string, name double, trigrams double, type double, quantile_gap double")
    facts = cut(column_facts(values))
    plain = asked.select("left", "right")
    side = lambda s: F.broadcast(facts.select(F.col("col").alias(s), F.col("non_null").alias(f"{s}_rows"), F.col("distinct").alias(f"{s}_distinct"), F.col("entropy").alias(f"{s}_entropy")))
    s = asked.join(side("left"), "left").join(side("right"), "right").join(_overlap(values, facts, plain), ["left", "right"])
    s = s.join(_rare_tokens(values, facts, plain), ["left", "right"], "left").join(_transformed(values, plain), ["left", "right"], "left")
    c, ld, rd = F.col("common"), F.col("left_distinct"), F.col("right_distinct")
    jaccard = c / (ld + rd - c)
    s = s.select(
        "left", "right", "left_distinct", "right_distinct", "right_rows", (c / ld).alias("containment_lr"), (c / rd).alias("containment_rl"), jaccard.alias("jaccard"), F.coalesce("rare_tokens", F.lit(0.0)).alias("rare_tokens"),
        F.coalesce("quantile_gap", "js").alias("divergence"), (F.least(ld, rd) / F.greatest(ld, rd)).alias("cardinality"), (rd / F.col("right_rows")).alias("key_uniqueness"), (ld / F.col("left_rows")).alias("left_uniqueness"),
        F.col("left_entropy").alias("entropy"), "name", "type", jaccard.alias("shared_values"), "trigrams", "transform",
    )
    return s.withColumns({
        "containment_conflict": (F.col("containment_lr") < 0.4) & (F.col("trigrams") >= 0.6), "divergence_conflict": F.col("divergence") >= 0.5, "key_conflict": (F.col("key_uniqueness") < 0.98) & (rd > 1),
        "entropy_conflict": F.col("entropy") < 0.25, "type_conflict": F.col("type") == 0.0,
    })


def recovers_formats() -> Column:
    """Rare tokens agree where the values as they stand don't: the sides differ by format only."""
    return (F.col("rare_tokens") >= 0.5) & (F.greatest("containment_lr", "containment_rl") <= 0.5)


def fused_confidence(profile_weights: dict[str, float] | None = None) -> Column:
    """The confidence of a pair from its signals. profile_weights multiply the weights of positive evidence; divergence,
    types and low entropy always count in full."""
    w = {k: v * (profile_weights or {}).get(k, 1.0) for k, v in WEIGHTS.items()}
    v = {k: F.col(k) for k in WEIGHTS}
    contained = F.greatest("containment_lr", "containment_rl")
    overlap = F.greatest(contained, "jaccard", "shared_values", "rare_tokens")
    plus = w["containment_lr"] * v["containment_lr"] + 0.5 * w["containment_rl"] * v["containment_rl"] + w["jaccard"] * v["jaccard"] + w["shared_values"] * v["shared_values"] + w["rare_tokens"] * v["rare_tokens"]
    plus += F.when(overlap >= 0.3, w["key_uniqueness"] * v["key_uniqueness"]).otherwise(0.0) + F.when(overlap >= 0.2, w["name"] * v["name"]).otherwise(0.0)
    clash = F.when(F.col("divergence_conflict"), 2.0).otherwise(1.0) * F.when(recovers_formats(), 0.25).otherwise(1.0)
    minus = WEIGHTS["divergence"] * v["divergence"] * clash + F.when(F.col("type_conflict"), 0.5).otherwise(0.0) + F.when(F.col("entropy_conflict"), WEIGHTS["entropy"]).otherwise(0.0)
    raw = plus - minus
    capped = F.when((v["divergence"] >= 0.6) & (contained < 0.7) & ~recovers_formats(), F.least(raw, F.lit(0.2))).otherwise(raw)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), capped))


def candidate_score() -> Column:
    """How likely an inclusion is worth a closer look: containment, and what supports it as far as there is any."""
    contained = F.greatest("containment_lr", "containment_rl")
    support = sum((CANDIDATE[k] * F.col(k) for k in ("key_uniqueness", "cardinality", "type", "name")), F.lit(0.0))
    return F.least(F.lit(1.0), CANDIDATE["containment"] * contained + F.least(F.lit(1.0), contained / 0.3) * support)


def table_shapes(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: total_columns, fk_like, descriptive, is_small, most_distinct; over the columns given."""
    types = datatypes(tables)
    spark = next(iter(tables.values()))[0].sparkSession
    kinds = spark.createDataFrame(list(types.items()), "col string, type string")
    rows = None
    for t, (df, _) in tables.items():
        n = df.agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows"))
        rows = n if rows is None else rows.unionByName(n)
    facts = column_facts(column_values(tables)).join(F.broadcast(kinds), "col").withColumn("table", F.substring_index("col", ".", 1)).withColumn("unique", F.col("distinct") / F.col("non_null"))
    one = lambda c: F.sum(c.cast("int"))
    key = F.max(F.col("unique") >= 0.98)
    shapes = facts.groupBy("table").agg(
        F.count(F.lit(1)).alias("total_columns"), F.when(key, 0).otherwise(one(F.col("type").isin("integer", "string") & (F.col("distinct") >= 2) & (F.col("unique") < 0.98))).alias("fk_like"),
        one(F.col("type").isin("string", "text") & (F.col("unique") < 0.98)).alias("descriptive"), F.max("distinct").alias("most_distinct"),
    )
    return shapes.join(rows, "table").withColumn("is_small", (F.col("rows").between(1, SMALL)) | (F.col("most_distinct") <= SMALL))


def is_key_candidate(distinct: Column, rows: Column, most_distinct: Column | None = None, ratio: float = 0.95, band: float = 0.05) -> Column:
    """A column is a candidate for its table's key: nearly as many distinct values as rows, and nearly as many as the
    column of the table that has most."""
    near = (rows > 0) & (distinct > 0) & (distinct >= ratio * rows)
    return near if most_distinct is None else near & ((most_distinct <= 0) | (distinct >= (1 - band) * most_distinct))


def classify(found: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """found (as signals) with confidence, candidate_score, rel_type and needs_adjudication; the first rule that holds
    decides. Without shapes no table counts as a bridge or as small."""
    if shapes is not None:
        t = lambda side, *cols: F.broadcast(shapes.select(F.col("table").alias(f"_{side}"), *[F.col(c).alias(f"_{side}_{c}") for c in cols]))
        found = found.withColumn("_l", F.substring_index("left", ".", 1)).withColumn("_r", F.substring_index("right", ".", 1)).join(t("l", "fk_like", "total_columns"), "_l", "left").join(t("r", "is_small", "descriptive"), "_r", "left")
        bridge = (F.col("_l_fk_like") >= 2) & (F.col("_l_total_columns") <= F.col("_l_fk_like") + 1)
        small = F.col("_r_is_small") & (F.col("_r_descriptive") >= 1)
    else:
        bridge = small = F.lit(False)
    c = F.col
    contained = F.greatest("containment_lr", "containment_rl")
    overlap = F.greatest(contained, "jaccard", "shared_values")
    key = (c("key_uniqueness") >= 0.95) | (c("left_uniqueness") >= 0.95)
    alike = (c("name") >= 0.6) | (c("type") >= 0.6)
    apart = c("divergence") >= 0.5
    rel = (
        F.when(~key & c("transform").isNotNull(), "DERIVED_FIELD")
        .when(alike & ((apart & ~key) | ((contained < 0.9) & (apart | (overlap < 0.1)))), "UNRELATED")
        .when(c("type") < 0.6, "UNKNOWN")
        .when(F.coalesce(bridge, F.lit(False)) & (contained >= 0.9) & (c("key_uniqueness") >= 0.95), "M2M_BRIDGE")
        .when((c("containment_lr") >= 0.9) & (c("key_uniqueness") >= 0.95) & ~apart, F.when(F.coalesce(small, F.lit(False)) | (c("cardinality") <= 0.25), "LOOKUP_DIMENSION").otherwise("FK_JOIN"))
        .when((c("containment_rl") >= 0.9) & (c("left_uniqueness") >= 0.95) & ~apart, "FK_JOIN")
        .when(~key & (overlap >= 0.5) & (c("divergence") <= 0.2), "DENORMALIZATION")
        .when(~key & (c("containment_lr") >= 0.95), "DERIVED_FIELD")
        .otherwise("UNKNOWN")
    )
    out = found.withColumn("confidence", fused_confidence()).withColumn("candidate_score", candidate_score()).withColumn("rel_type", rel)
    conflict = c("containment_conflict") | c("divergence_conflict") | c("key_conflict") | c("entropy_conflict") | c("type_conflict")
    mixed = (F.greatest("containment_lr", "jaccard", "shared_values") >= 0.4) & conflict & ~c("rel_type").isin("UNRELATED", "UNKNOWN")
    out = out.withColumn("needs_adjudication", ((c("confidence") >= 0.45) & (c("confidence") < 0.65)) | mixed)
    return out.drop(*[x for x in out.columns if x.startswith("_")])



# What the evidence of an estate of each kind weighs, by group of signals.
ESTATE_WEIGHTS = {"balanced": (1.0, 1.0, 1.0), "relational": (1.30, 1.20, 0.80), "lake": (0.80, 0.90, 1.40)}
_STRUCTURAL, _OVERLAP = ("key_uniqueness", "cardinality", "entropy"), ("containment_lr", "containment_rl", "jaccard", "shared_values")


def estate(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row: tables, columns, keyed (share of tables with a nearly unique column), texts (share of text columns),
    uniqueness (mean over columns) and kind: relational, lake or balanced."""
    types = datatypes(tables)
    spark = next(iter(tables.values()))[0].sparkSession
    kinds = spark.createDataFrame(list(types.items()), "col string, type string")
    facts = F.broadcast(kinds).join(column_facts(column_values(tables)), "col", "left").withColumn("table", F.substring_index("col", ".", 1)).withColumn("unique", F.coalesce(F.try_divide(F.col("distinct"), F.col("non_null")), F.lit(0.0)))
    each = facts.groupBy("table").agg(F.max(F.col("unique")).alias("best"), F.count(F.lit(1)).alias("n"), F.sum(F.col("type").isin("string", "text").cast("int")).alias("texts"), F.sum("unique").alias("unique"))
    e = each.agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("columns"), F.avg((F.col("best") >= 0.95).cast("int")).alias("keyed"), (F.sum("texts") / F.sum("n")).alias("texts"), (F.sum("unique") / F.sum("n")).alias("uniqueness"))
    n = lambda *conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    relational = n(F.col("keyed") >= 0.6, F.col("texts") < 0.5, F.col("uniqueness") >= 0.5)
    lake = n(F.col("keyed") <= 0.3, F.col("texts") > 0.6, F.col("uniqueness") < 0.35)
    return e.withColumn("kind", F.when(F.col("tables") < 2, "balanced").when((relational >= 2) & (relational > lake), "relational").when((lake >= 2) & (lake > relational), "lake").otherwise("balanced"))


def estate_weights(kind: str) -> dict[str, float]:
    """What the weight of each signal is multiplied by in an estate of a kind; divergence and types are never touched."""
    structural, overlap, semantic = ESTATE_WEIGHTS[kind]
    return {k: structural if k in _STRUCTURAL else overlap if k in _OVERLAP else semantic for k in WEIGHTS}


def credible_joins(found: DataFrame) -> DataFrame:
    """Pairs whose right side is nearly unique and whose left side isn't: what keeps nested ranges of numbers from passing
    for references."""
    return found.where((F.col("key_uniqueness") >= 0.95) & (F.col("left_uniqueness") < 0.98))
