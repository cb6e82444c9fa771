"""Quantities recorded in different units.

What a record states about its unit (inside the figure, in a unit column, in a text, by its place) is read by
expressions. A calibrated random forest then assigns a unit to every record from the figure's magnitude, the source,
category and neighbouring fields, and from what is stated, if anything. Confident assignments that no statement
contradicts are converted; all others go to review, with both the assigned and the stated unit, and without a converted
value.

The forest is fitted on a bounded sample (TRAIN_ROWS) of the records that state a unit, drawn evenly over the ways in
which units are stated. It sees each of them twice, once with the statements hidden, so that it learns to do without.
Its confidence is calibrated by isotonic regression on held-out records. Everything else covers all rows: the fitted
trees become arrays, which whole Arrow batches walk down level by level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_absent
from siltstone.session import remove, shared_folder

#: Records of the training sample, at most about twice this.
TRAIN_ROWS = 20_000
CONFIDENT = 0.95
#: Weight of a record shown with its statements hidden: less than one, so that trees look at statements first.
HIDDEN_WEIGHT = 0.1

# Unit, family, factor to the family's common unit, and the notations in which it is written
# (lower case, letters and digits only).
UNITS = [
    ("kg", "weight", 1.0, "kg kgs kgm kilo kilos kilogram kilograms"),
    ("g", "weight", 0.001, "g gr grm gram grams"),
    ("lb", "weight", 0.45359237, "lb lbs lbr pound pounds"),
    ("short_ton", "weight", 907.18474, "ston stons stn shtn shortton shorttons"),
    ("t", "weight", 1000.0, "t to mt tne tonne tonnes metricton metrictons"),
    ("sqm", "area", 1.0, "sqm m2 qm mtk sqmetre sqmetres squaremetre squaremetres"),
    ("sqft", "area", 1 / 10.7639, "sf sqft ft2 ftk squarefoot squarefeet"),
    ("ksf", "area", 1000 / 10.7639, "msf ksf"),
    ("sqyd", "area", 0.83612736, "sqyd yd2 ydk squareyard squareyards"),
    ("tsubo", "area", 3.305785, "tsubo ping"),
    ("each", "count", 1.0, "ea each pc pce pcs piece pieces"),
    ("dozen", "count", 12.0, "dz dzn doz dozen dozens"),
    ("hundred", "count", 100.0, "hun hundred c100"),
    ("gross", "count", 144.0, "gro gross gr144"),
    ("thousand", "count", 1000.0, "kpc th tpc thousand"),
]
COMMON = {"weight": "kg", "area": "sqm", "count": "each"}
CODES = {u: i + 1 for i, (u, *_) in enumerate(UNITS)}
FACTORS = {u: f for u, _, f, _ in UNITS}

STATEMENTS = ["figure", "column", "text", "default"]
NUMBERS = ["magnitude", "near_1", "near_2", "near_3", "family_code", "stated_code", *[f"{n}_code" for n in STATEMENTS]]
#: Fields of which the forest sees how large the figures of their values usually are.
LEVELS = ["source", "category", "place"]
FEATURES = [*NUMBERS, *LEVELS]


def unit_factor(source: str | None, target: str | None) -> float | None:
    """What a figure in source is multiplied by to be in target; 1 if either is not named, null if they don't convert."""
    if source is None or target is None or source == target:
        return 1.0
    families = {u: f for u, f, *_ in UNITS}
    if families.get(source) is None or families.get(source) != families.get(target):
        return None
    return FACTORS[source] / FACTORS[target]


def unit_of(notation: Column, family: str) -> Column:
    """The unit that a notation names, or null."""
    known = [(alias, u) for u, fam, _, aliases in UNITS if fam == family for alias in aliases.split()]
    names = F.create_map(*[F.lit(x) for pair in known for x in pair])
    low = F.lower(notation)
    return F.when(~is_absent(notation), F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_replace(low, r"[^a-z0-9]", ""))))


def with_figure(df: DataFrame, figure: str) -> DataFrame:
    """df with value and notation (of the unit) of a figure such as '1.009,7 kg', 'SF 1,001.0' or '12'. Each step has
    a column of its own, so that no pattern is matched twice; plain numbers need none."""
    t = F.col("_t")
    df = df.withColumn("_t", F.trim(F.col(figure)))
    df = df.withColumn("_plain", F.translate(t, "0123456789.", "") == "").withColumn("_leading", ~F.col("_plain") & t.rlike(r"^[A-Za-z]"))
    number = F.when(F.col("_plain"), t).when(F.col("_leading"), F.regexp_extract(t, r"\s([0-9][0-9.,]*)$", 1)).otherwise(F.regexp_extract(t, r"^([0-9][0-9.,]*)", 1))
    notation = F.when(F.col("_plain"), "").when(F.col("_leading"), F.regexp_extract(t, r"^(.*?)\s[0-9][0-9.,]*$", 1)).otherwise(F.regexp_extract(t, r"^[0-9][0-9.,]*\s*(.*)$", 1))
    df = df.withColumn("_number", number).withColumn("notation", notation)
    n = F.col("_number")
    without = lambda c, mark: F.replace(c, F.lit(mark), F.lit(""))
    marks = F.when(F.instr(n, ",") == 0, n).when(n.rlike(r"\.[0-9]+,[0-9]*$"), F.replace(without(n, "."), F.lit(","), F.lit("."))).otherwise(without(n, ","))
    return df.withColumn("value", marks.try_cast("double")).drop("_t", "_plain", "_leading", "_number")


def amount(c: Column) -> Column:
    """The number in a field that is only a hint to the model: thousands separators and other signs are dropped."""
    t = F.translate(F.trim(c), ",", "")
    return F.coalesce(t.try_cast("double"), F.regexp_replace(t, r"[^0-9.]", "").try_cast("double"))


def count_unit_in_text(c: Column) -> Column:
    """The unit of count that a text names ('UoM GRO', 'per 100 pcs', 'by the dozen'), or null."""
    t = F.lower(c)
    return F.coalesce(
        unit_of(F.regexp_extract(t, r"\buom:?\s+([a-z0-9]+)", 1), "count"),
        F.when(t.rlike(r"\b1,?000 (pcs|pieces)\b|\bthousand\b"), "thousand").when(t.rlike(r"\b100 (pcs|pieces)\b|\bhundred\b"), "hundred").when(t.rlike(r"\bgross\b"), "gross").when(t.rlike(r"\bdozen\b"), "dozen"),
    )


def log_of(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def prepare(df: DataFrame, *, table_name: str, row_key: Column, family: str, figure: Column, unit_column: Column, unit_text: Column | None = None, default: Column | None = None, category: Column, place: Column, near: list[Column]) -> DataFrame:
    """Records in the common form: table_name, row_key, family, value, figure_unit, column_unit, text_unit,
    default_unit and features. All columns are read from df through the given expressions, so other columns of df
    may have any name. Figures that can't be read have a null value."""
    none = F.lit(None).cast("string")
    rows = df.select(
        F.lit(table_name).alias("table_name"),
        row_key.alias("row_key"),
        F.lit(family).alias("family"),
        figure.alias("figure"),
        unit_column.alias("unit_column"),
        (none if unit_text is None else unit_text).alias("text_unit"),
        (none if default is None else default).alias("default_unit"),
        F.xxhash64(F.lit(table_name), F.lower(F.trim(category))).alias("category"),
        F.xxhash64(F.lit(table_name), F.lower(F.trim(place)), F.lit(1)).alias("place"),
        *[n.alias(f"n{i + 1}") for i, n in enumerate(near)],
    )
    numbers = [log_of(F.col(f"n{i + 1}")) for i in range(len(near))] + [F.lit(None).cast("double")] * (3 - len(near))
    rows = with_figure(rows, "figure")
    return rows.select("table_name", "row_key", "family", "value", unit_of(F.col("notation"), family).alias("figure_unit"), unit_of(F.col("unit_column"), family).alias("column_unit"), "text_unit", "default_unit", F.xxhash64("table_name").alias("source"), "category", "place", *[n.alias(f"near_{i + 1}") for i, n in enumerate(numbers)])


def _code(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for u, i in CODES.items() for x in (u, float(i))])
    return F.coalesce(F.try_element_at(names, c), F.lit(0.0))


def _numbers(df: DataFrame, hidden: Column) -> DataFrame:
    """df with NUMBERS, none of them null; the statements only where they aren't hidden."""
    families = F.create_map(*[F.lit(x) for i, f in enumerate(COMMON) for x in (f, float(i))])
    df = df.withColumn("magnitude", log_of(F.col("value"))).withColumn("family_code", F.try_element_at(families, F.col("family")))
    said = {"stated": stated_unit(), **{n: F.col(f"{n}_unit") for n in STATEMENTS}}
    df = df.withColumns({f"{n}_code": F.when(hidden, 0.0).otherwise(_code(c)) for n, c in said.items()})
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(-9.0)) for f in ("magnitude", "near_1", "near_2", "near_3")})


def stated_unit() -> Column:
    """A unit inside the figure outranks the unit column, that outranks the text, and that the default."""
    return F.coalesce(*[f"{n}_unit" for n in STATEMENTS])


class Encoder:
    """The matrix of FEATURES of a batch. A level (a source, category or place, by its hash) becomes the mean
    magnitude of its figures in the training sample; one not seen there becomes that of all figures."""

    def __init__(self, means: dict[str, dict[int, float]], overall: float):
        self.overall = overall
        self.keys = {c: np.array(sorted(m), dtype=np.int64) for c, m in means.items()}
        self.values = {c: np.array([means[c][k] for k in keys]) for c, keys in self.keys.items()}

    def __call__(self, columns: tuple[pd.Series, ...]) -> np.ndarray:
        out = np.empty((len(FEATURES), len(columns[0])))
        for i, name in enumerate(FEATURES):
            given = columns[i].to_numpy()
            if name in LEVELS:
                keys, values = self.keys[name], self.values[name]
                at = np.minimum(np.searchsorted(keys, given), max(len(keys) - 1, 0))
                out[i] = np.where(keys[at] == given, values[at], self.overall) if len(keys) else self.overall
            else:
                out[i] = given
        return out


class Trees:
    """The trees of a fitted forest as arrays: all rows of a batch go down a level in a few vector operations."""

    def __init__(self, nodes: list, depth: int):
        """nodes: of each tree (id, feature or -1, threshold, left, right, counts of classes), ids from 0 on."""
        self.depth, self.roots, feature, bound, child, chances = depth, [], [], [], [], []
        for tree in nodes:
            base, at = len(feature), {}
            # breadth first, so that the two children of a node stand next to each other
            order = [0]
            for i in order:
                at[i] = base + len(at)
                if tree[i][1] >= 0:
                    order += [tree[i][3], tree[i][4]]
            for i in order:
                _, f, t, left, _, counts = tree[i]
                feature.append(max(f, 0))
                bound.append(t if f >= 0 else np.inf)
                child.append(at[left] if f >= 0 else at[i])
                total = sum(counts)
                chances.append([c / total for c in counts] if f < 0 and total else [0.0] * len(counts))
            self.roots.append(base)
        self.feature, self.bound, self.child = np.array(feature, dtype=np.int64), np.array(bound), np.array(child, dtype=np.int64)
        self.chances = np.array(chances, dtype=np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Mean class probabilities, a row for each column of x."""
        n, flat, total = x.shape[1], x.ravel(), 0.0
        offsets = self.feature * n
        rows = np.arange(n)
        for root in self.roots:
            node = np.full(n, root)
            for _ in range(self.depth):
                node = self.child[node] + (flat[offsets[node] + rows] > self.bound[node])
            total = total + self.chances[node]
        return total / len(self.roots)


def _trees(forest, spark, depth: int) -> Trees:
    """The fitted nodes, read from the model's own file: at most trees * 2^(depth + 1) rows."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    forest.write().save(path)
    n = "nodeData"
    rows = spark.read.parquet(f"{path}/data").select("treeID", f"{n}.id", f"{n}.split.featureIndex", F.get(f"{n}.split.leftCategoriesOrThreshold", 0).alias("bound"), f"{n}.leftChild", f"{n}.rightChild", f"{n}.impurityStats").collect()
    remove(spark, path)
    trees: dict[int, dict[int, tuple]] = {}
    for tree, i, feature, bound, left, right, counts in rows:
        trees.setdefault(tree, {})[i] = (i, -1 if left < 0 else feature, bound, left, right, list(counts))
    return Trees([trees[t] for t in sorted(trees)], depth)


class UnitModel:
    """A fitted forest with its calibration: the confidence that goes with each raw score."""

    def __init__(self, encoder: Encoder, trees: Trees, curves: dict[tuple[int, bool], list[tuple[float, float]]]):
        """curves: the points of the calibration of each family, where something is stated (True) and where not."""
        self.encoder, self.trees = encoder, trees
        self.curves = {k: (np.array([s for s, _ in c]), np.array([v for _, v in c])) for k, c in curves.items() if c}

    def score(self, columns: tuple[pd.Series, ...]) -> pd.DataFrame:
        chances = self.trees(self.encoder(columns))
        code = chances.argmax(axis=1)
        raw, told = chances[np.arange(len(code)), code], columns[FEATURES.index("stated_code")].to_numpy() > 0
        family, sure = columns[FEATURES.index("family_code")].to_numpy(), np.zeros(len(code))
        for (f, t), (scores, levels) in self.curves.items():
            rows = (family == f) & (told == t)
            sure[rows] = np.interp(raw[rows], scores, levels)
        return pd.DataFrame({"code": code.astype(np.int32), "told": told, "raw": raw, "confidence": sure})

    def predict(self, records: DataFrame, hidden: Column | None = None) -> DataFrame:
        """records with predicted_unit and its calibrated confidence; hidden: where statements are kept from it."""
        score = self.score  # travels by value with the function; a broadcast object would need the package on the workers

        def assign(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for columns in batches:
                yield score(columns)[["code", "confidence"]]

        # the optimizer must not ask it twice, so it isn't told that it is deterministic
        udf = F.pandas_udf(assign, "code int, confidence double").asNondeterministic()
        scored = _numbers(records, F.lit(False) if hidden is None else hidden).select(*records.columns, udf(*FEATURES).alias("assigned"))
        units = F.array(F.lit(None).cast("string"), *[F.lit(u) for u, *_ in UNITS])
        return scored.select(*records.columns, F.get(units, F.col("assigned.code")).alias("predicted_unit"), F.col("assigned.confidence").alias("confidence"))


def training_sample(records: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A hash sample of at most about 4 * train_rows records, of which those that state a unit remain, and of these
    an even share for each way of stating it: about 2 * train_rows at most, with stated, pick (a hash) and fold."""
    totals = {r["table_name"]: r["count"] for r in records.groupBy("table_name").count().collect()}  # a row a source
    step = F.lit(1) if not totals else F.element_at(F.create_map(*[x for t, n in totals.items() for x in (F.lit(t), F.lit(max(1, n * len(totals) // (4 * train_rows))))]), F.col("table_name"))
    drawn = records.where(F.pmod(F.xxhash64("row_key"), step) == 0)
    ways = ["family", *[f"{n}_unit" for n in STATEMENTS]]
    labelled = drawn.withColumn("stated", stated_unit()).where("stated is not null and value is not null")
    labelled = labelled.withColumn("pick", F.xxhash64("table_name", "row_key", F.lit(1))).withColumn("way", F.xxhash64(*ways))
    sizes = {r["way"]: r["n"] for r in labelled.groupBy("way").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the units
    each = max(1, 2 * train_rows // max(1, len(sizes)))
    gaps = F.create_map(*[F.lit(x) for way, n in sizes.items() for x in (way, max(1, n // each))]) if sizes else None
    gap = F.lit(1) if gaps is None else F.coalesce(F.try_element_at(gaps, F.col("way")), F.lit(1))
    return labelled.where(F.pmod("pick", gap) == 0).withColumn("fold", F.pmod(F.shiftright("pick", 24), F.lit(4))).drop("way")


def fit(records: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 10, depth: int = 14) -> UnitModel | None:
    """Fit on training_sample; None if it has less than 50 records. A quarter of it is held out for calibration."""
    spark = records.sparkSession
    sample = training_sample(records, train_rows).cache()
    means, overall = {}, 0.0
    for name in LEVELS:  # at most as many as the sample has records
        rows = sample.groupBy(name).agg(F.avg(log_of(F.col("value"))).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum(log_of(F.col("value"))).alias("sum")).collect()
        means[name] = {r[name]: r["mean"] or 0.0 for r in rows}
        n = sum(r["n"] for r in rows)
        overall = sum(r["sum"] or 0.0 for r in rows) / max(n, 1)
    if n < 50:
        sample.unpersist()
        return None
    encoder = Encoder(means, overall)

    def encode(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(list(encoder(columns).T))

    twice = sample.withColumn("hidden", F.explode(F.array(F.lit(False), F.lit(True))))
    numbers = _numbers(twice, F.col("hidden"))
    seen = numbers.select(*FEATURES, _code(F.col("stated")).alias("label"), "fold", F.when(F.col("hidden"), HIDDEN_WEIGHT).otherwise(1.0).alias("weight")).cache()
    fitted = seen.where("fold > 0").select(array_to_vector(F.pandas_udf(encode, "array<double>")(*FEATURES)).alias("features"), "label", "weight")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, weightCol="weight", maxBins=64, maxMemoryInMB=512, featureSubsetStrategy="all").fit(fitted)
    model = UnitModel(encoder, _trees(forest, spark, depth), {})

    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield model.score(columns)[["code", "told", "raw"]]

    held = seen.where("fold = 0").withColumn("s", F.pandas_udf(raw, "code int, told boolean, raw double")(*FEATURES)).select("family_code", "s.raw", "s.told", (F.col("s.code") == F.col("label")).cast("double").alias("hit")).cache()
    curves = {}
    for family, told in held.select("family_code", "told").distinct().collect():
        curve = IsotonicRegression(featuresCol="raw", labelCol="hit").fit(held.where((F.col("family_code") == family) & (F.col("told") == told)))
        curves[int(family), told] = [(float(b), float(v)) for b, v in zip(curve.boundaries, curve.predictions, strict=True)]
    for df in (sample, seen, held):
        df.unpersist()
    return UnitModel(encoder, model.trees, curves)


def convert(records: DataFrame, model: UnitModel | None, confident: float = CONFIDENT) -> DataFrame:
    """records with predicted_unit, stated_unit, unit, basis, confidence and canon_value (in the family's common unit).

    basis: 'model' for a confident assignment that agrees with what is stated, 'predicted' for a confident one where
    nothing is stated, 'review' for the rest, which keep a null unit and value. An unreadable figure gives a null
    canon_value. Without a model (too few records to fit one) nothing is confident and all rows are 'review'.
    """
    if model is None:
        scored = records.withColumn("predicted_unit", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0))
    else:
        scored = model.predict(records)
    scored = scored.withColumn("stated_unit", stated_unit())
    sure = F.coalesce(F.col("confidence") >= confident, F.lit(False)) & F.col("predicted_unit").isNotNull()
    basis = F.when(sure & (F.col("predicted_unit") == F.col("stated_unit")), "model").when(sure & F.col("stated_unit").isNull(), "predicted").otherwise("review")
    scored = scored.withColumn("basis", basis)
    factors = F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])
    return scored.withColumn("unit", F.when(F.col("basis") != "review", F.col("predicted_unit"))).withColumn("canon_value", F.col("value") * F.try_element_at(factors, F.col("unit")))
