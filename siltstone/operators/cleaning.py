"""Cleaning: detectors that propose fixes for a column, and the fixes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts that stand for a missing value.
MISSING = ("", "N/A", "NA", "NULL", "NONE", "-", "--", "?", "UNK", "UNKNOWN", "NAN", "NIL", "MISSING", "#N/A")


def null_tokens(c: Column) -> Column:
    return F.when(~F.upper(F.trim(c)).isin(*MISSING), c)


def tidy(c: Column) -> Column:
    """Trimmed; white space inside as single blanks."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def currency_to_number(c: Column, home: tuple[str, ...] = ("$", "USD")) -> Column:
    """A number in a text with thousands separators and a home currency; a foreign currency gives null, as nothing
    here knows rates."""
    t = F.trim(c)
    prefix = F.trim(F.regexp_extract(t, r"^([^\d\-+.]*)", 1))
    digits = F.regexp_replace(F.regexp_replace(t, r"^[^\d\-+.]*", ""), ",", "")
    return F.when((prefix == "") | F.upper(prefix).isin(*home), digits.try_cast("double"))


def scaled_unit(c: Column, units: dict[str, tuple[float, float]], bare: str | Column) -> Column:
    """value * scale + offset by the unit suffix of a text, blanks and dots in it aside; a number without one has the
    unit bare; others null. A comma after a point is a decimal one (7.381,0), others separate thousands."""
    t = F.trim(c)
    figure = F.regexp_extract(t, r"^([-+]?[\d.,]+)", 1)
    european = F.replace(F.replace(figure, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    number = F.when(figure.rlike(r"\.\d+,\d*$"), european).otherwise(F.replace(figure, F.lit(","), F.lit(""))).try_cast("double")
    written = r"^[-+]?[\d.,]+\s*([A-Za-z°%][A-Za-z°%. ]*)?$"
    suffix = F.when(t.rlike(written), F.regexp_replace(F.lower(F.regexp_extract(t, written, 1)), r"[. ]", ""))
    suffix = F.when(suffix == "", bare).otherwise(suffix)
    known = F.create_map(*[x for u, (scale, offset) in units.items() for x in (F.lit(u), F.struct(F.lit(float(scale)).alias("scale"), F.lit(float(offset)).alias("offset")))])
    # a transform of one element binds what is looked up, so that it is computed once
    return F.get(F.transform(F.array(F.struct(number.alias("n"), F.try_element_at(known, suffix).alias("u"))), lambda x: x["n"] * x["u"]["scale"] + x["u"]["offset"]), 0)


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by order, all columns breaking ties, so the choice doesn't hang on the layout."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in [*order, *rest]]))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def without_header_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat the header are dropped."""
    same = F.lit(True)
    for c in columns:
        same = same & (F.upper(F.trim(F.col(c).cast("string"))) == c.upper())
    return df.where(~F.coalesce(same, F.lit(False)))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value over more than one row."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row["_n"] > 1 and (row[c] or 0) <= 1]


def proposals(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fix, share): how many values of each text column each fix would change, all in one pass."""
    def rules(c: Column) -> dict[str, Column]:
        return {
            "null_tokens": c.isNotNull() & null_tokens(c).isNull(),
            "tidy": c.isNotNull() & (tidy(c) != c),
            "upper_case": c.isNotNull() & c.rlike(r"^[A-Za-z0-9\-]+$") & (F.upper(c) != c),
            "currency": c.rlike(r"^\s*(?:[$€£]|[A-Z]{3})\s?[\d,]+(\.\d+)?\s*$"),
            "unit_suffix": c.rlike(r"^\s*[-+]?[\d.,]+\s*[A-Za-z°%]+\s*$"),
        }

    each = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("fix"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("share")) for c in columns for k, hit in rules(F.col(c).cast("string")).items()]
    return df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*").where("share > 0")


def dedupe_keep(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As first_row, by a window: rows keep their own columns untouched."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
