"""Which columns hold personal data, and whether any of it shows in what is given away."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of personal data, and parts of column names that hint at them.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "card": r"\b(?:\d[ -]?){13,16}\b", "phone": r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\b\d{3})[ .-]\d{3}[ .-]\d{4}\b"}
HINTS = ("email", "mail", "phone", "tel", "mobile", "ssn", "social", "card", "ccn", "name", "fname", "lname", "first", "last", "surname", "address", "addr", "street", "dob", "birth", "passport", "license", "account", "acct", "iban", "patient", "customer_name", "user_name", "username", "full_name")


def sensitivity(df: DataFrame, columns: list[str] | None = None, floor: float = 0.3) -> DataFrame:
    """(column, share, sensitivity) over all values: 'pii' where at least floor of a column's values look like personal data,
    'quasi' where only its name hints at it, else 'none'."""
    names = columns or df.columns
    looks = lambda c: F.coalesce(F.col(f"`{c}`").cast("string").rlike("|".join(PATTERNS.values())).cast("int"), F.lit(0))
    shares = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.try_divide(F.sum(F.when(F.col(f"`{c}`").isNotNull(), looks(c))), F.count(f"`{c}`")), F.lit(0.0)).alias("share"), F.lit(any(h in c.lower() for h in HINTS)).alias("hint")) for c in names]).alias("a"))
    rows = shares.select(F.explode("a").alias("x")).select("x.*")
    return rows.select("column", "share", F.when(F.col("share") >= floor, "pii").when(F.col("hint"), "quasi").otherwise("none").alias("sensitivity"))


def leaks(given: dict[str, tuple[DataFrame, list[str]]], raw: DataFrame) -> DataFrame:
    """(table, column, value, n): raw values (column value) that stand as they are in the given columns; none is the proof.
    Values are counted before they meet, so a value that fills a column costs one row."""
    from siltstone.operators.relationships import column_values

    held = column_values(given).join(raw.select(F.col("value").cast("string").alias("value")).where("value <> ''").distinct(), "value", "left_semi")
    return held.select(F.substring_index("col", ".", 1).alias("table"), F.expr("substr(col, instr(col, '.') + 1)").alias("column"), "value", "n")


def masked(text: str) -> str:
    """A text with everything that looks like personal data replaced by its kind."""
    for kind, pattern in PATTERNS.items():
        text = re.sub(pattern, f"<{kind}>", text)
    return text
