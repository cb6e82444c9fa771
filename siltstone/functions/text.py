"""Column expressions on hand-typed text: null tokens, keys, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for an absent value in every table.
NULL_TOKENS = ("", "NULL", "N/A", "-", "TBD")


def is_absent(c: Column) -> Column:
    """True for null, blank and the null tokens in any case."""
    # translate, not a pattern: this is asked of every key of every row
    return c.isNull() | F.upper(F.trim(F.translate(c, "\t\n\r\x0b\x0c\u00a0", "      "))).isin(*NULL_TOKENS)


def present(c: Column) -> Column:
    """c, or null where it holds a null token."""
    return F.when(~is_absent(c), c)


def squeeze(c: Column) -> Column:
    """Trimmed, with each run of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def fold(c: Column) -> Column:
    """Trimmed, blanks collapsed, upper case: two texts are the same spelling if this agrees."""
    return F.upper(squeeze(c))


def key_chars(c: Column) -> Column:
    """Upper case without blanks and hyphens."""
    return F.upper(F.regexp_replace(c, r"[\s \-]+", ""))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, or of a date."""
    return F.unix_micros(c.cast("timestamp"))


def parse_day(c: Column) -> Column:
    """The date in yyyyMMdd, yyyy-MM-dd, dd-MMM-yyyy, dd-MMM-yy, MM/dd/yyyy or dd.MM.yyyy; null if it is none."""
    t = F.trim(c)
    named = r"^(\d{1,2})-([A-Za-z]{3})-(\d{2}|\d{4})$"
    # the reader takes month names only in this case
    t = F.when(t.rlike(named), F.concat_ws("-", F.regexp_extract(t, named, 1), F.initcap(F.regexp_extract(t, named, 2)), F.regexp_extract(t, named, 3))).otherwise(t)

    def read(pattern: str, fmt: str) -> Column:
        return F.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(fmt)).cast("date"))

    return F.coalesce(
        read(r"^\d{8}$", "yyyyMMdd"),
        read(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        read(r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
        read(r"^\d{1,2}-[A-Z][a-z]{2}-\d{2}$", "d-MMM-yy"),
        read(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        read(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    )
