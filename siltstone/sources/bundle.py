"""Portable bundles of a store: Parquet tables with a verified manifest, triples, and sliced CSV exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.bitemporal import ever, winners
from siltstone.sources.snapshots import content_fingerprint


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, and a manifest of its schema and content fingerprint. Equal tables give equal manifests,
    whatever the order of their rows."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        entries.append((name, json.dumps(sorted(df.dtypes)), json.dumps([str(x) for x in content_fingerprint(df)])))
    spark.createDataFrame(entries, "name string, columns string, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def verify_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(name, ok) of every table in the manifest: schema and content are as they were written."""
    rows = []
    for r in spark.read.schema("name string, columns string, fingerprint string").json(f"{folder}/manifest").collect():  # a row a table
        df = spark.read.parquet(f"{folder}/{r['name']}")
        rows.append((r["name"], json.dumps(sorted(df.dtypes)) == r["columns"] and json.dumps([str(x) for x in content_fingerprint(df)]) == r["fingerprint"]))
    return spark.createDataFrame(rows, "name string, ok boolean")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle that verifies; else an error names those that don't."""
    bad = [r["name"] for r in verify_bundle(spark, folder).where("not ok").collect()]
    if bad:
        raise ValueError(f"changed since it was written: {', '.join(bad)}")
    names = [r["name"] for r in spark.read.schema("name string").json(f"{folder}/manifest").collect()]
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def query_bundle(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """SQL over a bundle's tables and over `survivors`, the winning cells of its table `cells`."""
    for name, df in read_bundle(spark, folder).items():
        df.createOrReplaceTempView(name)
        if name == "cells":
            winners(df.where(ever())).createOrReplaceTempView("survivors")
    return spark.sql(sql)


def triples(cells: DataFrame, base: str = "urn:siltstone:") -> DataFrame:
    """(line): the winning cells as N-Triples, sorted."""
    def escaped(c):
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    won = winners(cells.where(ever())).where("value_str is not null")
    line = F.format_string(f'<{base}%s> <{base}%s> "%s" .', "entity_uri", "prop", escaped(F.col("value_str")))
    return won.select(line.alias("line")).orderBy("line")


def extract(df: DataFrame, key: str, columns: list[str], conditions: list[tuple[str, str, str]], limit: int) -> DataFrame:
    """Rows that fit all conditions, in order of the key. A comparison is numeric where both sides are numbers, else
    by text; a null only fits !=."""
    from functools import reduce

    def fits(name: str, op: str, literal: str):
        c = F.col(name).cast("string")
        try:
            number = float(literal)
        except ValueError:
            number = None
        pick = lambda f: F.coalesce(f(c.try_cast("double"), F.lit(number)), f(c, F.lit(literal))) if number is not None else f(c, F.lit(literal))
        ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "contains": lambda a, b: F.instr(F.lower(a.cast("string")), literal.lower()) > 0}
        return F.coalesce(pick(ops[op]), F.lit(op == "!="))

    kept = reduce(lambda d, x: d.where(fits(*x)), conditions, df)
    return kept.select(key, *columns).orderBy(key).limit(limit)
