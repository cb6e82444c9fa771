"""Sources: tables as text, row keys, per-cell snapshot differences, paragraphs of documents, mirrors by content."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A CSV or Parquet table with every column as string; blanks stay blanks. A row that is too short gets nulls."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    else:
        names = spark.read.csv(path, header=True).columns
        schema = ", ".join(f"`{c}` string" for c in [*names, "_malformed"])
        df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed")
        # the reader gives blanks as nulls, too; only those of rows that are too short stay so
        df = df.select(*[F.when(F.col("_malformed").isNull(), F.coalesce(F.col(f"`{c}`"), F.lit(""))).otherwise(F.col(f"`{c}`")).alias(c) for c in names])
    return df.limit(limit) if limit is not None else df


def discover_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV or Parquet file of a folder by its slugged name. Nothing is read before it is used."""
    found = {}
    for p in sorted(Path(folder).iterdir()):
        if p.suffix in (".csv", ".parquet"):
            found[re.sub(r"[^a-z0-9]+", "_", p.stem.lower()).strip("_")] = load_table(spark, str(p))
    return found


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int = 64) -> DataFrame:
    """A table of a database, read in ranges of its numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=partitions)


def with_row_key(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """df with row_key: the trimmed key values joined by |, or the content's hash. Repeated keys get ~2, ~3, ..."""
    if keys:
        key = F.concat_ws("|", *[F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys])
    else:
        key = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    df = df.withColumn("row_key", key)
    order = Window.partitionBy("row_key").orderBy(*[F.col(c) for c in sorted(df.columns) if c != "row_key"])
    n = F.row_number().over(order)
    return df.withColumn("_n", n).withColumn("row_key", F.when(F.col("_n") > 1, F.concat("row_key", F.lit("~"), F.col("_n"))).otherwise(F.col("row_key"))).drop("_n")


def cells(df: DataFrame) -> DataFrame:
    """(row_key, col, value, atom_id) of a table with row_key."""
    columns = [c for c in df.columns if c != "row_key"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    long = df.select("row_key", each.alias("x")).select("row_key", "x.col", "x.value").where("value is not null")
    return long.withColumn("atom_id", F.md5(F.concat_ws("\x1f", "row_key", "col", "value")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(row_key, col, kind, value, old_value): insert, update or delete of single cells; equal cells give nothing."""
    a, b = cells(old).select("row_key", "col", F.col("value").alias("old_value"), F.col("atom_id").alias("old_atom")), cells(new).select("row_key", "col", "value", F.col("atom_id").alias("new_atom"))
    both = a.join(b, ["row_key", "col"], "full_outer")
    kind = F.when(F.col("old_atom").isNull(), "insert").when(F.col("new_atom").isNull(), "delete").when(F.col("old_atom") != F.col("new_atom"), "update")
    return both.withColumn("kind", kind).where("kind is not null").select("row_key", "col", "kind", "value", "old_value")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, paragraph, content_hash, occurrence): maximal runs of non-blank lines, identified in their
    document by content and occurrence, so that moving one changes nothing else. Null texts have none."""
    unix = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\r", "\n")
    parts = F.posexplode(F.split(unix, r"\n[ \t]*(?:\n[ \t]*)+"))
    rows = docs.select(F.col(key).alias(key), parts.alias("place", "paragraph"))
    rows = rows.withColumn("paragraph", F.regexp_replace("paragraph", r"^\s+|\s+$", "")).where("paragraph <> ''").withColumn("content_hash", F.md5("paragraph"))
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key, "content_hash").orderBy("place")))


def paragraph_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content_hash, occurrence, kind): paragraphs that came or went; survivors give nothing."""
    ids = [key, "content_hash", "occurrence"]
    a, b = paragraphs(old, key, text).select(*ids), paragraphs(new, key, text).select(*ids)
    return b.join(a, ids, "left_anti").withColumn("kind", F.lit("insert")).unionByName(a.join(b, ids, "left_anti").withColumn("kind", F.lit("delete")))


def content_fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """Order of rows and columns doesn't count, repeated rows do: count, sum and xor of the rows' hashes."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    r = df.select(h.alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return (int(r[0]), int(r[1] or 0), int(r[2] or 0))


def write_snapshot(df: DataFrame, root: str, cycle: int) -> str:
    """Write a table once per content; the manifest maps cycles to content, so unchanged loads cost nothing."""
    name = "-".join(f"{x & (2**64 - 1):x}" for x in content_fingerprint(df))
    spark, path = df.sparkSession, f"{root}/content/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(cycle, name)], "cycle long, content string").coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return name


def read_snapshot(spark: SparkSession, root: str, cycle: int) -> DataFrame:
    """The table as of a cycle: the latest one written at or before it."""
    rows = spark.read.parquet(f"{root}/manifest").where(F.col("cycle") <= cycle).orderBy(F.desc("cycle")).limit(1).collect()
    if not rows:
        raise ValueError(f"no snapshot at or before cycle {cycle}")
    return spark.read.parquet(f"{root}/content/{rows[0]['content']}")
