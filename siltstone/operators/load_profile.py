"""Column-level data quality profile over repeated loads of a table.

Every value becomes a mask: runs of upper-case letters, lower-case letters and digits are generalised to A, a and
9 (up to LONG_RUN with their length, else with +), other characters stay. Masks that most loads show and that hold
a share of the column are dominant; all others are rare and are reported. The distribution of masks, of values (of
columns with few values) or of quantile bins (of numbers), with nulls as a class of their own, is compared for each
load with what the table's loads normally show: the median share over all loads. The G statistic of a load against
that reference (its rows times twice the Kullback-Leibler divergence) is turned into a normal score; beyond
LIMIT a load departs by more than chance allows in a load of its size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut

LONG_RUN = 4
#: A class is dominant if this share of the loads shows it and it holds this share of the values.
IN_LOADS, OF_VALUES = 0.2, 0.002
#: What a load may always hold of classes it isn't expected to hold.
STRAY = 0.002
LIMIT = 5.0
DECILES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def mask(c: Column) -> Column:
    """The character-class mask of a text: 'N73125MG' is 'A9+AA', 'rev. 2' is 'aaa. 9'."""
    plain = F.translate(c, string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "9" * 10)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Lu}", "A"), r"[\p{Ll}\p{Lo}]", "a"), r"\p{Nd}", "9")
    m = F.when(F.octet_length(c) == F.length(c), plain).otherwise(classes)  # patterns only where there are other letters
    return F.regexp_replace(m, r"([Aa9])\1{" + str(LONG_RUN) + ",}", "$1+")


def cells(df: DataFrame, table_name: str, load: str, columns: list[str]) -> DataFrame:
    """One row per cell: table_name, load_no, column_name, value string, number double (null for texts)."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    types = dict(df.dtypes)
    structs = []
    for c in columns:
        is_number = types[c] in numeric or types[c].startswith("decimal")
        structs.append(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"), (F.col(f"`{c}`").cast("double") if is_number else F.lit(None).cast("double")).alias("number")))
    return df.select(F.lit(table_name).alias("table_name"), F.col(load).cast("int").alias("load_no"), F.explode(F.array(*structs)).alias("x")).select("table_name", "load_no", "x.*")


def describe(rows: DataFrame) -> DataFrame:
    """Per load and column: rows, nulls, distinct values, smallest and largest number, dominant mask and its share."""
    by = ["table_name", "load_no", "column_name"]
    values = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("number"))
    masks = values.withColumn("m", mask(F.col("value"))).groupBy(*by, "m").agg(F.sum("n").alias("n"), F.count("value").alias("d"), F.min("number").alias("low"), F.max("number").alias("high"))
    top = F.max_by("m", F.struct(F.col("m").isNotNull(), "n", "m"))
    return masks.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("m").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum("d").alias("n_distinct"),
        F.min("low").alias("min_number"),
        F.max("high").alias("max_number"),
        top.alias("top_mask"),
    )


def _edges(rows: DataFrame) -> DataFrame:
    """Bin edges per numeric column: the median over the loads of each load's deciles, so that odd loads don't shift them."""
    per_load = rows.where("number is not null and not isnan(number)").groupBy("table_name", "column_name", "load_no").agg(F.percentile_approx("number", DECILES, 10_000).alias("q"))
    middle = per_load.select("table_name", "column_name", F.posexplode("q").alias("i", "q")).groupBy("table_name", "column_name", "i").agg(F.percentile_approx("q", 0.5).alias("edge"))
    return middle.groupBy("table_name", "column_name").agg(F.array_distinct(F.array_sort(F.collect_list("edge"))).alias("edges"))


def _score(classes: DataFrame) -> DataFrame:
    """From counts (table_name, load_no, column_name, kind, class, n) the score of each load, column and kind."""
    column, by = ["table_name", "column_name", "kind"], ["table_name", "load_no", "column_name", "kind"]
    sizes = classes.groupBy(*by).agg(F.sum("n").alias("size"))
    loads = sizes.groupBy(*column).agg(F.count(F.lit(1)).alias("loads"), F.sum("size").alias("values"))
    seen = classes.groupBy(*column, "class").agg(F.count(F.lit(1)).alias("in_loads"), F.sum("n").alias("n_all")).join(F.broadcast(loads), column)
    dominant = seen.where((F.col("in_loads") >= IN_LOADS * F.col("loads")) & (F.col("n_all") >= OF_VALUES * F.col("values")))
    # the median over all loads, those without the class counting as 0: the at-th smallest of the shares that are there.
    # Dominant classes are at most 1 / OF_VALUES per column; each has a row a load, which the window can spill
    at = F.ceil(F.col("loads") / 2).cast("int") - (F.col("loads") - F.col("in_loads")).cast("int")
    order = Window.partitionBy(*column, "class").orderBy("share")
    shares = classes.join(F.broadcast(dominant), [*column, "class"]).join(sizes, by).withColumn("share", F.col("n") / F.col("size"))
    middle = shares.withColumn("i", F.row_number().over(order)).where(F.col("i") == F.greatest(at, F.lit(1)))
    reference = middle.select(*column, "class", F.greatest(F.when(at >= 1, F.col("share")).otherwise(0.0), F.lit(STRAY)).alias("ref"))
    total = reference.groupBy(*column).agg((F.sum("ref") + STRAY).alias("all_ref"), F.count(F.lit(1)).alias("k"))
    reference = reference.join(total, column).withColumn("ref", F.col("ref") / F.col("all_ref")).drop("all_ref", "k")
    # the table of dominant classes has at most 1 / OF_VALUES rows per column of the profiled tables
    known = classes.join(F.broadcast(reference), [*column, "class"], "left").withColumn("class", F.when(F.col("ref").isNotNull(), F.col("class")))
    lumped = known.groupBy(*by, "class").agg(F.sum("n").alias("n"), F.max("ref").alias("ref")).join(sizes, by).join(F.broadcast(total), column, "left")
    share = F.coalesce(F.col("ref"), STRAY / F.coalesce(F.col("all_ref"), F.lit(STRAY)))
    g = lumped.groupBy(*by).agg(F.sum(2 * F.col("n") * F.ln(F.col("n") / (F.col("size") * share))).alias("g"), F.max("k").alias("k"), F.max("size").alias("size"), F.sum(F.when(F.col("ref").isNull(), F.col("n")).otherwise(0)).alias("rare"))
    g = g.withColumn("dof", F.greatest(F.coalesce(F.col("k"), F.lit(1)).cast("double"), F.lit(1.0)))
    usual = g.groupBy(*column).agg(F.percentile_approx("g", 0.5).alias("usual"))
    g = g.join(F.broadcast(usual), column)
    expected = F.col("dof") * F.pow(1 - 2 / (9 * F.col("dof")), F.lit(3.0))
    scaled = F.col("g") / F.greatest(F.lit(1.0), F.col("usual") / expected)
    spread = 2 / (9 * F.col("dof"))
    return g.withColumn("score", (F.pow(F.greatest(scaled, F.lit(0.0)) / F.col("dof"), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)).withColumn("divergence", F.col("g") / (2 * F.col("size")))


def drift(rows: DataFrame) -> DataFrame:
    """Per load, column and kind of class ('mask', 'value', 'bin'): divergence, rare values, score.

    rows: as from cells. Nulls are a class; repeated rows count each time; a column of nulls only has one class.
    An empty table gives an empty result. With few loads the reference is weak, but defined.
    """
    by = ["table_name", "load_no", "column_name"]
    none = F.lit("null")
    text = F.when(F.col("value").isNull(), none).otherwise(F.concat(F.lit("="), "value"))
    form = F.when(F.col("value").isNull(), none).otherwise(F.concat(F.lit("~"), mask(F.col("value"))))
    edges = _edges(rows)
    below = sum((F.coalesce((F.get("edges", i) <= F.col("number")).cast("int"), F.lit(0)) for i in range(len(DECILES))), F.lit(0))
    binned = F.when(F.col("value").isNull(), none).otherwise(F.concat(F.lit("#"), below.cast("string")))
    # values are counted before their masks are taken: a mask is made once per distinct value and load
    counted = rows.groupBy(*by, "value", "number").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(F.broadcast(edges), ["table_name", "column_name"], "left")
    second = F.when(F.col("edges").isNull(), F.struct(F.lit("value").alias("kind"), text.alias("class"))).otherwise(F.struct(F.lit("bin").alias("kind"), binned.alias("class")))
    classes = counted.select(*by, "n", F.explode(F.array(F.struct(F.lit("mask").alias("kind"), form.alias("class")), second)).alias("c"))
    # the counts are read several times by the score; they are far fewer than the cells
    return _score(cut(classes.groupBy(*by, F.col("c.kind").alias("kind"), F.col("c.class").alias("class")).agg(F.sum("n").alias("n"))))


def departures(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Loads (table_name, load_no, column_name) in which a column departs from what its loads normally show, and the
    kinds of class ('mask', 'value', 'bin') that show it."""
    return drift(rows).where(F.col("score") > limit).groupBy("table_name", "load_no", "column_name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def rare_masks(rows: DataFrame) -> DataFrame:
    """Masks of a column that are not dominant, with the loads and values they occur in."""
    column = ["table_name", "column_name"]
    masks = rows.where("value is not null").withColumn("mask", mask(F.col("value"))).groupBy(*column, "mask", "load_no").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("example"))
    masks = masks.groupBy(*column, "mask").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_loads"), F.min("example").alias("example"))
    totals = rows.groupBy("table_name", "column_name").agg(F.count_distinct("load_no").alias("loads"), F.count("value").alias("values"))
    rare = (F.col("n_loads") < IN_LOADS * F.col("loads")) | (F.col("n_values") < OF_VALUES * F.col("values"))
    return masks.join(F.broadcast(totals), column).where(rare).select(*column, "mask", "n_values", "n_loads", "example")
