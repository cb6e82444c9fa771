"""Exact radius joins of strings by metric-space partitioning.

The points are strings in blocks. Their distance is the Levenshtein distance, cut off at a bound T, plus a weight
above T + 2 * radius if the blocks differ: a metric, in which a block with a pivot of its own never has a nearer one
elsewhere. So pivots need only be sought in a point's own block, and all pivots together partition the whole space.

A point's home is its nearest pivot. If d(x, y) <= r and x's home is pivot p, then by the triangle inequality
d(y, p) <= d(y, home of y) + 2 r, so y is replicated to every pivot as near as that, and each pair is found in the
home cell of its smaller string. In a cell only strings meet whose distances to the pivot differ by at most r (the
triangle inequality again), and the JVM computes their true distance with a limit. Cells that are still large get
pivots of their own, level by level, until they are small; where pivots no longer tell strings apart, the cell's pairs
are dealt out in chunks instead. Equal strings are joined once, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut

#: A cell with more home strings than this gets a pivot for each so many of them, at most FAN_OUT a level.
CELL, FAN_OUT = 24, 32
#: After a level, cells of more home strings than CELL * SPARE are split again.
SPARE = 8

_POINT = ["block", "path", "s", "home", "d"]


def draw_pivots(points: DataFrame, cell: int = CELL, level: int = 0) -> DataFrame:
    """(block, path, pivots): the pivots of each cell of more than cell home strings, an array of at most FAN_OUT."""
    homes = points.where("home").select("block", "path", "s", F.xxhash64("s", F.lit(level)).alias("h"))
    large = homes.groupBy("block", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    want = F.least(F.lit(FAN_OUT), F.ceil(F.col("n") / cell).cast("int"))
    # the smallest hashes; those that can be among them are told by their size alone, so no cell is sorted whole
    likely = homes.join(large, ["block", "path"]).where(F.pmod(F.col("h"), F.lit(2**32)) <= (4 * want + 40) / F.col("n") * 2**32)
    drawn = likely.withColumn("i", F.row_number().over(Window.partitionBy("block", "path").orderBy("h", "s"))).where(F.col("i") <= want)
    return drawn.groupBy("block", "path").agg(F.sort_array(F.collect_list("s")).alias("pivots"))


def _split(points: DataFrame, radius: int, cell: int, level: int) -> DataFrame:
    """points with each large cell divided among pivots; a point is home in one cell and replicated to the near ones."""
    near = points.join(draw_pivots(points, cell, level), ["block", "path"], "left")
    near = near.withColumn("to", F.transform("pivots", lambda p: F.levenshtein(F.col("s"), p))).withColumn("nearest", F.array_min("to")).withColumn("at", F.array_position("to", F.col("nearest")).cast("int") - 1)
    cells = F.filter(F.transform("to", lambda d, i: F.struct(i.alias("i"), d.alias("d"))), lambda x: x["d"] <= F.col("nearest") + 2 * radius)
    alone = F.array(F.struct(F.lit(-1).alias("i"), F.col("d").alias("d")))
    near = near.select("block", "path", "s", "home", "at", F.explode(F.when(F.col("pivots").isNull(), alone).otherwise(cells)).alias("c"))
    path = F.when(F.col("c.i") < 0, F.col("path")).otherwise(F.concat_ws(".", "path", "c.i"))
    return near.select("block", path.alias("path"), "s", (F.col("home") & ((F.col("c.i") < 0) | (F.col("c.i") == F.col("at")))).alias("home"), F.col("c.d").alias("d"))


def _chunks(points: DataFrame, sizes: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Home strings and all strings of cells that pivots don't divide, in chunks that meet each other once."""
    rows = points.join(sizes, ["block", "path"])
    i, j = F.ceil(F.col("homes") / (cell * SPARE)).cast("int"), F.ceil(F.col("all") / (cell * SPARE)).cast("int")
    mine = lambda n, seed: F.array(F.pmod(F.xxhash64("s", F.lit(seed)), n).cast("int"))
    each = lambda n: F.sequence(F.lit(0), n - 1)

    def dealt(df: DataFrame, rows_of, columns_of) -> DataFrame:
        df = df.withColumn("i", F.explode(rows_of)).withColumn("j", F.explode(columns_of))
        return df.select("block", F.concat_ws(".", "path", F.lit("x"), "i", "j").alias("path"), "s", "home", "d")

    return dealt(rows.where("home"), mine(i, 1), each(j)), dealt(rows, each(i), mine(j, 2))


def radius_join(strings: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """(block, a, b, distance), a < b: all pairs of distinct strings of a block within radius of each other.

    strings: block and s, both strings. Null blocks or strings meet nothing. Repeated rows change nothing. An
    empty string is a string like any other.
    """
    s = strings.select("block", "s").where("block is not null and s is not null").distinct()
    points = cut(_split(s.select("block", F.lit("").alias("path"), "s", F.lit(True).alias("home"), F.lit(0).alias("d")), radius, cell, 0))
    left, right = None, None
    before, level = None, 0
    while True:
        sizes = points.groupBy("block", "path").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all"))
        large = sizes.where(F.col("homes") > cell * SPARE)
        if large.isEmpty():
            break
        large = cut(large)
        done = points.join(large.select("block", "path"), ["block", "path"], "left_anti")
        left, right = _plus(left, done.where("home")), _plus(right, done)
        # a cell that kept nearly all strings of the one it came from won't be divided by more pivots
        stuck = large.limit(0) if before is None else large.withColumn("parent", F.regexp_replace("path", r"\.[^.]*$", "")).join(before.select("block", F.col("path").alias("parent"), F.col("all").alias("held")), ["block", "parent"]).where(F.col("all") > 0.8 * F.col("held")).select("block", "path", "homes", "all")
        if before is not None:
            a, b = _chunks(points, stuck, cell)
            left, right = _plus(left, a), _plus(right, b)
        before, level = large, level + 1
        rest = points.join(large.select("block", "path"), ["block", "path"], "left_semi").join(stuck.select("block", "path"), ["block", "path"], "left_anti")
        points = cut(_split(rest, radius, cell, level))
    left, right = _plus(left, points.where("home")), _plus(right, points)
    left = left.select("block", "path", F.col("s").alias("a"), F.length("s").alias("la"), F.col("d").alias("da"))
    right = right.select("block", "path", F.col("s").alias("b"), F.length("s").alias("lb"), F.col("d").alias("db"))
    met = left.join(right, ["block", "path"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= radius) & (F.abs(F.col("da") - F.col("db")) <= radius))
    return met.withColumn("distance", F.levenshtein("a", "b", radius)).where("distance >= 0").select("block", "a", "b", "distance")


def _plus(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b.select(*_POINT) if a is None else a.unionByName(b.select(*_POINT))
