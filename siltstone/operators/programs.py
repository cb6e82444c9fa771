"""Cleaning programs: columns of a table rewritten by expressions, joined, reduced or grouped, with the source rows behind
each result; and what must hold before one is accepted.

A program is a plan: it compiles to one DataFrame, and its verification reads the data in two aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of rows that proposals are tried on, the rest being held out, and the least score of acceptance.
TRIED, FLOOR = 0.7, 0.70


@dataclass(frozen=True)
class Lookup:
    """A left join of another table along an inclusion: source.column = table.key."""

    table: str
    column: str
    key: str


@dataclass(frozen=True)
class Program:
    source: str
    columns: dict[str, str]  # target column to expression over s (the source) and r (the table looked up)
    where: str | None = None
    lookup: Lookup | None = None
    dedupe: tuple[str, ...] = field(default=())
    group: tuple[str, ...] = field(default=())


def content_id(df: DataFrame) -> DataFrame:
    """df with row_id: the hash of the row's content, the same at any layout; rows that repeat share it."""
    return df.withColumn("row_id", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


def compile_program(program: Program, tables: dict[str, DataFrame], tagged: bool = False) -> DataFrame:
    """The result of a program. A lookup keeps every source row, also without a partner. dedupe keeps the first row of its
    target columns by all others; group keeps one row a group with the least value of every other column. tagged adds
    row_id, of groups row_ids (sorted), of the rows behind each result."""
    s = content_id(tables[program.source]) if tagged else tables[program.source]
    df = s.alias("s")
    if program.lookup:
        df = df.join(tables[program.lookup.table].alias("r"), F.col(f"s.{program.lookup.column}") == F.col(f"r.{program.lookup.key}"), "left")
    if program.where:
        df = df.where(F.expr(program.where))
    out = df.select(*[F.expr(e).alias(t) for t, e in sorted(program.columns.items())], *([F.col("s.row_id")] if tagged else []))
    targets = sorted(program.columns)
    if program.group:
        rest = [t for t in targets if t not in program.group]
        return out.groupBy(*program.group).agg(*[F.min(t).alias(t) for t in rest], *([F.sort_array(F.collect_list("row_id")).alias("row_ids")] if tagged else [])).select(*targets, *(["row_ids"] if tagged else []))
    if program.dedupe:
        rest = [c for c in out.columns if c not in program.dedupe]
        first = F.min(F.struct(*[c for c in (*(["row_id"] if tagged else []), *targets) if c in rest])).alias("_f")
        return out.groupBy(*program.dedupe).agg(first).select(*[F.col(t) if t in program.dedupe else F.col(f"_f.{t}").alias(t) for t in targets], *([F.col("_f.row_id")] if tagged else []))
    return out


def verify(program: Program, tables: dict[str, DataFrame], checks: dict[str, str]) -> DataFrame:
    """One row: source_rows (those that where lets through), result_rows, traced (result rows whose source rows exist),
    covered (source rows that some result stands for), held_out and passed (checks, conditions on the targets, met by
    rows of the held-out share). Whether a row is held out follows from its content."""
    source = content_id(tables[program.source])
    kept = source.alias("s").where(F.expr(program.where)) if program.where else source
    ids = kept.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    out = compile_program(program, tables, tagged=True)
    if program.group:
        out = out.withColumn("row_id", F.explode("row_ids"))
    met = out.select("row_id", F.coalesce(*[F.expr(" and ".join(f"coalesce({c}, false)" for c in checks.values()))] if checks else [F.lit(True)]).alias("ok")).groupBy("row_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("ok").cast("int")).alias("ok"))
    both = ids.join(met, "row_id", "full_outer").withColumn("held", F.pmod(F.xxhash64("row_id"), F.lit(100)) >= int(100 * TRIED))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total("n").alias("source_rows"), total("m").alias("result_rows"), total(F.when(F.col("n").isNotNull(), F.col("m"))).alias("traced"), total(F.when(F.col("m").isNotNull(), F.least("n", "m"))).alias("covered"), total(F.when(F.col("held"), F.col("m"))).alias("held_out"), total(F.when(F.col("held"), F.col("ok"))).alias("passed"))


def accepted(verified: DataFrame, program: Program, floor: float = FLOOR) -> DataFrame:
    """verified with score (share of held-out rows that meet the checks) and accepted: every result is traced, no source row
    is lost but by dedupe, a lookup multiplies nothing, and the score reaches the floor."""
    score = F.coalesce(F.try_divide(F.col("passed"), F.col("held_out")), F.lit(0.0))
    whole = F.col("traced") == F.col("result_rows")
    if not program.dedupe:
        whole = whole & (F.col("covered") == F.col("source_rows")) & (F.col("result_rows") == F.col("source_rows"))
    return verified.withColumn("score", score).withColumn("accepted", whole & (score >= floor))


def match_columns(columns: list[str], properties: list[str]) -> dict[str, str]:
    """Columns and the properties they are best named for, one to one, by similarity of names; those with none in common
    stay alone. Metadata only."""
    from siltstone.operators.dependencies import name_similarity

    scores = sorted(((-name_similarity(c, p), c, p) for c in columns for p in properties if name_similarity(c, p) > 0))
    out: dict[str, str] = {}
    for _, c, p in scores:
        if c not in out and p not in out.values():
            out[c] = p
    return out
