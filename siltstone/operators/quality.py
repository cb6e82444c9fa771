"""Expectations on columns and drift between loads: PSI, EWMA charts, schema drift."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.session import cut


@dataclass(frozen=True)
class Expectation:
    column: str
    kind: str  # not_null, pattern, in, range, type
    argument: object = None

    def violated(self) -> Column:
        """True where a value breaks it; nulls only break not_null."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "pattern":
            bad = ~c.cast("string").rlike(str(self.argument))
        elif self.kind == "in":
            bad = ~c.isin(list(self.argument))
        elif self.kind == "range":
            low, high = self.argument
            bad = ~c.try_cast("double").between(low, high)
        elif self.kind == "type":
            bad = c.cast("string").try_cast(str(self.argument)).isNull()
        else:
            raise ValueError(f"unknown expectation: {self.kind}")
        return F.coalesce(c.isNotNull() & bad, F.lit(False))

    def name(self) -> str:
        return f"{self.column}:{self.kind}"


def evaluate(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """(expectation, n_evaluated, violations, pass_rate, severity) of all expectations in one pass."""
    each = []
    for e in expectations:
        n = F.count(F.lit(1)) if e.kind == "not_null" else F.count(e.column)
        each.append(F.struct(F.lit(e.name()).alias("expectation"), n.alias("n_evaluated"), F.count_if(e.violated()).alias("violations")))
    rows = df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    rate = F.coalesce(1 - F.try_divide(F.col("violations"), F.col("n_evaluated")), F.lit(1.0))
    return rows.withColumn("pass_rate", rate).withColumn("severity", F.when(F.col("violations") == 0, "ok").when(F.col("pass_rate") < 0.95, "error").otherwise("warning"))


def violations(df: DataFrame, expectation: Expectation, first: int = 100) -> DataFrame:
    """The first rows that break an expectation, by all their columns."""
    return df.where(expectation.violated()).orderBy(*df.columns).limit(first)


def psi(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """(bin, base_share, share, psi): population stability over the baseline's quantile bins, equal edges merged."""
    from siltstone.operators.profile import deciles

    edges = sorted({r["value"] for r in deciles(baseline, [column]).collect()})[1:-1]  # eleven numbers
    number = F.col(column).cast("double")
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < number)) if edges else F.lit(0)
    a = baseline.where(number.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    b = current.where(number.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    totals = a.agg(F.sum("n").alias("tn")).join(F.broadcast(b.agg(F.sum("m").alias("tm"))))
    both = a.join(b, "bin", "full_outer").join(F.broadcast(totals))
    p, q = F.greatest(F.coalesce(F.col("n") / F.col("tn"), F.lit(0.0)), F.lit(epsilon)), F.greatest(F.coalesce(F.col("m") / F.col("tm"), F.lit(0.0)), F.lit(epsilon))
    return both.select("bin", p.alias("base_share"), q.alias("share"), ((q - p) * F.ln(q / p)).alias("psi"))


def ewma(series: DataFrame, key: str, cycle: str, value: str, lam: float = 0.3, warmup: int = 3, width: float = 3.0) -> DataFrame:
    """(key, cycle, value, ewma, alarm): control chart of each key's series; the first warmup values set its centre
    and spread. Series are read in order, batch by batch; of a series only its state is held."""
    spread = (lam / (2 - lam)) ** 0.5
    kind = series.schema[key].dataType.simpleString()

    def chart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, z, sd = object(), [], None, 0.0
        for batch in batches:
            out = []
            for k, t, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != now:
                    now, head, z = k, [], None
                z = x if z is None else lam * x + (1 - lam) * z
                later = len(head) == warmup
                if not later:
                    head.append(x)
                    mean = sum(head) / len(head)
                    sd = (sum((y - mean) ** 2 for y in head) / len(head)) ** 0.5
                out.append((k, t, x, z, later and abs(z - mean) > width * max(sd, 1e-9) * spread))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form) if out else pa.RecordBatch.from_pylist([], schema=form)

    rows = series.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(cycle).cast("long").alias(cycle), F.col(value).cast("double").alias(value))
    schema = f"`{key}` {kind}, `{cycle}` long, `{value}` double, ewma double, alarm boolean"
    form = to_arrow_schema(rows.withColumns({"ewma": F.lit(0.0), "alarm": F.lit(False)}).schema)
    return rows.repartition(key).sortWithinPartitions(key, cycle).mapInArrow(chart, schema)


def _alike(old: DataFrame, gone: list[str], new: DataFrame, come: list[str]) -> dict[tuple[str, str], float]:
    """The Jaccard similarity of the distinct values of all pairs of columns that share any, in one aggregation."""
    def values(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
        return df.select(each.alias("x")).select(F.lit(side).alias("side"), "x.*").where("value is not null").distinct()

    both = cut(values(old, "old", gone).unionByName(values(new, "new", come)))
    sizes = {(r["side"], r["column"]): r["count"] for r in both.groupBy("side", "column").count().collect()}  # a row a column
    held = both.groupBy("value").agg(F.collect_set(F.when(F.col("side") == "old", F.col("column"))).alias("a"), F.collect_set(F.when(F.col("side") == "new", F.col("column"))).alias("b"))
    met = held.select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y")).groupBy("x", "y").count().collect()
    return {(x, y): n / (sizes["old", x] + sizes["new", y] - n) for x, y, n in met}


def schema_drift(old: DataFrame, new: DataFrame, columns_old: list[str] | None = None, columns_new: list[str] | None = None, same: float = 0.8) -> DataFrame:
    """(change, column, other): added, removed and renamed columns; renamed where the distinct values of a removed
    and an added column have a Jaccard similarity of at least same."""
    a, b = columns_old or old.columns, columns_new or new.columns
    gone, come = [c for c in a if c not in b], [c for c in b if c not in a]
    rows = []
    alike = _alike(old, gone, new, come) if gone and come else {}
    for x in gone:
        best = max(come, key=lambda y: (alike.get((x, y), 0.0), y), default=None)
        if best is not None and alike.get((x, best), 0.0) >= same:
            rows.append(("renamed", x, best))
            come.remove(best)
        else:
            rows.append(("removed", x, None))
    rows += [("added", y, None) for y in come]
    types_a, types_b = dict(old.dtypes), dict(new.dtypes)
    rows += [("retyped", c, types_b[c]) for c in a if c in b and types_a[c] != types_b[c]]
    return old.sparkSession.createDataFrame(rows, "change string, column string, other string")
