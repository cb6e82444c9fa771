"""Schema evolution: operators on an ontology whose data effect is a DataFrame function, and backward views.

Each operator has `forward` (how the class's rows change) and `backward` (how to see the old version in the new
rows). A chain of operators composes their backward views; Catalyst collapses the projections, so a query against
an old version reads only the columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class RenameProperty:
    cls: str
    old: str
    new: str

    def forward(self, t: Tables) -> Tables:
        return {**t, self.cls: t[self.cls].withColumnRenamed(self.old, self.new)}

    def backward(self, t: Tables) -> Tables:
        return {**t, self.cls: t[self.cls].withColumnRenamed(self.new, self.old)}


@dataclass(frozen=True)
class RenameClass:
    old: str
    new: str

    def forward(self, t: Tables) -> Tables:
        return {(self.new if k == self.old else k): v for k, v in t.items()}

    def backward(self, t: Tables) -> Tables:
        return {(self.old if k == self.new else k): v for k, v in t.items()}


@dataclass(frozen=True)
class AddClass:
    cls: str
    schema: str

    def forward(self, t: Tables) -> Tables:
        spark = next(iter(t.values())).sparkSession
        return {**t, self.cls: spark.createDataFrame([], self.schema)}

    def backward(self, t: Tables) -> Tables:
        return {k: v for k, v in t.items() if k != self.cls}


@dataclass(frozen=True)
class DropClass:
    """Only an empty class may be dropped."""

    cls: str
    schema: str

    def forward(self, t: Tables) -> Tables:
        if not t[self.cls].isEmpty():
            raise ValueError(f"{self.cls} has rows")
        return {k: v for k, v in t.items() if k != self.cls}

    def backward(self, t: Tables) -> Tables:
        return AddClass(self.cls, self.schema).forward(t)


@dataclass(frozen=True)
class RetireClass:
    """A class that queries no longer see; its rows stay, so that it can come back."""

    cls: str

    def forward(self, t: Tables) -> Tables:
        return {(f"_retired_{k}" if k == self.cls else k): v for k, v in t.items()}

    def backward(self, t: Tables) -> Tables:
        return UnretireClass(self.cls).forward(t)


@dataclass(frozen=True)
class UnretireClass:
    cls: str

    def forward(self, t: Tables) -> Tables:
        return {(self.cls if k == f"_retired_{self.cls}" else k): v for k, v in t.items()}

    def backward(self, t: Tables) -> Tables:
        return RetireClass(self.cls).forward(t)


@dataclass(frozen=True)
class AddProperty:
    cls: str
    name: str
    kind: str

    def forward(self, t: Tables) -> Tables:
        return {**t, self.cls: t[self.cls].withColumn(self.name, F.lit(None).cast(self.kind))}

    def backward(self, t: Tables) -> Tables:
        return {**t, self.cls: t[self.cls].drop(self.name)}


@dataclass(frozen=True)
class DropProperty:
    """The property's values go to a side table by the class's key, so that older versions still answer."""

    cls: str
    key: str
    name: str

    def side(self) -> str:
        return f"_dropped_{self.cls}_{self.name}"

    def forward(self, t: Tables) -> Tables:
        return {**t, self.side(): t[self.cls].select(self.key, self.name), self.cls: t[self.cls].drop(self.name)}

    def backward(self, t: Tables) -> Tables:
        out = {**t, self.cls: t[self.cls].join(t[self.side()], self.key, "left")}
        out.pop(self.side())
        return out


@dataclass(frozen=True)
class RetypeProperty:
    """linear: new = scale * old + offset, as double; inverted for older versions."""

    cls: str
    name: str
    scale: float = 1.0
    offset: float = 0.0
    old_type: str = "double"

    def forward(self, t: Tables) -> Tables:
        return {**t, self.cls: t[self.cls].withColumn(self.name, F.col(self.name).cast("double") * self.scale + self.offset)}

    def backward(self, t: Tables) -> Tables:
        return {**t, self.cls: t[self.cls].withColumn(self.name, F.round((F.col(self.name) - self.offset) / self.scale, 9).cast(self.old_type))}


@dataclass(frozen=True)
class Specialize:
    """Rows that break the condition go to quarantine."""

    cls: str
    condition: str

    def forward(self, t: Tables) -> Tables:
        ok = F.coalesce(F.expr(self.condition), F.lit(False))
        return {**t, self.cls: t[self.cls].where(ok), f"_quarantine_{self.cls}": t[self.cls].where(~ok)}

    def backward(self, t: Tables) -> Tables:
        out = {**t, self.cls: t[self.cls].unionByName(t[f"_quarantine_{self.cls}"])}
        out.pop(f"_quarantine_{self.cls}")
        return out


@dataclass(frozen=True)
class Generalize:
    """The inverse of Specialize: quarantined rows that the looser condition lets through come back."""

    cls: str
    old: str
    new: str

    def forward(self, t: Tables) -> Tables:
        held = t[f"_quarantine_{self.cls}"]
        ok = F.coalesce(F.expr(self.new), F.lit(False))
        return {**t, self.cls: t[self.cls].unionByName(held.where(ok)), f"_quarantine_{self.cls}": held.where(~ok)}

    def backward(self, t: Tables) -> Tables:
        ok = F.coalesce(F.expr(self.old), F.lit(False))
        return {**t, self.cls: t[self.cls].where(ok), f"_quarantine_{self.cls}": t[f"_quarantine_{self.cls}"].unionByName(t[self.cls].where(~ok))}


@dataclass(frozen=True)
class AddFacet:
    """A class gets a view of its own of some properties, by its key; retiring it takes the view away."""

    cls: str
    facet: str
    key: str
    properties: tuple[str, ...]

    def forward(self, t: Tables) -> Tables:
        return {**t, self.facet: t[self.cls].select(self.key, *self.properties)}

    def backward(self, t: Tables) -> Tables:
        return {k: v for k, v in t.items() if k != self.facet}


@dataclass(frozen=True)
class RetireFacet:
    cls: str
    facet: str
    key: str
    properties: tuple[str, ...]

    def forward(self, t: Tables) -> Tables:
        return {k: v for k, v in t.items() if k != self.facet}

    def backward(self, t: Tables) -> Tables:
        return AddFacet(self.cls, self.facet, self.key, self.properties).forward(t)


@dataclass(frozen=True)
class SplitClass:
    """Rows with the discriminator's value go to `matching`, the others to `rest`."""

    cls: str
    discriminator: str
    value: str
    matching: str
    rest: str

    def forward(self, t: Tables) -> Tables:
        hit = F.coalesce(F.col(self.discriminator).cast("string") == self.value, F.lit(False))
        out = {k: v for k, v in t.items() if k != self.cls}
        return {**out, self.matching: t[self.cls].where(hit), self.rest: t[self.cls].where(~hit)}

    def backward(self, t: Tables) -> Tables:
        out = {k: v for k, v in t.items() if k not in (self.matching, self.rest)}
        return {**out, self.cls: t[self.matching].unionByName(t[self.rest], allowMissingColumns=True)}


@dataclass(frozen=True)
class MergeClasses:
    """Classes become one, which keeps the class of origin as a column."""

    classes: tuple[str, ...]
    into: str
    columns: tuple[tuple[str, ...], ...]  # the columns of each class

    def forward(self, t: Tables) -> Tables:
        out = {k: v for k, v in t.items() if k not in self.classes}
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t[c].withColumn("_origin", F.lit(c)) for c in self.classes])
        return {**out, self.into: merged}

    def backward(self, t: Tables) -> Tables:
        out = {k: v for k, v in t.items() if k != self.into}
        return {**out, **{c: t[self.into].where(F.col("_origin") == c).select(*cols) for c, cols in zip(self.classes, self.columns, strict=True)}}


@dataclass(frozen=True)
class PromoteProperty:
    """The values of a property become entities of a new class; the property holds their key instead."""

    cls: str
    name: str
    into: str

    def key(self, c):
        return F.concat(F.lit(f"{self.into}/"), F.substring(F.md5(c.cast("string")), 1, 12))

    def forward(self, t: Tables) -> Tables:
        values = t[self.cls].select(F.col(self.name).alias("label")).where("label is not null").distinct()
        return {**t, self.into: values.select(self.key(F.col("label")).alias("uri"), "label"), self.cls: t[self.cls].withColumn(self.name, self.key(F.col(self.name)))}

    def backward(self, t: Tables) -> Tables:
        labels = t[self.into].select(F.col("uri").alias(self.name), F.col("label").alias("_label"))
        joined = t[self.cls].join(labels, self.name, "left").withColumn(self.name, F.col("_label")).drop("_label")
        out = {k: v for k, v in t.items() if k != self.into}
        return {**out, self.cls: joined.select(*t[self.cls].columns)}


@dataclass(frozen=True)
class DemoteClass:
    """The inverse of PromoteProperty."""

    cls: str
    name: str
    into: str

    def forward(self, t: Tables) -> Tables:
        return PromoteProperty(self.cls, self.name, self.into).backward(t)

    def backward(self, t: Tables) -> Tables:
        return PromoteProperty(self.cls, self.name, self.into).forward(t)


def evolve(tables: Tables, ops: list) -> Tables:
    return reduce(lambda t, op: op.forward(t), ops, tables)


def view(tables: Tables, ops: list) -> Tables:
    """The version before ops, seen in the tables after them."""
    return reduce(lambda t, op: op.backward(t), reversed(ops), tables)
