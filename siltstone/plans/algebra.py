"""The typed query algebra: immutable terms, a type-check on metadata, and compilation to DataFrames.

A world is an ontology (classes, links between them) and one wide DataFrame per class. A term compiles to one lazy
plan, so Catalyst prunes columns and pushes conditions down to the scans. Citations are a table of their own
(`citations`): one row per answer row and entity behind it, never an array that grows with a group.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.unit_conversion import unit_factor

OPS = ("=", "!=", "<", "<=", ">", ">=", "contains", "in", "between")
AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class ClassDef:
    name: str
    key: str
    properties: dict[str, str]  # name: string, text, integer, float, boolean, date, datetime
    parents: tuple[str, ...] = ()
    units: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Link:
    """source.column holds the key of target."""

    name: str
    source: str
    column: str
    target: str


@dataclass(frozen=True)
class Ontology:
    classes: dict[str, ClassDef]
    links: dict[str, Link]

    def descendants(self, name: str) -> list[str]:
        below = [c.name for c in self.classes.values() if name in c.parents]
        return [name, *dict.fromkeys(d for b in sorted(below) for d in self.descendants(b))]

    def properties(self, name: str) -> dict[str, str]:
        own = self.classes[name]
        return {**{k: v for p in own.parents for k, v in self.properties(p).items()}, **own.properties}


@dataclass(frozen=True)
class World:
    ontology: Ontology
    tables: dict[str, DataFrame]
    relax: int = 0  # 0: texts equal as they stand, 1: in any case, 2: as names without punctuation and legal forms


@dataclass(frozen=True)
class Condition:
    path: str  # a property, or link.link.property
    op: str
    value: object
    unit: str | None = None  # of the value, if it isn't the property's


@dataclass(frozen=True)
class Select:
    cls: str
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Traverse:
    source: object
    link: str
    reverse: bool = False
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class TextJoin:
    source: object
    prop: str
    pattern: str


@dataclass(frozen=True)
class Aggregate:
    source: object
    agg: str
    measure: str | None = None
    group_by: tuple[str, ...] = ()
    having: tuple[str, float] | None = None


@dataclass(frozen=True)
class TopK:
    source: object
    by: str
    k: int
    descending: bool = True


def class_of(term, ontology: Ontology) -> str | None:
    """The class of a term's rows; None once they are aggregated."""
    if isinstance(term, Select):
        return term.cls
    if isinstance(term, Traverse):
        link = ontology.links.get(term.link)
        return link and (link.source if term.reverse else link.target)
    if isinstance(term, TextJoin):
        return class_of(term.source, ontology)
    if isinstance(term, TopK):
        return class_of(term.source, ontology)
    return None


def output_name(term: Aggregate) -> str:
    return f"{term.agg}_{term.measure or 'rows'}"


def _path_errors(cls: str, path: str, ontology: Ontology) -> list[str]:
    *hops, prop = path.split(".")
    for hop in hops:
        link = ontology.links.get(hop)
        if link is None or link.source not in ontology.descendants(cls) and cls not in ontology.descendants(link.source):
            return [f"phantom traversal: {cls} has no link {hop}"]
        cls = link.target
    known = {p for c in ontology.descendants(cls) for p in ontology.properties(c)}
    return [] if prop in known else [f"unknown property: {cls}.{prop}"]


def unit_of_property(cls: str, path: str, ontology: Ontology) -> str | None:
    """The unit of the property at the end of a path, its own class's before those of its ancestors."""
    *hops, prop = path.split(".")
    cls = ontology.links[hops[-1]].target if hops else cls
    own = ontology.classes[cls]
    return own.units.get(prop) or next((u for p in own.parents if (u := unit_of_property(p, prop, ontology))), None)


def in_unit_of(condition: Condition, cls: str, ontology: Ontology) -> object:
    """The value of a condition on a property of cls in the property's unit."""
    prop = condition.path.split(".")[-1]
    factor = unit_factor(condition.unit, unit_of_property(cls, prop, ontology))
    if factor == 1.0 or condition.unit is None:
        return condition.value
    value = condition.value
    return tuple(v * factor for v in value) if isinstance(value, (tuple, list)) else value * factor


def _condition_errors(cls: str, c: Condition, ontology: Ontology) -> list[str]:
    errors = _path_errors(cls, c.path, ontology) + ([] if c.op in OPS else [f"unknown comparison: {c.op}"])
    if not errors and c.unit is not None:
        values = c.value if isinstance(c.value, (tuple, list)) else [c.value]
        if not all(isinstance(v, (int, float)) for v in values):
            errors.append(f"not a quantity: {c.value} {c.unit}")
        elif unit_factor(c.unit, unit_of_property(cls, c.path, ontology)) is None:
            errors.append(f"units don't convert: {c.unit} to {unit_of_property(cls, c.path, ontology)}")
    return errors


def typecheck(term, ontology: Ontology) -> list[str]:
    """What is wrong with a term; an empty list if it can be compiled. Looks at metadata only."""
    if isinstance(term, Select):
        if term.cls not in ontology.classes:
            return [f"unknown class: {term.cls}"]
        return [e for c in term.conditions for e in _condition_errors(term.cls, c, ontology)]
    errors = typecheck(term.source, ontology)
    if errors:
        return errors
    cls = class_of(term.source, ontology)
    if isinstance(term, Traverse):
        link = ontology.links.get(term.link)
        if cls is None:
            return ["wrong grain: an aggregate can't be traversed"]
        start = link and (link.target if term.reverse else link.source)
        if link is None or cls not in ontology.descendants(start) and start not in ontology.descendants(cls):
            return [f"phantom traversal: {cls} has no link {term.link}" + (" in reverse" if term.reverse else "")]
        return [e for c in term.conditions for e in _condition_errors(class_of(term, ontology), c, ontology)]
    if isinstance(term, TextJoin):
        if cls is None:
            return ["wrong grain: text of an aggregate"]
        return _path_errors(cls, term.prop, ontology) or ([] if ontology.properties(cls).get(term.prop) in ("text", "string") else [f"not a text: {term.prop}"])
    if isinstance(term, Aggregate):
        if cls is None:
            return ["wrong grain: an aggregate of an aggregate"]
        errors = [e for p in [*term.group_by, *([term.measure] if term.measure else [])] for e in _path_errors(cls, p, ontology)]
        if term.agg not in AGGREGATES:
            errors.append(f"unknown aggregate: {term.agg}")
        if term.agg != "count" and not term.measure:
            errors.append(f"{term.agg} needs a measure")
        if not errors and term.measure and term.agg in ("sum", "avg") and ontology.properties(cls).get(term.measure) not in ("integer", "float"):
            errors.append(f"not a number: {term.measure}")
        return errors
    if isinstance(term, TopK):
        if term.k < 1:
            return ["k must be at least 1"]
        if cls is None:
            names = {*term.source.group_by, output_name(term.source)}
            return [] if term.by in names else [f"unknown column: {term.by}"]
        return _path_errors(cls, term.by, ontology)
    return [f"unknown term: {type(term).__name__}"]


# Legal forms that a relaxed comparison of names leaves out.
LEGAL_FORMS = ("INC", "LLC", "CORP", "CO", "LTD", "COMPANY", "CORPORATION", "INCORPORATED")


def plain_name(c: Column) -> Column:
    """A name for relaxed comparison: upper case, punctuation as blanks, AIRLINES in two words, no legal forms."""
    t = F.regexp_replace(F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " ")), r"\bAIRLINES\b", "AIR LINES")
    return F.array_join(F.filter(F.split(F.trim(t), r"\s+"), lambda w: ~w.isin(*LEGAL_FORMS)), " ")


def _same_text(c: Column, value: str, relax: int) -> Column:
    same = F.trim(c.cast("string")) == value.strip()
    if relax >= 1:
        same = same | (F.lower(F.trim(c.cast("string"))) == value.strip().lower())
    if relax >= 2:
        same = same | (plain_name(c.cast("string")) == plain_name(F.lit(value)))
    return same


def _compare(c: Column, op: str, value: object, relax: int = 0) -> Column:
    """A comparison by the rules of the algebra: numbers as doubles, texts trimmed; null never holds. relax widens the
    equality of texts."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if op == "contains":
        hit = F.instr(F.lower(c.cast("string")), str(value).lower()) > 0
    elif op == "in":
        hit = reduce(lambda a, b: a | b, [_same_text(c, str(v), relax) for v in value], F.lit(False)) if relax else F.trim(c.cast("string")).isin([str(v).strip() for v in value])
    elif op == "between":
        low, high = value
        side = c.try_cast("double") if isinstance(low, (int, float)) else c
        hit = side.between(F.lit(low), F.lit(high))
    elif relax and isinstance(value, str) and op in ("=", "!="):
        same = _same_text(c, value, relax)
        hit = same if op == "=" else ~same
    else:
        side = c.try_cast("double") if number else (F.trim(c) if isinstance(value, str) else c)
        other = F.lit(float(value)) if number else F.lit(value.strip() if isinstance(value, str) else value)
        hit = {"=": side == other, "!=": side != other, "<": side < other, "<=": side <= other, ">": side > other, ">=": side >= other}[op]
    return F.coalesce(hit, F.lit(False))


def extent(world: World, cls: str) -> DataFrame:
    """All rows of a class and its descendants, with _id."""
    parts = []
    for name in world.ontology.descendants(cls):
        if name in world.tables:
            parts.append(world.tables[name].withColumn("_id", F.col(world.ontology.classes[name].key).cast("string")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _restrict(world: World, df: DataFrame, cls: str, conditions: tuple[Condition, ...]) -> DataFrame:
    for c in conditions:
        *hops, prop = c.path.split(".")
        if not hops:
            df = df.where(_compare(F.col(prop), c.op, in_unit_of(c, cls, world.ontology), world.relax))
            continue
        # true if any end of the path fits: semi-joins from the far end back
        links = [world.ontology.links[h] for h in hops]
        end = extent(world, links[-1].target).where(_compare(F.col(prop), c.op, in_unit_of(c, links[-1].target, world.ontology), world.relax))
        for i in range(len(links) - 1, -1, -1):
            keys = end.select(F.col(world.ontology.classes[links[i].target].key).alias("_key")).where("_key is not null")
            start = df if i == 0 else extent(world, links[i].source)
            end = start.join(keys, start[links[i].column] == keys["_key"], "left_semi")
        df = end
    return df


def _keyed(term: Aggregate, source: DataFrame, world: World) -> tuple[DataFrame, list[Column]]:
    """source with what an aggregate's keys need, and the keys as texts."""
    ontology, keys = world.ontology, []
    for path in term.group_by:
        if "." in path:
            hop, prop = path.split(".")
            link = ontology.links[hop]
            side = extent(world, link.target).groupBy(F.col(ontology.classes[link.target].key).alias(f"_k{len(keys)}")).agg(F.min_by(prop, F.col("_id")).alias(f"_v{len(keys)}"))
            source = source.join(side, source[link.column] == side[f"_k{len(keys)}"], "left").drop(f"_k{len(keys)}")
            keys.append(F.col(f"_v{len(keys)}").cast("string").alias(path.replace(".", "_")))
        else:
            keys.append(F.col(path).cast("string").alias(path))
    return source, keys


def compile_term(term, world: World) -> DataFrame:
    """The DataFrame of a term that passes the type-check."""
    if errors := typecheck(term, world.ontology):
        raise ValueError("; ".join(errors))
    return _compile(term, world)


def _compile(term, world: World) -> DataFrame:
    ontology = world.ontology
    if isinstance(term, Select):
        return _restrict(world, extent(world, term.cls), term.cls, term.conditions)
    source = _compile(term.source, world)
    if isinstance(term, TextJoin):
        return source.where(_compare(F.col(term.prop), "contains", term.pattern))
    if isinstance(term, Traverse):
        link = ontology.links[term.link]
        cls = class_of(term, ontology)
        target = _restrict(world, extent(world, cls), cls, term.conditions)
        here, there = (ontology.classes[link.target].key, link.column) if term.reverse else (link.column, ontology.classes[link.target].key)
        carried = [c for c in source.columns if c not in target.columns]
        # each target once, with the other columns of its first source
        first = source.where(F.col(here).isNotNull()).groupBy(F.col(here).alias("_from")).agg(F.min_by(F.struct(*[F.col(c) for c in carried], F.lit(1).alias("_one")), F.col("_id")).alias("_up"))
        joined = target.join(first, target[there] == first["_from"])
        return joined.select(*[target[c] for c in target.columns], *[F.col(f"_up.{c}").alias(c) for c in carried])
    if isinstance(term, Aggregate):
        source, keys = _keyed(term, source, world)
        name = output_name(term)
        if term.agg == "count":
            value = F.count(F.lit(1)) if term.measure is None else F.count_distinct(F.col(term.measure).cast("string"))
        else:
            number = F.col(term.measure).try_cast("double")
            source = source.where(number.isNotNull())
            value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[term.agg](number)
        out = source.groupBy(*keys).agg(value.alias(name))
        if term.having:
            op, limit = term.having
            out = out.where(_compare(F.coalesce(F.col(name), F.lit(0.0)), op, limit))
        return out
    if isinstance(term, TopK):
        by = F.coalesce(F.col(term.by).try_cast("double"), F.lit(0.0))
        ties = [F.col(c).cast("string").asc_nulls_last() for c in (source.columns if "_id" not in source.columns else ["_id"])]
        return source.orderBy(by.desc() if term.descending else by.asc(), *ties).limit(term.k)
    raise TypeError(type(term).__name__)


def answer(term, world: World, columns: list[str]) -> DataFrame:
    """Projected rows of a term as a set: rows with a missing or blank value are left out, repeated ones merged."""
    df = compile_term(term, world)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in columns])
    return df.where(whole).select(*columns).distinct()


def citations(term, world: World, columns: list[str] | None = None) -> DataFrame:
    """(columns, class, entity): every entity behind each answer row. Of an aggregate the columns are its keys, and a row's
    entities are those whose measure counts in its group; groups that having leaves out cite nothing."""
    if isinstance(term, TopK) and isinstance(term.source, Aggregate):
        names = [p.replace(".", "_") for p in term.source.group_by]
        kept = compile_term(term, world).select(*names)
        cited = citations(term.source, world)
        return cited.join(kept, reduce(lambda a, b: a & b, [cited[n].eqNullSafe(kept[n]) for n in names], F.lit(True)), "left_semi")
    if not isinstance(term, Aggregate):
        df = compile_term(term, world)
        return df.select(*(columns or []), F.lit(class_of(term, world.ontology)).alias("class"), F.col("_id").alias("entity")).distinct()
    out = compile_term(term, world)
    cls = class_of(term.source, world.ontology)
    rows, keys = _keyed(term, _compile(term.source, world), world)
    if term.agg != "count":
        rows = rows.where(F.col(term.measure).try_cast("double").isNotNull())
    names = [p.replace(".", "_") for p in term.group_by]
    cited = rows.select(*keys, F.lit(cls).alias("class"), F.col("_id").alias("entity")).distinct()
    if not term.having:
        return cited
    return cited.join(out.select(*names), reduce(lambda a, b: a & b, [cited[n].eqNullSafe(out[n]) for n in names], F.lit(True)), "left_semi")


class EmptyResult(Exception):
    """Nothing to answer with: the question abstains."""


def answered(term, world: World, columns: list[str] | None = None, most_relaxed: int = 2) -> tuple[DataFrame, int]:
    """The first answer that isn't empty, with texts compared more and more loosely, and how loosely (0 to 2). Raises
    EmptyResult if none is: an aggregate over nothing is no zero."""
    for relax in range(most_relaxed + 1):
        loose = replace(world, relax=relax)
        found = answer(term, loose, columns) if columns else compile_term(term, loose)
        base = term.source if isinstance(term, TopK) else term
        if isinstance(base, Aggregate) and not base.group_by:
            # one row in any case: what counts is whether anything stands behind it
            if citations(base, loose).isEmpty() or found.isEmpty():
                continue
            return found, relax
        if not found.isEmpty():
            return found, relax
    raise EmptyResult(type(term).__name__)
