"""Grounding of questions: an index of values, phrases matched to classes, properties and values, candidate terms
that pass the type-check, and bands for answering, asking back or abstaining."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.resolve import jaro_winkler
from siltstone.plans.algebra import Aggregate, Condition, Ontology, Select, TopK, World, extent, typecheck
from siltstone.plans.induce import normal_name

ANSWER, CLARIFY = 0.60, 0.45
AGGREGATE_WORDS = {"average": "avg", "mean": "avg", "total": "sum", "sum": "sum", "most": "max", "highest": "max", "lowest": "min", "smallest": "min", "count": "count", "many": "count", "number": "count"}


def value_index(world: World) -> DataFrame:
    """(value, class, property, n): all distinct values of text properties. Only those equal to a question's words
    are read, so their number has no bound."""
    parts = None
    for name, c in sorted(world.ontology.classes.items()):
        props = [p for p, kind in c.properties.items() if kind == "string"]
        if name in world.tables and props:
            each = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.lower(F.trim(F.col(p))).alias("value")) for p in props]))
            rows = extent(world, name).select(each.alias("x")).select("x.*").where("value is not null and value <> ''").groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))
            rows = rows.select("value", F.lit(name).alias("class"), "property", "n")
            parts = rows if parts is None else parts.unionByName(rows)
    return parts


@dataclass(frozen=True)
class Candidate:
    term: object
    score: float


def _match(words: list[str], name: str) -> float:
    """How much of a name the words say: the share of its tokens that occur, misspellings counting less."""
    tokens = normal_name(name).split()
    best = [max((jaro_winkler(t, w) for w in words), default=0.0) for t in tokens]
    return sum(b if b >= 0.9 else 0.0 for b in best) / len(best) if best else 0.0


def candidates(question: str, ontology: Ontology, values: DataFrame | None = None, most: int = 8) -> list[Candidate]:
    """Terms that the question may mean, best first: class, measure, aggregate, breakdown and known values."""
    words = [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.findall(r"[a-z0-9]+", question.lower())]
    known = []
    if values is not None and words:
        hit = values.where(F.col("value").isin(sorted({*words, *(" ".join(words[i : i + 2]) for i in range(len(words) - 1))}))).orderBy(F.desc("n"), "class", "property").limit(most)
        known = [(r["class"], r["property"], r["value"]) for r in hit.collect()]
    agg = next((AGGREGATE_WORDS[w] for w in words if w in AGGREGATE_WORDS), None)
    top = re.search(r"\btop (\d+)\b", question.lower())
    found = []
    for name, c in sorted(ontology.classes.items()):
        base = _match(words, name)
        if not base:
            continue
        strip = lambda p: re.sub(r"^[a-z]_", "", p)
        numbers = [(p, _match(words, strip(p))) for p, k in ontology.properties(name).items() if k in ("integer", "float") and p != c.key]
        groups = [(p, _match(words, strip(p))) for p, k in ontology.properties(name).items() if k in ("string", "boolean")]
        groups += [(f"{n}.{p}", _match(words, strip(p))) for n, link in ontology.links.items() if link.source == name for p, k in ontology.properties(link.target).items() if k == "string"]
        conditions = tuple(Condition(p, "=", v) for cls, p, v in known if cls == name)
        source = Select(name, conditions)
        measure, m = max(numbers, key=lambda x: x[1], default=(None, 0.0))
        by, g = max(groups, key=lambda x: x[1], default=(None, 0.0))
        if agg == "count":
            found.append(Candidate(Aggregate(source, "count", None, (by,) if g else ()), (base + (g or 1.0)) / 2))
        elif agg and measure and m:
            term = Aggregate(source, agg, measure, (by,) if g else ())
            found.append(Candidate(TopK(term, f"{agg}_{measure}", int(top[1])) if top else term, (base + m + (g or m)) / 3))
        else:
            found.append(Candidate(source, base * (0.6 if not conditions else 0.8)))
    sound = [c for c in found if not typecheck(c.term, ontology)]
    return sorted(sound, key=lambda c: (-c.score, repr(c.term)))[:most]


def decide(found: list[Candidate]) -> tuple[str, Candidate | None]:
    """'answer' with the best candidate, 'clarify' if it is weak or another is as good, 'abstain' if there is none."""
    if not found or found[0].score < CLARIFY:
        return ("abstain", None)
    if found[0].score < ANSWER or len(found) > 1 and found[1].score >= 0.98 * found[0].score:
        return ("clarify", found[0])
    return ("answer", found[0])
