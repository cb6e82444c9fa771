"""Schema induction: candidate classes from keys and dependencies, synonymous columns, formal concepts.

All of this has the size of metadata (columns, not rows) and runs on the driver, on summaries that one job each has
gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """Objects and the attributes that each has."""

    objects: tuple[str, ...]
    attributes: tuple[str, ...]
    has: frozenset[tuple[str, str]]

    def common_attributes(self, objects) -> frozenset[str]:
        return frozenset(a for a in self.attributes if all((o, a) in self.has for o in objects))

    def common_objects(self, attributes) -> frozenset[str]:
        return frozenset(o for o in self.objects if all((o, a) in self.has for a in attributes))


def context_of(incidence: DataFrame, obj: str, attr: str) -> Context:
    """From rows (object, attribute): tables and their columns, not the tables' rows."""
    pairs = frozenset((r[0], r[1]) for r in incidence.select(obj, attr).where(F.col(obj).isNotNull() & F.col(attr).isNotNull()).distinct().collect())
    return Context(tuple(sorted({o for o, _ in pairs})), tuple(sorted({a for _, a in pairs})), pairs)


def concepts(context: Context, support: float = 0.0) -> list[tuple[frozenset[str], frozenset[str]]]:
    """All (extent, intent) whose extent holds at least the support's share of the objects, by closing one attribute
    after the other in a fixed order; each closure is found once."""
    found: list[tuple[frozenset[str], frozenset[str]]] = []
    least = support * len(context.objects)

    def close(extent: frozenset[str], intent: frozenset[str], start: int) -> None:
        found.append((extent, intent))
        for i in range(start, len(context.attributes)):
            a = context.attributes[i]
            if a in intent:
                continue
            smaller = frozenset(o for o in extent if (o, a) in context.has)
            if len(smaller) < max(least, 1 if least else 0):
                continue
            wider = context.common_attributes(smaller)
            # canonical only if closing brings in no earlier attribute
            if all(b in intent for b in wider if context.attributes.index(b) < i):
                close(smaller, wider, i + 1)

    top = frozenset(context.objects)
    close(top, context.common_attributes(top), 0)
    return found


def stability(context: Context, extent: frozenset[str], intent: frozenset[str], exact_up_to: int = 12, samples: int = 2048) -> float:
    """Share of the extent's subsets that have the same intent; from seeded samples where it is large."""
    members = sorted(extent)
    if len(members) <= exact_up_to:
        subsets = [s for n in range(len(members) + 1) for s in combinations(members, n)]
    else:
        import random

        rnd = random.Random(17)
        subsets = [tuple(m for m in members if rnd.random() < 0.5) for _ in range(samples)]
    return sum(context.common_attributes(s) == intent for s in subsets) / len(subsets)


def covers(found: list[tuple[frozenset[str], frozenset[str]]]) -> list[tuple[int, int]]:
    """(lower, upper) pairs of concepts with none between them."""
    out = []
    for i, (e, _) in enumerate(found):
        above = [j for j, (f, _) in enumerate(found) if e < f]
        out += [(i, j) for j in above if not any(found[k][0] < found[j][0] for k in above)]
    return out


def normal_name(column: str) -> str:
    """Words of a column name, in lower case: camel and snake case split, plural endings dropped."""
    words = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", column).lower())
    return " ".join(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words if w)


def synonyms(columns: list[str], included: set[tuple[str, str]], similar: float = 0.6) -> dict[str, str]:
    """column: the smallest of its group. Columns table.column are one if an inclusion holds between them and they
    share a word, or if their words have a Jaccard similarity of at least similar."""
    root = {c: c for c in columns}

    def find(c: str) -> str:
        while root[c] != c:
            c = root[c]
        return c

    words = {c: set(normal_name(c.split(".", 1)[1]).split()) for c in columns}
    for a, b in combinations(sorted(columns), 2):
        shared, either = words[a] & words[b], words[a] | words[b]
        if shared and ((a, b) in included or (b, a) in included or len(shared) / len(either) >= similar):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {c: find(c) for c in columns}


def key_classes(profiles: dict[str, list[tuple[str, int]]]) -> list[tuple[str, str]]:
    """(table, key) of every table with a key: profiles are candidate keys (columns, width), the narrowest first."""
    return [(t, min(keys, key=lambda k: (k[1], k[0]))[0]) for t, keys in sorted(profiles.items()) if keys]


def dependency_classes(dependencies: list[tuple[str, str, float]], distinct: dict[str, int], rows: int) -> dict[str, list[str]]:
    """key column: its dependents. A column that determines others, and has at most half as many values as the table
    has rows, stands for an entity of its own inside the table."""
    out: dict[str, list[str]] = {}
    for lhs, rhs, confidence in dependencies:
        if lhs and "," not in lhs and confidence >= 0.98 and distinct.get(lhs, rows) <= rows / 2:
            out.setdefault(lhs, []).append(rhs)
    return {k: sorted(v) for k, v in sorted(out.items())}
