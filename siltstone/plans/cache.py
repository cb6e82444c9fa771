"""Answers kept with the fingerprint of what they were made from: a stale answer is never given."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from siltstone.plans.algebra import World, compile_term
from siltstone.session import cut, discard
from siltstone.sources.snapshots import content_fingerprint


@dataclass
class AnswerCache:
    world: World
    kept: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    hits: int = 0

    def _state(self, term) -> str:
        classes = sorted(c for c in self.world.tables if c in repr(term) or any(c in (link.source, link.target) and name in repr(term) for name, link in self.world.ontology.links.items()))
        return hashlib.sha256(repr([(c, content_fingerprint(self.world.tables[c])) for c in classes]).encode()).hexdigest()

    def answer(self, term) -> DataFrame:
        key, state = repr(term), self._state(term)
        if key in self.kept:
            if self.kept[key][0] == state:
                self.hits += 1
                return self.kept[key][1]
            discard(self.kept.pop(key)[1])
        self.kept[key] = (state, cut(compile_term(term, self.world)))
        return self.kept[key][1]
