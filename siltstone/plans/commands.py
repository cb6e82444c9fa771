"""Imperative commands on a model: parsed into schema operators, previewed on the data, vetoed at low coverage."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import evolve

VETO, WARN = 0.35, 0.95

# The six kinds of command and how they are said.
GRAMMAR = {
    "rename": r"rename (?P<cls>\w+)\.(?P<old>\w+) to (?P<new>\w+)",
    "retype": r"retype (?P<cls>\w+)\.(?P<name>\w+) as (?P<kind>int|bigint|double|date|string)",
    "merge": r"merge (?P<a>\w+) and (?P<b>\w+) into (?P<into>\w+)",
    "split": r"split (?P<cls>\w+) by (?P<name>\w+) = (?P<value>\S+) into (?P<matching>\w+) and (?P<rest>\w+)",
    "link": r"link (?P<cls>\w+)\.(?P<name>\w+) to (?P<target>\w+)\.(?P<key>\w+)",
    "synonym": r"(?P<cls>\w+)\.(?P<a>\w+) is the same as (?P<b>\w+)",
}


@dataclass(frozen=True)
class Command:
    kind: str
    arguments: dict


def parse_command(text: str) -> Command | None:
    """The command a text gives, or None."""
    for kind, pattern in GRAMMAR.items():
        if m := re.fullmatch(pattern, " ".join(text.split()), flags=re.I):
            return Command(kind, m.groupdict())
    return None


def coverage(command: Command, tables: dict[str, DataFrame]) -> float:
    """Share of the values that a command would keep, by one read-only aggregation."""
    a = command.arguments
    if command.kind == "retype":
        c = F.col(a["name"])
        r = tables[a["cls"]].agg(F.count(c).alias("n"), F.count(c.cast("string").try_cast(a["kind"])).alias("ok")).first()
        return r["ok"] / r["n"] if r["n"] else 1.0
    if command.kind == "link":
        keys = tables[a["target"]].select(F.col(a["key"]).cast("string").alias("k")).distinct()
        rows = tables[a["cls"]].select(F.col(a["name"]).cast("string").alias("k")).where("k is not null")
        n = rows.count()
        return rows.join(keys, "k", "left_semi").count() / n if n else 1.0
    if command.kind == "synonym":
        r = tables[a["cls"]].where(F.col(a["a"]).isNotNull() & F.col(a["b"]).isNotNull()).agg(F.avg((F.col(a["a"]).cast("string") == F.col(a["b"]).cast("string")).cast("double")).alias("s")).first()
        return 1.0 if r["s"] is None else r["s"]
    if command.kind == "split":
        hit = tables[a["cls"]].agg(F.avg((F.col(a["name"]).cast("string") == a["value"]).cast("double")).alias("s")).first()["s"]
        return 1.0 if hit else 0.0
    return 1.0


def operator(command: Command, tables: dict[str, DataFrame]):
    """The schema operator that does what a command says; link and synonym only concern metadata."""
    a = command.arguments
    if command.kind == "rename":
        return evolve.RenameProperty(a["cls"], a["old"], a["new"])
    if command.kind == "merge":
        return evolve.MergeClasses((a["a"], a["b"]), a["into"], (tuple(tables[a["a"]].columns), tuple(tables[a["b"]].columns)))
    if command.kind == "split":
        return evolve.SplitClass(a["cls"], a["name"], a["value"], a["matching"], a["rest"])
    if command.kind == "retype" and a["kind"] == "double":
        return evolve.RetypeProperty(a["cls"], a["name"], old_type=dict(tables[a["cls"]].dtypes)[a["name"]])
    return None


def apply(text: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], object, str]:
    """(tables after it, operator for undoing it, 'done', 'warned' or 'vetoed')."""
    command = parse_command(text)
    if command is None:
        raise ValueError(f"not a command: {text}")
    share = coverage(command, tables)
    if share < VETO:
        return (tables, None, "vetoed")
    op = operator(command, tables)
    return (op.forward(tables) if op else tables, op, "done" if share >= WARN else "warned")


def undo(tables: dict[str, DataFrame], op) -> dict[str, DataFrame]:
    return op.backward(tables) if op else tables
