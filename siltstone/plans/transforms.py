"""Restricted transform SQL: validation by a walk over the plan that Spark's own parser gives, column lineage by its analyzer, a DAG of transforms
with memoized runs."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.snapshots import content_fingerprint

# The functions a transform may call.
FUNCTIONS = frozenset("upper lower trim replace coalesce nullif abs round substr substring split_part concat concat_ws regexp_extract regexp_replace try_to_timestamp date_format date_part count sum min max avg cast try_cast if between".split())
_DDL, _DML = r"^\s*(create|drop|alter|truncate)\b", r"^\s*(insert|update|delete|merge)\b"
#: Nodes of a parsed plan that a transform may have, and the codes of those it is refused for; others are disallowed_construct.
_NODES = frozenset("Project Filter Aggregate Join Sort UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith OneRowRelation".split())
_REFUSED = {"Union": "set_operation", "Intersect": "set_operation", "Except": "set_operation", "WithWindowDefinition": "window_function", "LateralJoin": "bad_join"}
_JOINS = frozenset(["Inner", "LeftOuter"])
DEEPEST = 2


class TransformError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _bare(sql: str) -> str:
    """The statement without comments and with the content of its string literals taken out."""
    return re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S))


def validate_sql(spark: SparkSession, sql: str) -> None:
    """Refuse, with a code, what a transform may not do. The parser decides what is SQL at all."""
    bare = _bare(sql)
    if ";" in bare.strip().rstrip(";"):
        raise TransformError("multiple_statements")
    low = bare.lower()
    for code, pattern in (("ddl", _DDL), ("dml", _DML)):
        if re.search(pattern, low):
            raise TransformError(code)
    if not re.match(r"^\s*(select|with)\b", low):
        raise TransformError("not_select" if re.match(r"^\s*\w+", low) else "parse_error")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        raise TransformError("parse_error", str(e)[:200]) from e
    _check_plan(plan, 0)


def _items(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _check_plan(node, depth: int) -> None:
    """Walk a parsed plan with all of its subqueries; depth counts selects inside selects."""
    kind = node.getClass().getSimpleName()
    if kind == "Distinct":  # UNION without ALL stands below one
        kind = next(iter(_items(node.children()))).getClass().getSimpleName()
        kind = kind if kind in _REFUSED else "Distinct"
    if kind in _REFUSED:
        raise TransformError(_REFUSED[kind])
    if kind not in _NODES:
        raise TransformError("disallowed_construct", kind)
    if kind == "Join" and node.joinType().toString() not in _JOINS:
        raise TransformError("bad_join", node.joinType().toString())
    if kind in ("Project", "Aggregate"):
        depth += 1
        if depth - 1 > DEEPEST:
            raise TransformError("subquery_depth")
    for e in _items(node.expressions()):
        _check_expression(e, depth)
    if kind == "UnresolvedWith":
        for relation in _items(node.cteRelations()):
            _check_plan(relation._2(), depth)
    for child in _items(node.children()):
        _check_plan(child, depth)


def _check_expression(e, depth: int) -> None:
    kind = e.getClass().getSimpleName()
    if kind in ("WindowExpression", "UnresolvedWindowExpression"):
        raise TransformError("window_function")
    if kind == "UnresolvedFunction":
        name = e.nameParts().mkString(".").lower()
        if name not in FUNCTIONS:
            raise TransformError("disallowed_function", name)
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check_plan(e.plan(), depth)
    for child in _items(e.children()):
        _check_expression(child, depth)


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a transform's statement over tables, once it is found to be one."""
    validate_sql(spark, sql)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql.strip().rstrip(";"))


def lineage(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> dict[str, set[tuple[str, str]]]:
    """Output column: the (table, column)s it comes from, as the analyzer resolves them."""
    owner: dict[int, tuple[str, str]] = {}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    defined: dict[int, set[int]] = {}

    def items(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def walk(node, alias: str | None = None) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "SubqueryAlias":
            alias = alias if alias in tables else node.identifier().name()
        if not node.children().size() and kind not in ("OneRowRelation",):
            for a in items(node.output()):
                owner[a.exprId().id()] = (alias or "?", a.name())
        for e in items(node.expressions()):
            stack = [e]
            while stack:
                x = stack.pop()
                if x.getClass().getSimpleName() == "Alias":
                    defined.setdefault(x.exprId().id(), set()).update(r.exprId().id() for r in items(x.references().toSeq()))
                stack.extend(items(x.children()))
        for c in items(node.children()):
            walk(c, alias)

    walk(plan)

    def roots(i: int) -> set[tuple[str, str]]:
        if i in owner:
            return {owner[i]}
        return {r for j in defined.get(i, ()) for r in roots(j)}

    return {a.name(): roots(a.exprId().id()) for a in items(plan.output())}


@dataclass(frozen=True)
class Transform:
    name: str  # also the table it makes
    sql: str
    inputs: tuple[str, ...]

    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.name}\0{self.sql}\0{','.join(self.inputs)}".encode()).hexdigest()


def ordered(transforms: list[Transform]) -> list[Transform]:
    """Topological order, ties by name; a cycle or two makers of one table are refused."""
    by = {t.name: t for t in transforms}
    if len(by) < len(transforms):
        raise TransformError("duplicate_producer")
    done: list[Transform] = []
    left = dict(by)
    while left:
        ready = sorted(n for n, t in left.items() if not any(i in left for i in t.inputs))
        if not ready:
            raise TransformError("cycle", ", ".join(sorted(left)))
        done += [left.pop(n) for n in ready]
    return done


def affected(transforms: list[Transform], changed: set[str]) -> set[str]:
    """Transforms downstream of the changed tables."""
    out: set[str] = set()
    for t in ordered(transforms):
        if any(i in changed or i in out for i in t.inputs):
            out.add(t.name)
    return out


@dataclass
class Runner:
    """Runs transforms into a folder; a transform whose text and inputs' content are known is not run again."""

    spark: SparkSession
    root: str
    memo: dict[str, str] = field(default_factory=dict)

    def run(self, transforms: list[Transform], inputs: dict[str, DataFrame]) -> dict[str, str]:
        """name: 'success', 'memo', 'failed' or 'upstream_failed'. A failure stops only what hangs on it."""
        prints = {n: content_fingerprint(df) for n, df in inputs.items()}
        tables, status = dict(inputs), {}
        for t in ordered(transforms):
            if any(status.get(i) in ("failed", "upstream_failed") for i in t.inputs) or any(i not in tables for i in t.inputs):
                status[t.name] = "upstream_failed"
                continue
            key = hashlib.sha256(repr((t.fingerprint(), [prints[i] for i in t.inputs])).encode()).hexdigest()
            path = f"{self.root}/{t.name}-{key[:16]}"
            try:
                if key not in self.memo:
                    validate_sql(self.spark, t.sql)
                    for i in t.inputs:
                        tables[i].createOrReplaceTempView(i)
                    self.spark.sql(t.sql).write.mode("overwrite").parquet(path)
                    self.memo[key] = path
                    status[t.name] = "success"
                else:
                    status[t.name] = "memo"
                tables[t.name] = self.spark.read.parquet(self.memo[key])
                prints[t.name] = content_fingerprint(tables[t.name])
            except Exception:  # one transform's failure is its own
                status[t.name] = "failed"
        self.tables = tables
        return status
