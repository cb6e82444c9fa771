"""The bitemporal cell store: visibility, survivorship, pivot, history, ordered commits, links and reachability.

Cells: seq long, entity_uri, prop, value_json, value_str strings, value_num double, valid_from, valid_to, created_at,
expired_at long (microseconds, half-open), prov_ref string, confidence double, src_rank int.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.functions.numbering import numbered
from siltstone.session import cut

FOREVER = 2**62
CELL_SCHEMA = "seq long, entity_uri string, prop string, value_json string, value_str string, value_num double, valid_from long, valid_to long, created_at long, expired_at long, prov_ref string, confidence double, src_rank int"
LINK_SCHEMA = "seq long, subject_uri string, predicate string, object_uri string, valid_from long, valid_to long, created_at long, expired_at long, prov_ref string, confidence double, props_json string"


def current() -> Column:
    return (F.col("valid_to") >= FOREVER) & (F.col("expired_at") >= FOREVER)


def as_of(at: int) -> Column:
    """Believed now about the instant at."""
    return (F.col("expired_at") >= FOREVER) & (F.col("valid_from") <= at) & (F.col("valid_to") > at)


def as_known_at(at: int) -> Column:
    """Believed at the instant at about that instant."""
    return audit(at, at)


def audit(valid_at: int, known_at: int) -> Column:
    return (F.col("valid_from") <= valid_at) & (F.col("valid_to") > valid_at) & (F.col("created_at") <= known_at) & (F.col("expired_at") > known_at)


def ever() -> Column:
    return F.col("expired_at") >= FOREVER


def winners(cells: DataFrame) -> DataFrame:
    """One cell per entity and property: smallest src_rank, then highest confidence, created_at, seq. A single hash
    aggregation with partial merging: no sort of the cells."""
    # a missing confidence is the lowest
    order = F.struct(F.col("src_rank"), -F.coalesce(F.col("confidence"), F.lit(float("-inf"))), -F.col("created_at"), -F.col("seq"))
    rest = [c for c in cells.columns if c not in ("entity_uri", "prop")]
    best = cells.groupBy("entity_uri", "prop").agg(F.min_by(F.struct(*rest), order).alias("w"))
    return best.select("entity_uri", "prop", *[F.col(f"w.{c}").alias(c) for c in rest])


def scan(cells: DataFrame, stance: Column, equal: dict[str, str] | None = None) -> DataFrame:
    """Visible winners; entities must have the given values, tested after survivorship."""
    won = winners(cells.where(stance))
    for prop, value in (equal or {}).items():
        holders = won.where((F.col("prop") == prop) & (F.col("value_str") == value)).select("entity_uri")
        won = won.join(holders, "entity_uri", "left_semi")
    return won


def pivot(won: DataFrame, props: list[str], value: str = "value_num") -> DataFrame:
    """One row per entity with a column per property; the list of properties is given, so no extra job finds it."""
    return won.where(F.col("prop").isin(props)).groupBy("entity_uri").agg(*[F.max(F.when(F.col("prop") == p, F.col(value))).alias(p) for p in props])


def history(cells: DataFrame, entity: str | None = None, prop: str | None = None) -> DataFrame:
    """All cells, superseded ones too, in order of creation."""
    if entity is not None:
        cells = cells.where(F.col("entity_uri") == entity)
    if prop is not None:
        cells = cells.where(F.col("prop") == prop)
    return cells.orderBy("entity_uri", "prop", "created_at", "seq")


def _supersedes(new: dict, old: dict, now: int) -> bool:
    if new["src_rank"] != old["src_rank"]:
        return new["src_rank"] < old["src_rank"]
    if new["confidence"] != old["confidence"]:
        return new["confidence"] > old["confidence"]
    return now >= old["created_at"]


def fold_commit(rows: list[dict], now: int, always: bool = False) -> list[dict]:
    """Cells of one entity and property after incoming ones (incoming True) are applied in order of seq.

    An incoming cell that doesn't supersede every open cell it overlaps is dead on arrival, open for one
    microsecond; with always, as for links, the newer one supersedes. Otherwise what it overlaps is closed, and the parts
    of it outside the new one's valid time are asserted again. Such parts have no seq yet, and the seq of the cell they
    are a part of as origin."""
    held = [{**r, "origin": r["seq"]} for r in rows if not r["incoming"]]
    for new in sorted((dict(r) for r in rows if r["incoming"]), key=lambda r: r["seq"]):
        new["created_at"], new["expired_at"], new["origin"] = now, FOREVER, new["seq"]
        over = [o for o in held if o["expired_at"] >= FOREVER and o["valid_from"] < new["valid_to"] and new["valid_from"] < o["valid_to"]]
        if not always and any(not _supersedes(new, o, now) for o in over):
            new["expired_at"] = now + 1
        else:
            for o in over:
                o["expired_at"] = max(now, o["created_at"] + 1)
                for low, high in ((o["valid_from"], new["valid_from"]), (new["valid_to"], o["valid_to"])):
                    if low < high:
                        held.append({**o, "seq": None, "valid_from": low, "valid_to": high, "created_at": now, "expired_at": FOREVER})
        held.append(new)
    return held


def _folded(store: DataFrame, batch: DataFrame, keys: list[str], now: int, always: bool) -> DataFrame:
    """The store after a batch. Only the keys that the batch touches are folded; the others pass as they are. Cells that
    are asserted again are numbered after all others, over the whole store."""
    touched = batch.select(*keys).distinct()
    untouched = store.join(touched, keys, "left_anti")
    both = store.join(touched, keys, "left_semi").withColumn("incoming", F.lit(False)).unionByName(batch.withColumn("incoming", F.lit(True)))
    columns = store.columns
    kinds = StructType([*store.schema.fields, StructField("origin", LongType())])
    form = to_arrow_schema(kinds)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, a key after the other; of one key's rows no more than they are is held."""
        key, held, done = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    done += fold_commit(held, now, always) if held else []
                    key, held = own, []
                held.append(row)
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist(done, schema=form)
                done = []
        done += fold_commit(held, now, always) if held else []
        yield pa.RecordBatch.from_pylist(done, schema=form)

    ordered = both.repartition(*keys).sortWithinPartitions(*keys)
    folded = cut(ordered.mapInArrow(apply, kinds))
    last = store.agg(F.max("seq")).unionByName(batch.agg(F.max("seq"))).agg(F.max("max(seq)")).first()[0] or 0
    fresh = numbered(folded.where("seq is null").drop("seq"), [*keys, "valid_from", "origin"], last + 1, "seq")
    return untouched.unionByName(folded.where("seq is not null").drop("origin")).unionByName(fresh.drop("origin")).select(*columns)


def commit(cells: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """The store after a batch. All of the batch is validated first: a cell without provenance, with a closed system
    time, or with a human's rank 0 from a pipeline refuses the whole batch. seq is unique over the store."""
    bad = batch.where("prov_ref is null or prov_ref = '' or src_rank < 1 or valid_from >= valid_to").limit(1).count()
    if bad:
        raise ValueError("refused: a cell lacks provenance, has rank 0 or an empty valid time")
    return _folded(cells, batch, ["entity_uri", "prop"], now, False)


def commit_links(links: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """The links after a batch: a newer link of the same two entities and predicate always supersedes what it overlaps."""
    if batch.where("prov_ref is null or prov_ref = '' or valid_from >= valid_to or subject_uri is null or object_uri is null").limit(1).count():
        raise ValueError("refused: a link lacks provenance, an end or a valid time")
    return _folded(links, batch, ["subject_uri", "predicate", "object_uri"], now, True)


def mirrors(value_json: Column) -> tuple[Column, Column]:
    """(value_str, value_num) of a JSON value: texts without quotes, numbers where it is one."""
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v"), value_json)
    quoted = value_json.startswith('"')
    return F.when(value_json != "null", text), F.when(~quoted, value_json.try_cast("double"))


def human_edits(cells: DataFrame, edits: DataFrame, allowed: dict[str, str], now: int) -> DataFrame:
    """The store after a person's edits (entity_uri, prop, value_json, evidence): rank 0, valid from now on, never
    superseded by a pipeline. All or none: an edit of a property that isn't allowed, of a wrong kind (allowed: property to
    'text' or 'number'), or without evidence refuses them all. An entity new to the store is created by its first edit."""
    text, number = mirrors(F.col("value_json"))
    kinds = F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair])
    rows = edits.withColumn("_kind", F.try_element_at(kinds, F.col("prop"))).withColumn("value_str", text).withColumn("value_num", number)
    fits = F.col("_kind").isNotNull() & ((F.col("_kind") != "number") | F.col("value_num").isNotNull()) & F.col("entity_uri").isNotNull() & F.col("value_str").isNotNull() & (F.length(F.coalesce("evidence", F.lit(""))) > 0)
    if not rows.where(~fits).isEmpty():
        raise ValueError("refused: an edit names an unknown property, has a wrong value or no evidence")
    last = cells.agg(F.max("seq")).first()[0] or 0
    batch = numbered(rows.drop("_kind"), ["entity_uri", "prop", "value_json"], last + 1, "seq").select(
        "seq", "entity_uri", "prop", "value_json", "value_str", "value_num", F.lit(now).alias("valid_from"), F.lit(FOREVER).alias("valid_to"), F.lit(now).alias("created_at"), F.lit(FOREVER).alias("expired_at"), F.col("evidence").alias("prov_ref"), F.lit(1.0).alias("confidence"), F.lit(0).alias("src_rank"))
    return _folded(cells, batch.select(*cells.columns), ["entity_uri", "prop"], now, False)


def neighbors(links: DataFrame, predicate: str, reverse: bool = False) -> DataFrame:
    a, b = ("object_uri", "subject_uri") if reverse else ("subject_uri", "object_uri")
    return links.where((F.col("predicate") == predicate) & current()).select(F.col(a).alias("uri"), F.col(b).alias("neighbor")).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, uri, hops): what each start (column uri) reaches over edges (uri, neighbor) within depth, itself left
    out even through cycles; hops is the fewest. Each hop joins only the newly reached frontier."""
    frontier = starts.select(F.col("uri").alias("start"), "uri").where("uri is not null").distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = frontier.join(edges, "uri").select("start", F.col("neighbor").alias("uri")).where("uri is not null").distinct()
        frontier = cut(step.join(seen, ["start", "uri"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
    return seen.where("hops > 0")


def unlink(links: DataFrame, subject: str, predicate: str, target: str, now: int) -> DataFrame:
    """Close the open links between two entities and assert again that they were valid until now."""
    hit = current() & (F.col("subject_uri") == subject) & (F.col("predicate") == predicate) & (F.col("object_uri") == target)
    closed = links.where(hit)
    until = closed.where(F.col("valid_from") < now).withColumn("valid_to", F.lit(now)).withColumn("created_at", F.lit(now))
    return links.where(~hit).unionByName(closed.withColumn("expired_at", F.greatest(F.lit(now), F.col("created_at") + 1))).unionByName(until)
