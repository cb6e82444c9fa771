"""Queries of the engine's own operators over the star schema, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import micros
from siltstone.operators import bitemporal, cleaning, dependencies, evolve, profile, provenance, quality, relationships, resolve, sampling, search, unit_conversion
from siltstone.plans import metrics
from siltstone.plans.algebra import Aggregate, ClassDef, Condition, Link, Ontology, Select, TextJoin, TopK, Traverse, World, answer, answered, citations, compile_term
from siltstone.session import table
from siltstone.sources import snapshots
from siltstone.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Enter a query, and its SQL twin if it has one, into the catalogue under the function's name."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return enter


ONTOLOGY = Ontology(
    {
        "Region": ClassDef("Region", "r_regionkey", {"r_regionkey": "integer", "r_name": "string"}),
        "Nation": ClassDef("Nation", "n_nationkey", {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"}),
        "Customer": ClassDef("Customer", "c_custkey", {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"}),
        "Order": ClassDef("Order", "o_orderkey", {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"}),
        "Document": ClassDef("Document", "doc_id", {"doc_id": "integer", "text": "text", "lang": "string", "source": "string", "n_chars": "integer"}),
    },
    {
        "placed_by": Link("placed_by", "Order", "o_custkey", "Customer"),
        "in_nation": Link("in_nation", "Customer", "c_nationkey", "Nation"),
        "in_region": Link("in_region", "Nation", "n_regionkey", "Region"),
    },
)


def world(spark: SparkSession, d: str) -> World:
    names = {"Region": "region", "Nation": "nation", "Customer": "customer", "Order": "orders", "Document": "documents"}
    return World(ONTOLOGY, {c: table(spark, d, t) for c, t in names.items()})


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# the query algebra


@query("select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 200000 and contains(lower(o_orderpriority), 'urgent') and o_custkey >= 10")
def select_filter_eq_between_in_contains(spark, d):
    term = Select("Order", (Condition("o_orderstatus", "in", ("F", "O")), Condition("o_totalprice", "between", (1000, 200000)), Condition("o_orderpriority", "contains", "URGENT"), Condition("o_custkey", ">=", 10)))
    return compile_term(term, world(spark, d)).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and o_totalprice > 100000")
def dotted_path_semi_filter(spark, d):
    term = Select("Order", (Condition("placed_by.in_nation.in_region.r_name", "=", "ASIA"), Condition("o_totalprice", ">", 100000)))
    return compile_term(term, world(spark, d)).select("o_orderkey")


@query("select c_custkey, c_name, min_by(o_orderstatus, o_orderkey::varchar) as o_orderstatus from orders join customer on o_custkey = c_custkey where o_totalprice > 150000 group by c_custkey, c_name")
def traverse_forward(spark, d):
    term = Traverse(Select("Order", (Condition("o_totalprice", ">", 150000),)), "placed_by")
    return compile_term(term, world(spark, d)).select("c_custkey", "c_name", "o_orderstatus")


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_orderstatus = 'F'")
def traverse_reverse(spark, d):
    term = Traverse(Select("Customer", (Condition("c_mktsegment", "=", "BUILDING"),)), "placed_by", True, (Condition("o_orderstatus", "=", "F"),))
    return compile_term(term, world(spark, d)).select("o_orderkey", "c_mktsegment")


@query("select c_mktsegment as placed_by_c_mktsegment, round(avg(o_totalprice), 6) as avg_o_totalprice from orders left join customer on o_custkey = c_custkey group by 1")
def group_by_link_prop(spark, d):
    term = Aggregate(Select("Order"), "avg", "o_totalprice", ("placed_by.c_mktsegment",))
    return compile_term(term, world(spark, d)).select("placed_by_c_mktsegment", r6("avg_o_totalprice"))


@query("select doc_id from documents where contains(lower(text), 'certificate')")
def text_join_documents(spark, d):
    return compile_term(TextJoin(Select("Document"), "text", "Certificate"), world(spark, d)).select("doc_id")


@query("select o_orderstatus, count(*) as count_rows from orders group by 1")
def agg_count_rows(spark, d):
    return compile_term(Aggregate(Select("Order"), "count", None, ("o_orderstatus",)), world(spark, d))


@query("select o_orderpriority, count(distinct o_custkey::varchar) as count_o_custkey from orders group by 1")
def agg_count_distinct_text(spark, d):
    return compile_term(Aggregate(Select("Order"), "count", "o_custkey", ("o_orderpriority",)), world(spark, d))


@query("select o_orderstatus, round(sum(o_totalprice), 4) as s, round(avg(o_totalprice), 4) as a, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1")
def agg_sum_avg_min_max(spark, d):
    w, parts = world(spark, d), None
    for agg, name in (("sum", "s"), ("avg", "a"), ("min", "lo"), ("max", "hi")):
        df = compile_term(Aggregate(Select("Order"), agg, "o_totalprice", ("o_orderstatus",)), w)
        df = df.select("o_orderstatus", F.round(f"{agg}_o_totalprice", 4).alias(name))
        parts = df if parts is None else parts.join(df, "o_orderstatus")
    return parts


@query("select c_mktsegment, round(sum(c_acctbal), 4) as sum_c_acctbal from customer group by 1 having sum(c_acctbal) > 100000")
def agg_having(spark, d):
    return compile_term(Aggregate(Select("Customer"), "sum", "c_acctbal", ("c_mktsegment",), (">", 100000)), world(spark, d)).select("c_mktsegment", F.round("sum_c_acctbal", 4).alias("sum_c_acctbal"))


@query("select o_custkey, round(sum(o_totalprice), 2) as sum_o_totalprice from orders group by 1 order by sum(o_totalprice) desc, o_custkey limit 10")
def topk_segment_revenue(spark, d):
    term = TopK(Aggregate(Select("Order"), "sum", "o_totalprice", ("o_custkey",)), "sum_o_totalprice", 10)
    return compile_term(term, world(spark, d)).select(F.col("o_custkey").cast("long").alias("o_custkey"), F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"))


@query("select distinct lang, source from documents where lang is not null and trim(lang) <> '' and source is not null and trim(source) <> ''")
def answer_set_semantics(spark, d):
    return answer(Select("Document"), world(spark, d), ["lang", "source"])


@query("select c_mktsegment, 'Order' as class, o_orderkey::varchar as entity from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'")
def provenance_citations(spark, d):
    term = Traverse(Select("Customer", (Condition("c_mktsegment", "=", "MACHINERY"),)), "placed_by", True)
    return citations(term, world(spark, d), ["c_mktsegment"])


@query("select o_orderstatus, count(*) as count_rows from orders group by 1")
def metric_breakdown_categorical(spark, d):
    return metrics.breakdown(world(spark, d), "Order", "count", None, "o_orderstatus")


@query("select strftime(o_orderdate, '%Y-%m') as o_orderdate, round(sum(o_totalprice), 4) as sum_o_totalprice from orders group by 1")
def metric_breakdown_temporal(spark, d):
    return metrics.breakdown(world(spark, d), "Order", "sum", "o_totalprice", "o_orderdate").select("o_orderdate", F.round("sum_o_totalprice", 4).alias("sum_o_totalprice"))


@query("select c_custkey from customer where lower(trim(c_mktsegment)) = 'building'")
def select_relaxed(spark, d):
    """No segment is written like this; the first looser comparison that finds any answers."""
    found, relaxed = answered(Select("Customer", (Condition("c_mktsegment", "=", " building "),)), world(spark, d))
    if relaxed != 1:
        raise AssertionError(relaxed)
    return found.select("c_custkey")


@query("select s_suppkey from supplier where regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g') = 'SUPPLIER 000000003'")
def select_relaxed_name(spark, d):
    supplier = Ontology({"Supplier": ClassDef("Supplier", "s_suppkey", {"s_suppkey": "integer", "s_name": "string"})}, {})
    return answered(Select("Supplier", (Condition("s_name", "=", "supplier, 000000003 Inc."),)), World(supplier, {"Supplier": table(spark, d, "supplier")}))[0].select("s_suppkey")


@query("select p_partkey from part where p_size >= 30 * 0.45359237")
def unit_converted_literal(spark, d):
    """A condition in pounds on a property in kilograms."""
    part = Ontology({"Part": ClassDef("Part", "p_partkey", {"p_partkey": "integer", "p_size": "integer"}, units={"p_size": "kg"})}, {})
    return compile_term(Select("Part", (Condition("p_size", ">=", 30, "lb"),)), World(part, {"Part": table(spark, d, "part")})).select("p_partkey")


@query("select c_mktsegment, 'Customer' as class, c_custkey::varchar as entity from customer where c_acctbal > 5000 and c_mktsegment in (select c_mktsegment from customer where c_acctbal > 5000 group by 1 having avg(c_acctbal) >= 7400)")
def aggregate_citations(spark, d):
    """Every customer behind each group of an aggregate that having lets through."""
    term = Aggregate(Select("Customer", (Condition("c_acctbal", ">", 5000),)), "avg", "c_acctbal", ("c_mktsegment",), (">=", 7400))
    return citations(term, world(spark, d))


# the bitemporal store, on cells made from events

F_ = bitemporal.FOREVER
_CELLS_SQL = f"""cells as (select event_id as seq, 'user/' || user_id as entity_uri, event_type as prop, value as value_num, epoch_us(ts) as valid_from,
  coalesce(lead(epoch_us(ts)) over (partition by user_id, event_type order by ts, event_id), {F_}) as valid_to,
  epoch_us(ts) + (event_id % 7) * 3600000000 as created_at, case when event_id % 11 = 0 then epoch_us(ts) + (event_id % 7) * 3600000000 + 86400000000 else {F_} end as expired_at,
  (event_id % 5) / 4.0 as confidence, 1 + event_id % 3 as src_rank from events)"""
_T = 1704412800000000  # 2024-01-05


def event_cells(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e, at = table(spark, d, "events"), micros(F.col("ts"))
    following = F.lead(at).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    created = at + F.col("event_id") % 7 * 3_600_000_000
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("entity_uri"), F.col("event_type").alias("prop"), F.col("value").cast("string").alias("value_json"), F.col("value").cast("string").alias("value_str"), F.col("value").alias("value_num"),
        at.alias("valid_from"), F.coalesce(following, F.lit(F_)).alias("valid_to"), created.alias("created_at"), F.when(F.col("event_id") % 11 == 0, created + 86_400_000_000).otherwise(F.lit(F_)).alias("expired_at"),
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("prov_ref"), ((F.col("event_id") % 5) / 4.0).alias("confidence"), (1 + F.col("event_id") % 3).cast("int").alias("src_rank"),
    )


def _stance_sql(where: str) -> str:
    return f"with {_CELLS_SQL} select entity_uri, prop, seq, value_num from (select *, row_number() over (partition by entity_uri, prop order by src_rank, confidence desc, created_at desc, seq desc) n from cells where {where}) where n = 1"


def _won(spark, d, stance):
    return bitemporal.scan(event_cells(spark, d), stance).select("entity_uri", "prop", "seq", "value_num")


@query(_stance_sql(f"valid_to >= {F_} and expired_at >= {F_}"))
def bitemporal_current(spark, d):
    return _won(spark, d, bitemporal.current())


@query(_stance_sql(f"expired_at >= {F_} and valid_from <= {_T} and valid_to > {_T}"))
def bitemporal_as_of(spark, d):
    return _won(spark, d, bitemporal.as_of(_T))


@query(_stance_sql(f"valid_from <= {_T} and valid_to > {_T} and created_at <= {_T} and expired_at > {_T}"))
def bitemporal_as_known_at(spark, d):
    return _won(spark, d, bitemporal.as_known_at(_T))


@query(_stance_sql(f"valid_from <= {_T} and valid_to > {_T} and created_at <= {_T + 40000000000} and expired_at > {_T + 40000000000}"))
def bitemporal_audit(spark, d):
    return _won(spark, d, bitemporal.audit(_T, _T + 40_000_000_000))


@query(_stance_sql(f"expired_at >= {F_}"))
def survivorship_winner(spark, d):
    return _won(spark, d, bitemporal.ever())


@query(f"with {_CELLS_SQL} select entity_uri, prop, seq, created_at, row_number() over (partition by entity_uri, prop order by created_at, seq) as place from cells")
def cell_history(spark, d):
    from pyspark.sql import Window

    rows = bitemporal.history(event_cells(spark, d))
    return rows.select("entity_uri", "prop", "seq", "created_at", F.row_number().over(Window.partitionBy("entity_uri", "prop").orderBy("created_at", "seq")).alias("place"))


@query(f"select entity_uri, max(case when prop = 'click' then value_num end) as click, max(case when prop = 'view' then value_num end) as view from ({_stance_sql(f'expired_at >= {F_}')}) where prop in ('click', 'view') group by 1")
def cells_pivot(spark, d):
    return bitemporal.pivot(bitemporal.scan(event_cells(spark, d), bitemporal.ever()), ["click", "view"])


_NOW = 1_800_000_000_000_000


@query(f"""with {_CELLS_SQL}, latest as (select *, row_number() over (partition by entity_uri, prop order by valid_from desc, seq desc) n from cells),
  batch as (select entity_uri, prop, seq + 10000000 as seq, valid_from + 3600000000 as valid_from from latest where n = 1),
  hit as (select c.*, b.valid_from as new_from from cells c join batch b using (entity_uri, prop) where c.expired_at >= {F_} and b.valid_from < c.valid_to)
  select entity_uri, prop, seq, valid_from, valid_to, created_at, case when exists (select 1 from hit h where h.seq = c.seq) then greatest({_NOW}, created_at + 1) else expired_at end as expired_at from cells c
  union all select entity_uri, prop, seq, valid_from, {F_}, {_NOW}, {F_} from batch
  union all select entity_uri, prop, (select max(seq) from batch) + row_number() over (order by entity_uri, prop, valid_from, seq), valid_from, new_from, {_NOW}, {F_} from hit where valid_from < new_from""")
def bitemporal_commit(spark, d):
    """The latest cell of every entity and property corrected from an hour later on, folded into the store."""
    cells = event_cells(spark, d)
    latest = cells.groupBy("entity_uri", "prop").agg(F.max_by(F.struct(*[c for c in cells.columns if c not in ("entity_uri", "prop")]), F.struct("valid_from", "seq")).alias("c")).select("entity_uri", "prop", "c.*")
    batch = latest.withColumns({"seq": F.col("seq") + 10_000_000, "valid_from": F.col("valid_from") + 3_600_000_000, "valid_to": F.lit(F_), "expired_at": F.lit(F_), "confidence": F.lit(1.0), "src_rank": F.lit(1)})
    return bitemporal.commit(cells, batch.select(*cells.columns), _NOW).select("entity_uri", "prop", "seq", "valid_from", "valid_to", "created_at", "expired_at")


@query(f"""with old as (select o_orderkey as seq, o_custkey as s, o_orderkey as o from orders), hit as (select * from old where s % 2 = 0)
  select 'order/' || o as subject_uri, 'customer/' || s as object_uri, seq, 0::bigint as valid_from, {F_} as valid_to, 1::bigint as created_at, case when s % 2 = 0 then {_NOW} else {F_} end as expired_at from old
  union all select 'order/' || o, 'customer/' || s, seq + 100000000, {_NOW - 1000}, {F_}, {_NOW}, {F_} from hit
  union all select 'order/' || o, 'customer/' || s, (select max(seq) + 100000000 from hit) + row_number() over (order by 'order/' || o, 'customer/' || s), 0, {_NOW - 1000}, {_NOW}, {F_} from hit""")
def link_commit(spark, d):
    """Newer links of the customers with even numbers supersede what they overlap."""
    o = table(spark, d, "orders")
    link = lambda seq, start, at: (seq.cast("long").alias("seq"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("subject_uri"), F.lit("placed_by").alias("predicate"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("object_uri"), F.lit(start).cast("long").alias("valid_from"), F.lit(F_).alias("valid_to"), F.lit(at).cast("long").alias("created_at"), F.lit(F_).alias("expired_at"), F.lit("p").alias("prov_ref"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("props_json"))
    links, batch = o.select(*link(F.col("o_orderkey"), 0, 1)), o.where("o_custkey % 2 = 0").select(*link(F.col("o_orderkey") + 100_000_000, _NOW - 1000, 1))
    return bitemporal.commit_links(links, batch, _NOW).select("subject_uri", "object_uri", "seq", "valid_from", "valid_to", "created_at", "expired_at")


@query("""with recursive edges as (select distinct 'c' || c_custkey as u, 'n' || c_nationkey as v from customer union select distinct 'n' || n_nationkey, 'r' || n_regionkey from nation union select distinct 'r' || n_regionkey, 'n' || n_nationkey from nation),
  walk(start, uri, hops) as (select distinct 'c' || c_custkey, 'c' || c_custkey, 0 from customer union select w.start, e.v, w.hops + 1 from walk w join edges e on e.u = w.uri where w.hops < 3)
  select start, uri, min(hops) as hops from walk where uri <> start group by 1, 2""")
def link_bfs_depth3(spark, d):
    edges, customers = _customer_links(spark, d)
    return bitemporal.reach(edges, customers.select("uri"), 3)




def _customer_links(spark, d):
    """Edges (uri, neighbor) between customers, nations and regions, and the customers (c_custkey, uri)."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("uri"), name("r", "n_regionkey").alias("neighbor"))
    edges = c.select(name("c", "c_custkey").alias("uri"), name("n", "c_nationkey").alias("neighbor")).unionByName(up).unionByName(up.select(F.col("neighbor").alias("uri"), F.col("uri").alias("neighbor"))).distinct()
    return edges, c.select("c_custkey", name("c", "c_custkey").alias("uri"))


# sources


@query("""with changed as (select o_orderkey, case when o_orderkey % 13 = 0 then null else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then o_orderpriority || '!' else o_orderpriority end as o_orderpriority from orders where o_orderkey % 17 <> 0),
  a as (select o_orderkey::varchar as row_key, unnest(['o_orderstatus', 'o_orderpriority']) as col, unnest([o_orderstatus, o_orderpriority]) as v from orders), b as (select o_orderkey::varchar as row_key, unnest(['o_orderstatus', 'o_orderpriority']) as col, unnest([o_orderstatus, o_orderpriority]) as v from changed)
  select coalesce(a.row_key, b.row_key) as row_key, coalesce(a.col, b.col) as col, case when a.v is null then 'insert' when b.v is null then 'delete' else 'update' end as kind, b.v as value, a.v as old_value
  from (select * from a where v is not null) a full join (select * from b where v is not null) b on a.row_key = b.row_key and a.col = b.col where a.v is distinct from b.v""")
def snapshot_diff_cells(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 17 <> 0").select("o_orderkey", F.expr("case when o_orderkey % 13 = 0 then null else o_orderstatus end o_orderstatus"), F.expr("case when o_orderkey % 5 = 0 then o_orderpriority || '!' else o_orderpriority end o_orderpriority"))
    keyed = lambda df: df.select(F.col("o_orderkey").cast("string").alias("row_key"), "o_orderstatus", "o_orderpriority")
    return snapshots.snapshot_diff(keyed(o), keyed(new))


@query(r"""with p as (select doc_id, regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[ \t]*(?:\n[ \t]*)+') as a from documents where text is not null),
  x as (select doc_id, (generate_subscripts(a, 1) - 1)::int as place, regexp_replace(unnest(a), '^\s+|\s+$', '', 'g') as t from p), y as (select doc_id, place, md5(t) as content_hash from x where t <> '')
  select doc_id, place, content_hash, row_number() over (partition by doc_id, content_hash order by place)::int as occurrence from y""")
def paragraph_atoms(spark, d):
    return snapshots.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", "content_hash", "occurrence")


@query("select n_name || case when n > 1 then '~' || n else '' end as row_key, n_nationkey from (select *, row_number() over (partition by n_name order by n_name, n_nationkey, n_regionkey) n from nation)")
def row_keys(spark, d):
    return snapshots.with_row_key(table(spark, d, "nation"), ["n_name"]).select("row_key", "n_nationkey")


# profiles


def _counts_sql(t: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct from {t}" for c in columns)


@query(_counts_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]) + " union all " + _counts_sql("documents", ["lang", "source", "subject_key"]))
def profile_columns(spark, d):
    a = profile.profile_columns(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    b = profile.profile_columns(table(spark, d, "documents"), ["lang", "source", "subject_key"])
    return a.unionByName(b).select("column", "n_rows", "n_null", "n_distinct")


@query("select * from (values ('o_orderkey', 'integer'), ('o_orderstatus', 'string'), ('o_totalprice', 'float'), ('o_orderpriority', 'string'), ('o_orderdate', 'datetime')) t(\"column\", datatype)")
def profile_datatypes(spark, d):
    return profile.profile_columns(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]).select("column", "datatype")


@query("select 'state_code' as \"column\", 'us_state' as semantic_type from faa_master having avg(regexp_matches(trim(state_code), '^(A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])$')::int) >= 0.6")
def semantic_types(spark, d):
    return profile.semantic_types(table(spark, d, "faa_master"), ["state_code", "city", "street"]).select("column", "semantic_type")


@query("select c as \"column\", i as decile, v as value from (select 'o_totalprice' as c, unnest(range(0, 11)) as i, unnest(quantile_disc(o_totalprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) as v from orders union all select 'o_custkey', unnest(range(0, 11)), unnest(quantile_disc(o_custkey::double, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) from orders)")
def deciles(spark, d):
    return profile.deciles(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


def _entropy_sql(t: str, c: str) -> str:
    return f"select '{c}' as \"column\", count(*) as n_distinct, round(-sum(p * ln(p)), 6) as entropy from (select count(*)::double / (select count({c}) from {t}) as p from {t} where {c} is not null group by {c})"


@query(" union all ".join(_entropy_sql("orders", c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def value_entropy(spark, d):
    return profile.entropy(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]).select("column", "n_distinct", r6("entropy"))


@query("with t as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents), c as (select token, count(*) as n from t group by 1) select token, n, round(n / (select sum(n) from c)::double, 6) as share from c order by n desc, token limit 10")
def token_stats(spark, d):
    return profile.token_stats(table(spark, d, "documents"), "text").select("token", "n", r6("share"))


_KEY_TABLES = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]}


def _keys_sql() -> str:
    unique = lambda t, *cs: f"(select count(*) = count(distinct ({', '.join(cs)})) and count(*) filter ({' or '.join(f'{c} is null' for c in cs)}) = 0 from {t})"
    one = [f"select '{t}' as \"table\", '{c}' as \"key\", 1 as width where {unique(t, c)}" for t, cs in _KEY_TABLES.items() for c in cs]
    two = [f"select '{t}', '{x},{y}', 2 where {unique(t, x, y)} and not {unique(t, x)} and not {unique(t, y)}" for t, cs in _KEY_TABLES.items() for i, x in enumerate(cs) for y in cs[i + 1 :]]
    return " union all ".join(one + two)


@query(_keys_sql())
def candidate_keys(spark, d):
    found = [profile.candidate_keys(table(spark, d, t), cs).select(F.lit(t).alias("table"), "key", "width") for t, cs in _KEY_TABLES.items()]
    return reduce(DataFrame.unionByName, found)


@query("with h as (select distinct ('0x' || substr(md5(o_custkey::varchar), 1, 15))::bigint as h from orders where o_custkey is not null), lanes as (select unnest(range(0, 16)) as i) select i::int as lane, min((h::hugeint * (2 * i * 40503 + 1) + (i * 2654435761 + 12345)) % 2305843009213693951)::bigint as value from h, lanes group by 1")
def minhash_signature(spark, d):
    return profile.minhash(table(spark, d, "orders"), "o_custkey", 16)


@query(r"""with s as (select lower(regexp_extract(trim(gross_weight), '^[-+]?[0-9.,]+\s*([A-Za-z%°]+)$', 1)) as suffix from shipments), c as (select suffix, count(*) as n from s where suffix <> '' group by 1), t as (select *, n::double / sum(n) over () as share from c)
  select 'gross_weight' as "column", suffix, n, round(share, 6) as share, (select count(*) from t where share >= 0.05 and n >= 2) >= 2 as mixed from t""")
def unit_suffixes(spark, d):
    return profile.unit_suffixes(table(spark, d, "shipments"), ["gross_weight"]).select("column", "suffix", "n", r6("share"), "mixed")


# dependencies and joins


def _fd_sql(t: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{x}' as lhs, '{y}' as rhs, round(sum(m)::double / (select count(*) from {t}), 4) as confidence from (select max(c) m from (select {x}, {y}, count(*) c from {t} group by 1, 2) group by {x}) having sum(m)::double / (select count(*) from {t}) >= 0.98"
        for x in columns for y in columns if x != y
    )


_FD_COLUMNS = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]}


@query(" union all ".join(_fd_sql(t, cs) for t, cs in _FD_COLUMNS.items()))
def fd_exact_unary(spark, d):
    return reduce(DataFrame.unionByName, [dependencies.functional_dependencies(table(spark, d, t), cs, max_lhs=1) for t, cs in _FD_COLUMNS.items()])


@query(_fd_sql("bom_components", ["parent_model_code", "component_category", "uom", "component_description"]))
def fd_g3_unary(spark, d):
    return dependencies.functional_dependencies(table(spark, d, "bom_components"), ["parent_model_code", "component_category", "uom", "component_description"], max_lhs=1)


_IND = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}


@query("with v as (" + " union all ".join(f"select distinct '{t}.{c}' as col, {c}::varchar as value from {t} where {c} is not null" for t, cs in _IND.items() for c in cs) + "), n as (select col, count(*) as n from v group by 1) select a.col as lhs, b.col as rhs, any_value(x.n) as lhs_distinct, any_value(y.n) as rhs_distinct, count(*) as common, round(count(*)::double / any_value(x.n), 6) as coverage from v a join v b on a.value = b.value and a.col <> b.col join n x on x.col = a.col join n y on y.col = b.col where x.n >= 2 group by 1, 2 having count(*)::double / any_value(x.n) >= 0.95")
def ind_pairs(spark, d):
    found = dependencies.inclusion_dependencies({t: (table(spark, d, t), cs) for t, cs in _IND.items()})
    return found.withColumn("coverage", F.round("coverage", 6))


_ORPHANED = "(select case when o_custkey % 7 = 0 then null when o_custkey % 11 = 0 then -o_custkey else o_custkey end as k from orders)"


@query(f"with l as {_ORPHANED}, r as (select c_custkey::varchar as k, count(*) n from customer group by 1), j as (select l.k, r.n from l left join r on l.k::varchar = r.k) select count(*) as left_rows, round(count(n)::double / count(k), 6) as match_rate, round(1 - count(n)::double / count(k), 6) as orphan_rate, round((count(*) - count(k))::double / count(*), 6) as null_rate, round(sum(n)::double / count(n), 6) as fan_out_avg from j")
def join_validation_metrics(spark, d):
    o = table(spark, d, "orders").select(F.expr("case when o_custkey % 7 = 0 then null when o_custkey % 11 = 0 then -o_custkey else o_custkey end").alias("k"))
    return dependencies.validate_join(o, "k", table(spark, d, "customer"), "c_custkey").select("left_rows", r6("match_rate"), r6("orphan_rate"), r6("null_rate"), r6("fan_out_avg"))


@query("select * from (values ('lineitem-orders', 'FK_JOIN'), ('nation-region', 'LOOKUP_DIMENSION')) t(pair, verdict)")
def join_verdict(spark, d):
    out = None
    for a, x, b, y in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey")):
        m = dependencies.verdict(dependencies.validate_join(table(spark, d, a), x, table(spark, d, b), y)).select(F.lit(f"{a}-{b}").alias("pair"), "verdict")
        out = m if out is None else out.unionByName(m)
    return out


@query("with p as (select o_custkey::varchar as v, count(*)::double / (select count(*) from orders) as p from orders group by 1), q as (select c_custkey::varchar as v, 1.0 / (select count(*) from customer) as q from customer) select count(p.v) as left_distinct, count(q.v) as right_distinct, count(*) filter (p.v is not null and q.v is not null) as common, round(sum(case when p > 0 then 0.5 * p * log2(p / ((p + coalesce(q, 0)) / 2)) else 0 end + case when q > 0 then 0.5 * q * log2(q / ((coalesce(p, 0) + q) / 2)) else 0 end), 6) as divergence from p full join q on p.v = q.v")
def relationship_signals(spark, d):
    return dependencies.value_overlap(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey").select("left_distinct", "right_distinct", "common", r6("divergence"))


_RELATED = [("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("nation.n_regionkey", "region.r_regionkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("customer.c_mktsegment", "orders.o_orderpriority"), ("customer.c_nationkey", "supplier.s_nationkey"), ("nation.n_name", "region.r_name"), ("orders.o_orderstatus", "lineitem.l_linestatus")]
_RELATED_COLUMNS = {t: sorted({c.split(".")[1] for p in _RELATED for c in p if c.startswith(t + ".")}) for t in sorted({c.split(".")[0] for p in _RELATED for c in p})}
_TEXT_COLUMNS = ("c_mktsegment", "o_orderpriority", "n_name", "r_name", "o_orderstatus", "l_linestatus")


def _deciles_sql(column: str) -> str:
    t, c = column.split(".")
    return "null::double[]" if c in _TEXT_COLUMNS else f"(select quantile_disc({c}::double, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) from {t})"


def _signals_sql() -> str:
    """All signals of the pairs, each from its definition; names are compared in the plan, as they are metadata."""
    values = " union all ".join(f"select '{t}.{c}' as col, {c}::varchar as value, count(*)::double as n from {t} where {c} is not null group by 2" for t, cs in _RELATED_COLUMNS.items() for c in cs)
    pairs = ", ".join(f"('{a}', '{b}', {_deciles_sql(a)}, {_deciles_sql(b)})" for a, b in _RELATED)
    return f"""with v as ({values}), f as (select col, sum(n) as rows, count(*)::double as d, case when count(*) > 1 then -sum(n / t * ln(n / t)) / ln(count(*)) else 0 end as entropy from (select *, sum(n) over (partition by col) as t from v) group by col),
  p(l, r, ql, qr) as (values {pairs}),
  sides as (select p.l, p.r, value, n / fl.rows as pl, null as pr from p join v on v.col = p.l join f fl on fl.col = p.l union all select p.l, p.r, value, null, n / fr.rows from p join v on v.col = p.r join f fr on fr.col = p.r),
  met as (select l, r, value, coalesce(sum(pl), 0) as x, coalesce(sum(pr), 0) as y from sides group by 1, 2, 3),
  js as (select l, r, count(*) filter (x > 0 and y > 0)::double as common, sum(case when x > 0 then 0.5 * x * log2(2 * x / (x + y)) else 0 end + case when y > 0 then 0.5 * y * log2(2 * y / (x + y)) else 0 end) as js from met group by 1, 2),
  words as (select distinct col, value, w from (select col, value, unnest(regexp_split_to_array(lower(value), '[^a-z0-9]+')) as w from v) where length(w) > 1),
  df as (select col, w, count(*) as df from words group by 1, 2),
  tokens as (select p.l, p.r, w, sum(df.df) as df, max((df.col = p.l)::int) as a, max((df.col = p.r)::int) as b from p join df on df.col in (p.l, p.r) group by 1, 2, 3),
  rare as (select t.l, t.r, sum(a * b)::double / count(*) as rare from tokens t join f fl on fl.col = t.l join f fr on fr.col = t.r where t.df <= greatest(1, floor(0.5 * (fl.d + fr.d))) group by 1, 2),
  s as (select p.l, p.r, js.common / fl.d as c_lr, js.common / fr.d as c_rl, js.common / (fl.d + fr.d - js.common) as jaccard, coalesce(rare, 0) as rare, least(fl.d, fr.d) / greatest(fl.d, fr.d) as cardinality, fr.d / fr.rows as key_uniqueness, fl.d / fl.rows as left_uniqueness, fl.entropy as entropy, fr.d as right_distinct,
    case when ql is null then least(1, greatest(0, js.js)) when greatest(ql[11], qr[11]) > least(ql[1], qr[1]) then least(1, list_avg(list_transform(list_zip(ql, qr), lambda z: abs(z[1] - z[2]))) / (greatest(ql[11], qr[11]) - least(ql[1], qr[1]))) else 0 end as divergence
    from p join js using (l, r) join f fl on fl.col = p.l join f fr on fr.col = p.r left join rare using (l, r))"""


def _related(spark, d):
    return relationships.signals({t: (table(spark, d, t), cs) for t, cs in _RELATED_COLUMNS.items()}, _RELATED)


@query(_signals_sql() + " select l as left, r as right, round(c_lr, 6) as containment_lr, round(c_rl, 6) as containment_rl, round(jaccard, 6) as jaccard, round(rare, 6) as rare_tokens, round(cardinality, 6) as cardinality, round(key_uniqueness, 6) as key_uniqueness, round(entropy, 6) as entropy, round(divergence, 6) as divergence from s")
def relationship_all_signals(spark, d):
    return _related(spark, d).select("left", "right", *[r6(c) for c in ("containment_lr", "containment_rl", "jaccard", "rare_tokens", "cardinality", "key_uniqueness", "entropy", "divergence")])


def _names_sql() -> str:
    rows = []
    for a, b in _RELATED:
        x, y = a.split(".")[1], b.split(".")[1]
        rows.append(f"('{a}', '{b}', {max(float(x == y), dependencies.name_similarity(x, y), relationships.trigram_similarity(x, y))}, {relationships.trigram_similarity(x, y)})")
    return ", names(l, r, name, trigrams) as (values " + ", ".join(rows) + ")"


_FUSED_SQL = _signals_sql() + _names_sql() + """, fused as (select s.*, name, greatest(c_lr, c_rl) as c, greatest(c_lr, c_rl, jaccard, rare) as overlap, rare >= 0.5 and greatest(c_lr, c_rl) <= 0.5 as recovers, divergence >= 0.5 as apart from s join names using (l, r)),
  raw as (select *, 0.30 * c_lr + 0.15 * c_rl + 0.15 * jaccard + 0.10 * jaccard + 0.12 * rare + case when overlap >= 0.3 then 0.20 * key_uniqueness else 0 end + case when overlap >= 0.2 then 0.05 * name else 0 end
    - 0.35 * divergence * case when apart then 2 else 1 end * case when recovers then 0.25 else 1 end - case when entropy < 0.25 then 0.05 else 0 end as raw from fused),
  done as (select *, least(1, greatest(0, case when divergence >= 0.6 and c < 0.7 and not recovers then least(raw, 0.2) else raw end)) as confidence from raw)"""


@query(_FUSED_SQL + " select l as left, r as right, round(confidence, 6) as confidence, round(least(1, 0.40 * c + least(1, c / 0.3) * (0.25 * key_uniqueness + 0.15 * cardinality + 0.15 + 0.05 * name)), 6) as candidate_score from done")
def fused_confidence(spark, d):
    return _related(spark, d).select("left", "right", F.round(relationships.fused_confidence(), 6).alias("confidence"), F.round(relationships.candidate_score(), 6).alias("candidate_score"))


@query(_FUSED_SQL + """ select l as left, r as right, case when divergence >= 0.5 and not (key_uniqueness >= 0.95 or left_uniqueness >= 0.95) then 'UNRELATED' when c < 0.9 and (divergence >= 0.5 or greatest(c, jaccard) < 0.1) then 'UNRELATED'
  when c_lr >= 0.9 and key_uniqueness >= 0.95 and divergence < 0.5 then case when cardinality <= 0.25 then 'LOOKUP_DIMENSION' else 'FK_JOIN' end
  when c_rl >= 0.9 and left_uniqueness >= 0.95 and divergence < 0.5 then 'FK_JOIN'
  when not (key_uniqueness >= 0.95 or left_uniqueness >= 0.95) and greatest(c, jaccard) >= 0.5 and divergence <= 0.2 then 'DENORMALIZATION'
  when not (key_uniqueness >= 0.95 or left_uniqueness >= 0.95) and c_lr >= 0.95 then 'DERIVED_FIELD' else 'UNKNOWN' end as rel_type from done""")
def relationship_classes(spark, d):
    whole = {t: (df := table(spark, d, t), df.columns) for t in _RELATED_COLUMNS}
    return relationships.classify(_related(spark, d), relationships.table_shapes(whole)).select("left", "right", "rel_type")


# cleaning and quality

_TOKENS = ", ".join(f"'{t}'" for t in cleaning.MISSING)


@query(f"select reg_key, case when upper(trim(city)) in ({_TOKENS}) then null else upper(trim(regexp_replace(city, '\\s+', ' ', 'g'))) end as city from faa_master")
def clean_null_tokens_trim_case(spark, d):
    return table(spark, d, "faa_master").select("reg_key", F.upper(cleaning.tidy(cleaning.null_tokens(F.col("city")))).alias("city"))


@query(r"select work_order_id, case when upper(trim(regexp_extract(trim(cost_text), '^([^0-9+.-]*)', 1))) in ('', '$', 'USD') then try_cast(replace(regexp_replace(trim(cost_text), '^[^0-9.+-]*', ''), ',', '') as double) end as cost from maintenance_erp")
def clean_numeric_string(spark, d):
    """All costs; foreign currencies have no number here."""
    return table(spark, d, "maintenance_erp").select("work_order_id", cleaning.currency_to_number(F.col("cost_text")).alias("cost"))


_DAY_SQL = r"""case when regexp_matches({0}, '^\d{{8}}$') then try_strptime({0}, '%Y%m%d') when regexp_matches({0}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') then try_strptime({0}, '%Y-%m-%d') when regexp_matches({0}, '^\d{{1,2}}-[A-Za-z]{{3}}-\d{{4}}$') then try_strptime({0}, '%d-%b-%Y')
  when regexp_matches({0}, '^\d{{1,2}}-[A-Za-z]{{3}}-\d{{2}}$') then try_strptime({0}, '%d-%b-%y') when regexp_matches({0}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') then try_strptime({0}, '%m/%d/%Y') when regexp_matches({0}, '^\d{{1,2}}[.]\d{{1,2}}[.]\d{{4}}$') then try_strptime({0}, '%d.%m.%Y') end"""


@query(f"select reg_key, ({_DAY_SQL.format('trim(cert_issue_date)')})::date::varchar as day from faa_master")
def clean_dates(spark, d):
    """All dates in all notations; null where there is none."""
    from siltstone.functions.text import parse_day

    return table(spark, d, "faa_master").select("reg_key", parse_day(F.col("cert_issue_date")).cast("string").alias("day"))


_WEIGHTS = {n: (u, f) for u, family, f, names in unit_conversion.UNITS if family == "weight" for n in (u, *names.split())}
_WEIGHT_ROWS = ", ".join(f"('{n}', '{u}', {f!r})" for n, (u, f) in _WEIGHTS.items())


@query(f"""with u(n, unit, factor) as (values {_WEIGHT_ROWS}), s as (select shipment_id, trim(gross_weight) as t, lower(weight_uom) as w from shipments),
  f as (select *, regexp_extract(t, '^([-+]?[0-9.,]+)', 1) as figure, case when regexp_matches(t, '^[-+]?[0-9.,]+\\s*([A-Za-z°%][A-Za-z°%. ]*)?$') then regexp_replace(lower(regexp_extract(t, '^[-+]?[0-9.,]+\\s*([A-Za-z°%][A-Za-z°%. ]*)?$', 1)), '[. ]', '', 'g') end as suffix from s),
  v as (select *, try_cast(case when regexp_matches(figure, '[.][0-9]+,[0-9]*$') then replace(replace(figure, '.', ''), ',', '.') else replace(figure, ',', '') end as double) as number,
    case when suffix = '' then case when upper(trim(w)) in ('', 'NULL', 'N/A', '-', 'TBD') then null else coalesce((select unit from u where n = w and n <> unit || '!' limit 1), (select unit from u where n = regexp_replace(w, '[^a-z0-9]', '', 'g') limit 1)) end else suffix end as name from f)
  select shipment_id, round(number * (select factor from u where n = name limit 1), 4) as kg from v""")
def clean_unit_suffix(spark, d):
    """All weights in all notations. A bare figure has the unit of weight_uom; null where neither states one or the
    figure can't be read."""
    units = {n: (factor, 0.0) for n, (_, factor) in _WEIGHTS.items()}
    kg = cleaning.scaled_unit(F.col("gross_weight"), units, unit_conversion.unit_of(F.col("weight_uom"), "weight"))
    return table(spark, d, "shipments").select("shipment_id", F.round(kg, 4).alias("kg"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts, event_id) n from events) where n = 1")
def dedupe_first(spark, d):
    return cleaning.first_row(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("select 'o_custkey:not_null' as expectation, count(*) as n_evaluated, count(*) - count(o_custkey) as violations from orders union all select 'o_orderstatus:in', count(o_orderstatus), count(*) filter (o_orderstatus not in ('F', 'O')) from orders union all select 'o_totalprice:range', count(o_totalprice), count(*) filter (o_totalprice not between 1000 and 300000) from orders union all select 'o_orderpriority:pattern', count(o_orderpriority), count(*) filter (not regexp_matches(o_orderpriority, '^[1-3]-')) from orders")
def expectation_report(spark, d):
    e = quality.Expectation
    rules = [e("o_custkey", "not_null"), e("o_orderstatus", "in", ("F", "O")), e("o_totalprice", "range", (1000, 300000)), e("o_orderpriority", "pattern", "^[1-3]-")]
    return quality.evaluate(table(spark, d, "orders"), rules).select("expectation", "n_evaluated", "violations")


@query("with x as (select o_totalprice as v, year(o_orderdate) < 1998 as old from orders where o_totalprice is not null), e as (select list_sort(list_distinct(quantile_disc(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as q from x where old), b as (select len(list_filter(q[2:len(q) - 1], lambda k: k < v)) as bin, old from x, e), c as (select bin::int as bin, greatest(count(*) filter (old)::double / (select count(*) from x where old), 0.0001) as p, greatest(count(*) filter (not old)::double / (select count(*) from x where not old), 0.0001) as q from b group by 1) select bin, round(p, 6) as base_share, round(q, 6) as share, round((q - p) * ln(q / p), 6) as psi from c")
def psi_drift(spark, d):
    o = table(spark, d, "orders")
    half = F.year("o_orderdate") < 1998
    return quality.psi(o.where(half), o.where(~half), "o_totalprice").select("bin", r6("base_share"), r6("share"), r6("psi"))


@query("with recursive s as (select event_type, dense_rank() over (order by ts::date) as cycle, avg((value < 10)::int) as x from (select *, ts::date as day from events) group by event_type, ts::date), o as (select *, row_number() over (partition by event_type order by cycle) as i from s), z(event_type, i, cycle, x, z) as (select event_type, i, cycle, x, x from o where i = 1 union all select o.event_type, o.i, o.cycle, o.x, 0.3 * o.x + 0.7 * z.z from z join o on o.event_type = z.event_type and o.i = z.i + 1) select event_type, cycle, round(x, 6) as x, round(z, 6) as ewma from z")
def ewma_null_rate(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = e.select("day").distinct().withColumn("cycle", F.dense_rank().over(Window.orderBy("day")))  # a row a day
    series = e.join(F.broadcast(days), "day").groupBy("event_type", "cycle").agg(F.avg((F.col("value") < 10).cast("int")).alias("x"))
    return quality.ewma(series, "event_type", "cycle", "x").select("event_type", "cycle", r6("x"), r6("ewma"))


@query("select * from (values ('renamed', 'c_mktsegment', 'segment'), ('removed', 'c_acctbal', null), ('added', 'extra', null)) t(change, \"column\", other)")
def schema_drift(spark, d):
    c = table(spark, d, "customer")
    return quality.schema_drift(c, c.withColumnRenamed("c_mktsegment", "segment").drop("c_acctbal").withColumn("extra", F.lit(1)))


# entity resolution


@query("select distinct least(a.s_suppkey, b.s_suppkey) as a, greatest(a.s_suppkey, b.s_suppkey) as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def blocking_exact(spark, d):
    return resolve.block_pairs(table(spark, d, "supplier"), "s_suppkey", F.col("s_nationkey"))


@query("with r as (select c_custkey as k, row_number() over (order by c_acctbal, c_custkey) as i from customer) select distinct least(a.k, b.k) as a, greatest(a.k, b.k) as b from r a join r b on b.i between a.i + 1 and a.i + 3")
def blocking_sorted_neighborhood(spark, d):
    return resolve.sorted_neighborhood(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal"))


@query()
def lsh_bands(spark, d):
    c = table(spark, d, "supplier_contracts").groupBy("supplier_legal_name").agg(F.min("contract_number").alias("k"))
    return resolve.lsh_pairs(c, "k", "supplier_legal_name")


@query()
def fs_posteriors(spark, d):
    """Levels, EM over their counted patterns, and the posterior of every blocked pair of supplier names."""
    c = table(spark, d, "supplier_contracts").groupBy("supplier_id").agg(F.min("supplier_legal_name").alias("name"), F.min("supplier_country").alias("country"), F.min("payment_terms").alias("terms"))
    pairs = resolve.block_pairs(c, "supplier_id", F.substring("name", 1, 4))
    x, y = c.select(F.col("supplier_id").alias("a"), F.struct("name", "country", "terms").alias("x")), c.select(F.col("supplier_id").alias("b"), F.struct("name", "country", "terms").alias("y"))
    p = pairs.join(x, "a").join(y, "b")
    p = p.withColumn("l1", resolve.agreement_level(F.col("x.name"), F.col("y.name"), resolve.jaro_winkler_udf(F.col("x.name"), F.col("y.name")), 0.92, 0.8))
    for i, n in ((2, "country"), (3, "terms")):
        p = p.withColumn(f"l{i}", resolve.agreement_level(F.col(f"x.{n}"), F.col(f"y.{n}"), (F.col(f"x.{n}") == F.col(f"y.{n}")).cast("double"), 1.0, 0.5))
    levels = ["l1", "l2", "l3"]
    p = p.select("a", "b", *levels)
    counted = [(tuple(r[k] for k in levels), r["count"]) for r in p.groupBy(*levels).count().orderBy(*levels).collect()]  # at most 4^3 rows
    if not counted:
        return p.withColumn("posterior", F.lit(None).cast("double"))
    return p.withColumn("posterior", F.round(resolve.posterior(levels, resolve.fellegi_sunter(counted)), 6))


@query("with t as (select c_custkey as k, c_nationkey as t, c_nationkey * 10 + ascii(c_mktsegment) % 3 as a from customer), f as (select (select sum(n * (n - 1) / 2) from (select count(*)::double n from t group by a, t)) tp, (select sum(n * (n - 1) / 2) from (select count(*)::double n from t group by a)) ap, (select sum(n * (n - 1) / 2) from (select count(*)::double n from t group by t)) tr) select tp as true_positive, ap as assigned_pairs, tr as true_pairs, round(tp / ap, 6) as precision, round(tp / tr, 6) as recall from f")
def pairwise_prf(spark, d):
    c = table(spark, d, "customer")
    a = c.select("c_custkey", (F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 3).alias("g"))
    q = resolve.pairwise_quality(a, c.select("c_custkey", F.col("c_nationkey").alias("g")), "c_custkey", "g")
    return q.select("true_positive", "assigned_pairs", "true_pairs", r6("precision"), r6("recall"))


@query("select c_custkey, round(jaro_similarity(c_name, 'Customer#000000100') + 0.1 * 4 * (1 - jaro_similarity(c_name, 'Customer#000000100')), 6) as jw from customer")
def jaro_winkler_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(resolve.jaro_winkler_udf(F.col("c_name"), F.lit("Customer#000000100")), 6).alias("jw"))


# evolution, provenance, search, sampling, tokenization, streaming


@query("select c_custkey, c_mktsegment, round(c_acctbal, 4) as c_acctbal from customer")
def backward_view(spark, d):
    """A chain of operators on a class; the version before them, seen in the tables after them."""
    t = {"Customer": table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")}
    ops = [evolve.RenameProperty("Customer", "c_acctbal", "balance"), evolve.RetypeProperty("Customer", "balance", 100.0, 5.0), evolve.PromoteProperty("Customer", "c_mktsegment", "Segment"), evolve.SplitClass("Customer", "c_custkey", "7", "Seven", "Others"), evolve.RenameClass("Others", "Most")]
    return evolve.view(evolve.evolve(t, ops), ops)["Customer"].select("c_custkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("select 'S' || s_suppkey as id, s_acctbal as balance, 'Supplier' as _origin from supplier union all select 'C' || c_custkey, c_acctbal, 'Customer' from customer")
def evolve_split_merge(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("id"), F.col("c_acctbal").alias("balance"))
    return evolve.MergeClasses(("Supplier", "Customer"), "Party", (("id", "balance"), ("id", "balance"))).forward({"Supplier": s, "Customer": c})["Party"]


@query("select 'Segment/' || substr(md5(c_mktsegment), 1, 12) as uri, c_mktsegment as label from customer where c_mktsegment is not null group by c_mktsegment")
def promote_demote(spark, d):
    return evolve.PromoteProperty("Customer", "c_mktsegment", "Segment").forward({"Customer": table(spark, d, "customer")})["Segment"]


@query("select distinct prov_ref as artifact_id from prov_term where list_has_any(regexp_extract_all(leaf_ids, 'a[0-9]+'), (select list('a' || lpad(i::varchar, 12, '0')) from range(1, 2000) t(i)))")
def invalidate_artifacts(spark, d):
    t = table(spark, d, "prov_term")
    leaves = t.select("prov_ref", F.explode(F.from_json("leaf_ids", "array<string>")).alias("atom_id"))
    changed = spark.range(1, 2000).select(F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("atom_id"))
    return provenance.invalidated(changed, leaves, t.select("prov_ref", F.col("prov_ref").alias("artifact_id")))


@query("select prov_ref, len(list_distinct(regexp_extract_all(leaf_ids, 'a[0-9]+'))) as n_atoms, list_sort(list_distinct(regexp_extract_all(leaf_ids, 'a[0-9]+')))[1] as first_atom from prov_term where regexp_matches(leaf_ids, 'a[0-9]+')")
def provenance_atoms(spark, d):
    t = table(spark, d, "prov_term").select("prov_ref", F.array(F.from_json("leaf_ids", "array<string>")).alias("term")).where("size(term[0]) > 0")
    atoms = provenance.cited(F.col("term"))
    return t.select("prov_ref", F.size(atoms).alias("n_atoms"), F.get(atoms, 0).alias("first_atom"))


@query("""with tok as (select doc_id as id, unnest(flatten([case when length(w) > 3 then [w] || [substr(w, i, 3) for i in range(1, length(w) - 1)] else [w] end for w in regexp_extract_all(lower(text), '[a-z0-9]+')])) as t from documents where text is not null),
  c as (select id, t, count(*) as c from tok group by 1, 2), tf as (select id, ('0x' || substr(md5(t), 1, 8))::bigint % 4096 as dim, sum(1 + ln(c)) as tf from c group by 1, 2),
  idf as (select dim, ln((1.0 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from tf group by 1), w as (select id, dim, tf * idf as w from tf join idf using (dim)), norm as (select id, sqrt(sum(w * w)) as norm from w group by 1),
  qt as (select unnest(flatten([case when length(w) > 3 then [w] || [substr(w, i, 3) for i in range(1, length(w) - 1)] else [w] end for w in regexp_extract_all('worn tool found during incoming inspection', '[a-z0-9]+')])) as t), qc as (select t, count(*) as c from qt group by 1),
  q as (select dim, tf * coalesce(idf, 1.0) as w from (select ('0x' || substr(md5(t), 1, 8))::bigint % 4096 as dim, sum(1 + ln(c)) as tf from qc group by 1) left join idf using (dim))
  select w.id, round(sum(w.w * q.w) / (any_value(norm) * (select sqrt(sum(w * w)) from q)), 6) as score from w join q using (dim) join norm on norm.id = w.id group by w.id order by sum(w.w * q.w) / any_value(norm) desc, w.id limit 10""")
def tfidf_search(spark, d):
    return search.tfidf_search(table(spark, d, "documents"), "doc_id", "text", "worn tool found during incoming inspection").select("id", r6("score"))


@query()
def tfidf_search_rows(spark, d):
    """Every document whose id is divisible by 20 against all documents."""
    return search.tfidf_search_rows(table(spark, d, "documents"), "doc_id", "text", F.col("doc_id") % 20 == 0).select("query", "id", r6("score"))


_ASKED = ["Supplier#000000001", "00000000", "PLIER#", "Suplier 00000002"]
# the blocks that two texts share: the longest first, then those to its left and right
_BANDS_SQL = r"""
with recursive asked as (select unnest([{asked}]) as q),
base as (select q, lower(trim(q)) as a, s_suppkey as id, s_name as label, lower(trim(s_name)) as t from asked, supplier),
banded as (select *, least(length(a) / length(t), 1.0) as r, case when starts_with(t, a) then 0.75 + 0.25 * least(length(a) / length(t), 1.0)
  when len([w for w in regexp_split_to_array(t, '[\s_\-./:#@]+') if starts_with(w, a)]) > 0 then 0.55 + 0.15 * least(length(a) / length(t), 1.0)
  when contains(t, a) then 0.35 + 0.10 * least(length(a) / length(t), 1.0) end as score from base),
parts(q, id, a, t, a0, a1, b0, b1, n) as (
  select q, id, a, t, 0::bigint, length(a), 0::bigint, length(t), 0::bigint from banded where score is null
  union all
  select q, id, a, t, p.a0, p.a1, p.b0, p.b1, p.n from (
    select q, id, a, t, unnest([{{'a0': a0, 'a1': -m.i, 'b0': b0, 'b1': -m.j, 'n': m.k}}, {{'a0': -m.i + m.k, 'a1': a1, 'b0': -m.j + m.k, 'b1': b1, 'n': 0::bigint}}]) as p from (
      select *, list_max(flatten([[{{'k': len([k for k in range(1, 1 + least(a1 - i, b1 - j)) if substr(a, i + 1, k) = substr(t, j + 1, k)]), 'i': -i, 'j': -j}} for j in range(b0, b1)] for i in range(a0, a1)])) as m
      from parts where a1 > a0 and b1 > b0) where m.k > 0)),
fuzzy as (select q, id, any_value(2.0 / (length(a) + length(t))) * sum(n) as ratio from parts group by q, id),
scored as (select q, id, label, coalesce(score, case when ratio >= 0.6 then 0.30 * ratio end) as score from banded left join fuzzy using (q, id))
select q as query, id, label, round(score, 6) as score from scored where score is not null qualify row_number() over (partition by q order by score desc, label, id) <= 20
""".format(asked=", ".join(f"'{a}'" for a in _ASKED))


@query(_BANDS_SQL)
def federated_search_bands(spark, d):
    """Four searches, of which each has its best hits in another band: exact, word prefix, substring, fuzzy."""
    found = [search.search_bands(table(spark, d, "supplier"), "s_suppkey", "s_name", a, 20).select(F.lit(a).alias("query"), "id", "label", r6("score")) for a in _ASKED]
    return reduce(DataFrame.unionByName, found)


@query("with u as (select user_id as uri, count(*) as uses, max(event_id) as last from events group by 1), g as (select user_id as uri, count(distinct event_type) as degree, 0 as dependents from events group by 1), m as (select greatest((select max(uses) from u), 1) mu, greatest((select max(degree) from g), 1) md, (select max(event_id) from events) nw) select uri, round(0.4 * uses / mu + 0.25 * degree / md + 0.2 * pow(0.5, (nw - last) / 50.0), 6) as score from u join g using (uri), m")
def criticality_scores(spark, d):
    e = table(spark, d, "events")
    degree = e.groupBy(F.col("user_id").alias("uri")).agg(F.count_distinct("event_type").alias("degree")).withColumn("dependents", F.lit(0))
    return search.criticality(e.select(F.col("user_id").alias("uri"), F.col("event_id").alias("seq")), degree).select("uri", r6("score"))


@query()
def plan_subset_semi(spark, d):
    _, c = sampling.joinable_subset(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey", 1000)
    return c


@query("select o_orderkey * 7 + 3 as k, c_custkey * 11 + 5 as c, c_mktsegment from orders join customer on o_custkey = c_custkey")
def tokenize_affine_join_preserving(spark, d):
    o = table(spark, d, "orders").select(sampling.affine(F.col("o_orderkey"), 7, 3).alias("k"), sampling.affine(F.col("o_custkey"), 11, 5).alias("c"))
    c = table(spark, d, "customer").select(sampling.affine(F.col("c_custkey"), 11, 5).alias("c"), "c_mktsegment")
    return o.join(c, "c")


@query()
def tokenize_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", sampling.tokenize(F.col("c_name"), b"fixed-for-tests").alias("token"))


@query("select o_orderkey, ('1992-01-01'::date + ((date_diff('day', '1992-01-01'::date, o_orderdate::date) + 1000) % 4000)::int)::date::varchar as day from orders")
def shift_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sampling.shift_dates(F.to_date("o_orderdate"), 1000, "1992-01-01", 4000).cast("string").alias("day"))


@query("select count(*) as n_rows, count(distinct l_orderkey * 10 + l_linenumber) as n_keys, round(sum(l_quantity), 2) as q from lineitem")
def fingerprint_multiset(spark, d):
    """The fingerprint is the same for rows and columns in any order; it is compared here, then plain sums are returned."""
    li = table(spark, d, "lineitem")
    a, b = snapshots.content_fingerprint(li), snapshots.content_fingerprint(li.select(*reversed(li.columns)).orderBy("l_shipdate"))
    if a != b:
        raise AssertionError("fingerprints differ")
    return li.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n_keys"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark, d):
    """The batch form of the windowed stream; tests run the same function on a stream."""
    counts = changes.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
