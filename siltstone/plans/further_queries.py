"""More queries of the engine's own operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import cleaning, clusters, drift, evolve, identity, ledger, privacy, profile, programs, provenance, relationships, sampling
from siltstone.operators.bitemporal import FOREVER, human_edits, mirrors, neighbors, scan
from siltstone.plans import transforms
from siltstone.plans.algebra import ClassDef, Condition, Ontology, Select, World, compile_term
from siltstone.plans.reference_queries import _CELLS_SQL, event_cells, r6
from siltstone.session import table
from siltstone.sources import bundle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return enter


# profiles


@query("select c as \"column\", true as close from (values ('l_orderkey'), ('l_partkey'), ('l_suppkey')) t(c)")
def approx_distinct(spark, d):
    """Sketches against exact counts: within 4 %."""
    li, columns = table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    exact = profile.profile_columns(li, columns).select("column", "n_distinct")
    return profile.approx_distinct(li, columns).join(exact, "column").select("column", (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.04 * F.col("n_distinct") + 1).alias("close"))


@query("with k as (select distinct case when l_quantity = floor(l_quantity) then 'n:' || l_quantity::bigint::varchar else 'f:' || l_quantity::varchar end as key from lineitem), o as (select distinct 'n:' || l_linenumber::varchar as key from lineitem), d as (select distinct 'd:' || strftime(l_shipdate, '%Y-%m-%d') as key from lineitem) select (select count(*) from k) as quantities, (select count(*) from k join o using (key)) as common, (select count(*) from d) as days, (select count(*) from d join k using (key)) as mixed")
def typed_value_keys(spark, d):
    """Whole numbers are equal in every numeric type; a day is never a number."""
    li = table(spark, d, "lineitem")
    types = dict(li.dtypes)
    keys = lambda c, kind=None: li.select(profile.value_key(F.col(c) if kind is None else F.col(c).cast(kind), kind or types[c]).alias("key")).distinct()
    q, n, s = keys("l_quantity"), keys("l_linenumber"), keys("l_shipdate", "date")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(q, "quantities").join(one(q.join(n, "key"), "common")).join(one(s, "days")).join(one(s.join(q, "key"), "mixed"))


_STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA PR RI SC SD TN TX UT VT VA WA WV WI WY"
_ALL_FAA = ["n_number", "state_code", "city", "street", "cert_issue_date", "county", "zip_code"]


@query(
    "with t as (" + " union all ".join(f"select '{c}' as \"column\", trim({c}) as v from faa_master where {c} is not null" for c in _ALL_FAA) + f"), s as (select \"column\", avg((v in ({', '.join(repr(x) for x in _STATES.split())}))::int) as us_state, avg(regexp_matches(v, '^N[1-9][0-9]{{0,4}}[A-Z]{{0,2}}$')::int) as tail_number, avg((regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') or regexp_matches(v, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') or regexp_matches(v, '^[0-9]{{1,2}}-[A-Za-z]{{3}}-[0-9]{{2,4}}$') or regexp_matches(v, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$'))::int) as date, avg((v like '%_@_%._%')::int) as email from t group by 1) "
    "select \"column\", kind as semantic_type, round(share, 6) as share from s unpivot (share for kind in (us_state, tail_number, date, email)) where share >= 0.6"
)
def semantic_types_all(spark, d):
    return profile.semantic_types(table(spark, d, "faa_master"), _ALL_FAA).select("column", "semantic_type", r6("share"))



# drift


_OLD, _NEW = "select * from orders where o_orderkey % 4 <> 0", "select * from orders"
_DRIFTED = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
_SETS = "with old as (select * from orders where year(o_orderdate) < 1995), new as (select * from orders where year(o_orderdate) >= 1995), s as (" + " union all ".join(f"select '{c}' as \"column\", (select count(distinct {c}) from old)::double as a, (select count(distinct {c}) from new)::double as b, (select count(*) from (select {c} from old where {c} is not null intersect select {c} from new))::double as c" for c in _DRIFTED) + ")"


@query(_SETS + " select \"column\", round(1 - c / (a + b - c), 6) as distance, 1 - c / (a + b - c) > 0.5 as drifted, round(case when 1 - c / (a + b - c) > 0.5 then least(0.99, 0.5 + 0.5 * greatest(0, least(1, (1 - c / (a + b - c) - 0.5) / 0.5))) end, 6) as severity from s")
def value_set_drift(spark, d):
    o = table(spark, d, "orders")
    early = F.year("o_orderdate") < 1995
    return drift.value_set_drift(o.where(early), o.where(~early), _DRIFTED).select("column", r6("distance"), "drifted", r6("severity"))


@query("with old as (select * from orders where year(o_orderdate) < 1998), s as (" + " union all ".join(f"select (select count(distinct {c}) from old)::double as a, (select count(distinct {c}) from orders)::double as b" for c in _DRIFTED) + ") select (select count(*) from old) as old_rows, (select count(*) from orders) as new_rows, count(*) as comparable, count(*) filter (a / b >= 0.7 * a / b) as consistent, (select count(*) from orders) > (select count(*) from old) as append_mostly from s")
def append_mostly(spark, d):
    o = table(spark, d, "orders")
    return drift.append_mostly(o.where(F.year("o_orderdate") < 1998), o, _DRIFTED)


@query("select event_type, user_id, case when value >= 500 then case event_type when 'click' then 'evolve' when 'view' then 'reverify' when 'purchase' then 'quarantine' else 'suppressed' end else 'suppressed' end as route, count(*) as n from events group by 1, 2, 3")
def drift_routes(spark, d):
    kind = F.create_map(F.lit("click"), F.lit("schema"), F.lit("view"), F.lit("distribution"), F.lit("purchase"), F.lit("quality"))
    signals = table(spark, d, "events").withColumn("kind", F.try_element_at(kind, F.col("event_type"))).withColumn("severity", F.col("value") / 1000)
    return drift.route(signals).groupBy("event_type", "user_id", "route").agg(F.count(F.lit(1)).alias("n"))


# relationships


@query("select 5::bigint as tables, kind from (select 'relational' as kind)")
def estate_kind(spark, d):
    """The kind of the star schema as a whole; its fingerprint decides."""
    names = ["region", "nation", "customer", "supplier", "orders"]
    tables = {t: (df := table(spark, d, t), df.columns) for t in names}
    return relationships.estate(tables).select("tables", "kind")


@query("with l as (select o_custkey::double as x from orders), a as (select count(distinct o_custkey)::double / count(*) as u from orders), b as (select count(distinct c_custkey)::double / count(*) as u from customer) select 'orders.o_custkey' as left, 'customer.c_custkey' as right where (select u from b) >= 0.95 and (select u from a) < 0.98")
def credible_joins(spark, d):
    """Of a reference and a range of numbers that lies inside another one, only the reference is credible."""
    tables = {"orders": (table(spark, d, "orders"), ["o_custkey"]), "customer": (table(spark, d, "customer"), ["c_custkey", "c_nationkey"]), "supplier": (table(spark, d, "supplier"), ["s_suppkey"])}
    found = relationships.signals(tables, [("orders.o_custkey", "customer.c_custkey"), ("supplier.s_suppkey", "customer.c_custkey"), ("supplier.s_suppkey", "customer.c_nationkey")])
    return relationships.credible_joins(found).where("containment_lr >= 0.6").select("left", "right")


# identities


_CODE = "regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]+', '', 'g'), '^0+(.)', '\\1')"


@query(f"with p as (select {_CODE.format('supplier_id')} as k, min(contract_number) as lo, max(contract_number) as hi from supplier_contracts where supplier_id is not null group by 1) select distinct po_number || '|' || po_line_item as child_id, lo as parent_id from purchase_order_lines join p on {_CODE.format('vendor_id')} = k where lo = hi and k <> ''")
def identity_links(spark, d):
    """Order lines and the contract of their vendor, where the vendor has one contract only."""
    lines = table(spark, d, "purchase_order_lines").withColumn("line", F.concat_ws("|", "po_number", "po_line_item"))
    return identity.resolve_links(lines, "line", "vendor_id", table(spark, d, "supplier_contracts"), "contract_number", "supplier_id", "code")


def _variants_sql() -> str:
    values = {"customer.padded": "select lpad(c_custkey::varchar, 9, '0') as v from customer", "orders.o_custkey": "select o_custkey::varchar from orders", "supplier.s_name": "select s_name from supplier"}
    rows = " union all ".join(f"select '{c}' as col, v as value, count(*) as n from ({s}) t(v) where v is not null group by 2" for c, s in values.items())
    return f"""with v as ({rows}), c as (select distinct col, {_CODE.format('value')} as code from v), f as (select col, count(*)::double as d, sum(n)::double as rows from v group by 1), k as (select col, count(*)::double as codes from c where code <> '' group by 1),
  plain as (select a.col as l, b.col as r, count(*)::double as same from v a join v b on a.value = b.value and a.col <> b.col group by 1, 2), met as (select a.col as l, b.col as r, count(*)::double as both from c a join c b on a.code = b.code and a.col <> b.col where a.code <> '' group by 1, 2)
  select met.l as left, met.r as right, round(coalesce(same, 0) / f.d, 6) as plain, round(met.both / k.codes, 6) as residual from met join f on f.col = met.l join k on k.col = met.l left join plain using (l, r) where met.both / k.codes >= 0.6 and met.both / k.codes >= 2 * coalesce(same, 0) / f.d and f.d / f.rows >= 0.8"""


@query(_variants_sql())
def identifier_variants(spark, d):
    """Padded customer numbers are variants of the plain ones of orders."""
    c = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("padded"))
    values = relationships.column_values({"customer": (c, ["padded"]), "orders": (table(spark, d, "orders"), ["o_custkey"]), "supplier": (table(spark, d, "supplier"), ["s_name"])})
    return identity.variant_columns(values).select("left", "right", r6("plain"), r6("residual"))


@query("select reg_key, trim(regexp_replace(regexp_replace(upper(registrant_name), '[.''’]', '', 'g'), '[^A-Z0-9]+', ' ', 'g')) as name, regexp_replace(regexp_replace(upper(n_number), '[\\s-]+', '', 'g'), '^N([0-9])', '\\1') as tail from faa_master where not regexp_matches(upper(coalesce(registrant_name, '')), '[^\\x00-\\x7f]')")
def mention_normal_forms(spark, d):
    faa = table(spark, d, "faa_master").where(~F.upper(F.coalesce("registrant_name", F.lit(""))).rlike(r"[^\x00-\x7f]"))
    return faa.select("reg_key", identity.norm_name(F.col("registrant_name")).alias("name"), identity.norm_tail(F.col("n_number")).alias("tail"))


# programs


@query("select o_orderkey as key, upper(o_orderpriority) as priority, c_mktsegment as segment from orders left join customer on o_custkey = c_custkey and c_custkey % 3 <> 0 where o_totalprice > 1000")
def program_lookup(spark, d):
    """A program with a filter and a lookup that finds no partner for some rows."""
    p = programs.Program("orders", {"key": "s.o_orderkey", "priority": "upper(s.o_orderpriority)", "segment": "r.c_mktsegment"}, "s.o_totalprice > 1000", programs.Lookup("customer", "o_custkey", "c_custkey"))
    return programs.compile_program(p, {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer").where("c_custkey % 3 <> 0")})


@query("select l_orderkey as key, min(upper(l_returnflag)) as flag, min(l_quantity) as quantity, count(*) as behind from lineitem group by 1")
def program_group(spark, d):
    p = programs.Program("lineitem", {"key": "s.l_orderkey", "flag": "upper(s.l_returnflag)", "quantity": "s.l_quantity"}, group=("key",))
    return programs.compile_program(p, {"lineitem": table(spark, d, "lineitem")}, tagged=True).withColumn("behind", F.size("row_ids").cast("long")).drop("row_ids")


@query("select distinct o_custkey as customer, min(o_orderstatus) over (partition by o_custkey) as status from orders")
def program_dedupe(spark, d):
    p = programs.Program("orders", {"customer": "s.o_custkey", "status": "s.o_orderstatus"}, dedupe=("customer",))
    return programs.compile_program(p, {"orders": table(spark, d, "orders")})


@query("select count(*) as source_rows, count(*) as result_rows, count(*) as traced, count(*) as covered, true as accepted from shipments")
def program_acceptance(spark, d):
    """Every source row is behind one result, and held-out rows meet the checks."""
    p = programs.Program("shipments", {"id": "s.shipment_id", "mode": "upper(trim(s.transport_mode))"})
    checked = programs.accepted(programs.verify(p, {"shipments": table(spark, d, "shipments")}, {"id": "id is not null", "mode": "mode = upper(mode)"}), p)
    return checked.select("source_rows", "result_rows", "traced", "covered", "accepted")


# ledger, lineage, people's edits


@query("select event_type as task, null::int as tier, count(*) as n, sum(event_id % 100) as tokens from events group by 1 union all select 'decision', (user_id % 3)::int, count(*), sum(event_id % 7) from events group by 2")
def cost_rollup(spark, d):
    e = table(spark, d, "events")
    costs = e.select(F.col("event_type").alias("task"), (F.col("event_id") % 100).alias("tokens"), F.col("ts").alias("created_at"))
    return ledger.cost_rollup(costs, e.select((F.col("user_id") % 3).alias("tier"), (F.col("event_id") % 7).alias("cost_tokens")))


@query("select row_number() over (order by ts, event_type, event_id) + 100 as seq, event_type as task, event_id as tokens from events")
def ledger_append(spark, d):
    """Costs numbered by time after what is held."""
    fresh = table(spark, d, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("tokens"), F.col("ts").alias("created_at"))
    return ledger.append("cost", spark.createDataFrame([(100,)], "seq long"), fresh).select("seq", "task", "tokens")


@query("select 'user/' || user_id as entity_uri, event_type as prop, event_id as seq, a as atom_id, case when a = 'a1' then 'erp' else 'crm' end as source, 'events' as \"table\", event_id::varchar as \"row\", 'value' as \"column\" from (select *, unnest(['a' || (1 + event_id % 2)]) as a from events)")
def cell_lineage(spark, d):
    cells = event_cells(spark, d)
    leaves = cells.select("prov_ref", F.concat(F.lit("a"), (1 + F.col("seq") % 2).cast("string"), F.lit(":"), F.col("seq").cast("string")).alias("atom_id"))
    atoms = cells.select(F.concat(F.lit("a"), (1 + F.col("seq") % 2).cast("string"), F.lit(":"), F.col("seq").cast("string")).alias("atom_id"), F.concat_ws("/", F.when(F.col("seq") % 2 == 0, "erp").otherwise("crm"), F.lit("events"), F.col("seq").cast("string"), F.lit("value")).alias("uri"))
    return ledger.cell_lineage(cells, leaves, atoms).withColumn("atom_id", F.substring_index("atom_id", ":", 1))


@query(f"with w as (select distinct 'user/' || user_id as entity_uri from events) select entity_uri, 'note' as prop, 0 as src_rank, 'seen ' || entity_uri as value_str from w")
def human_edit(spark, d):
    """A note of a person on every entity; it wins over whatever a pipeline says."""
    cells = event_cells(spark, d)
    edits = cells.select("entity_uri").distinct().select("entity_uri", F.lit("note").alias("prop"), F.concat(F.lit('"seen '), "entity_uri", F.lit('"')).alias("value_json"), F.lit("ticket 7").alias("evidence"))
    return scan(human_edits(cells, edits, {"note": "text"}, 1_800_000_000_000_000), F.col("expired_at") >= FOREVER).where("prop = 'note'").select("entity_uri", "prop", "src_rank", "value_str")


@query("select event_id, value::varchar as value_str, value as value_num, event_type as text_str from events")
def value_mirrors(spark, d):
    text, number = mirrors(F.col("value").cast("string"))
    quoted, _ = mirrors(F.concat(F.lit('"'), "event_type", F.lit('"')))
    return table(spark, d, "events").select("event_id", text.alias("value_str"), number.alias("value_num"), quoted.alias("text_str"))


# privacy, samples


@query("select t.* from (values ('c_name', 'quasi'), ('c_custkey', 'none'), ('c_mktsegment', 'none'), ('email', 'pii'), ('contact', 'pii')) t(\"column\", sensitivity)")
def column_sensitivity(spark, d):
    """Made-up contact columns beside the customer's own: what holds personal data, and what only sounds like it."""
    c = table(spark, d, "customer").select("c_name", "c_custkey", "c_mktsegment", F.concat("c_custkey", F.lit("@example.com")).alias("email"), F.when(F.col("c_custkey") % 2 == 0, "call 555-123-4567").otherwise("none given").alias("contact"))
    return privacy.sensitivity(c).select("column", "sensitivity")


@query("select 'c' as \"table\", 'name' as \"column\", c_name as value, count(*) as n from customer where c_custkey % 5 = 0 group by c_name")
def leak_scan(spark, d):
    """A table in which every fifth name was left as it is."""
    c = table(spark, d, "customer")
    given = c.select(F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.sha2("c_name", 256)).alias("name"))
    return privacy.leaks({"c": (given, ["name"])}, c.select(F.col("c_name").alias("value")))


@query("with v as (select distinct o_custkey::varchar as value from orders where o_custkey is not null), r as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from v) select value from r where exists (select 1 from range(0, 64) t(k) where round_even(k * (n - 1) / 63.0, 0) = i)")
def even_sample(spark, d):
    return sampling.even_sample(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k")), "k", 64).withColumnRenamed("k", "value")


# restricted SQL


@query("select c_name as name, o_orderdate as at from customer left join orders on c_custkey = o_custkey and o_totalprice > 100000 order by o_orderdate nulls last, c_name")
def transform_left_join(spark, d):
    sql = "select c.c_name as name, o.o_orderdate as at from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 100000 order by o.o_orderdate nulls last, c.c_name"
    return transforms.run_sql(spark, sql, {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders")})


@query("select o_custkey as customer, min(o_totalprice) as least, count(distinct o_orderstatus) as kinds, max(upper(trim(o_orderpriority))) as top, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as done from orders where o_totalprice between 1000 and 200000 group by o_custkey")
def transform_aggregate(spark, d):
    sql = "select o_custkey as customer, min(o_totalprice) as least, count(distinct o_orderstatus) as kinds, max(upper(trim(o_orderpriority))) as top, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as done from orders where o_totalprice between 1000 and 200000 group by o_custkey"
    return transforms.run_sql(spark, sql, {"orders": table(spark, d, "orders")})


# searches and documents





@query("select 'o_orderkey' as \"column\", count(*) filter (o_orderkey is null) as n from orders union all select 'c_name', count(*) filter (upper(trim(c_name)) in ('', 'N/A', 'NA', 'NULL', 'NONE', '-', '--', '?', 'UNK', 'UNKNOWN', 'NAN', 'NIL', 'MISSING', '#N/A')) from customer union all select 'city', count(*) filter (upper(trim(city)) in ('', 'N/A', 'NA', 'NULL', 'NONE', '-', '--', '?', 'UNK', 'UNKNOWN', 'NAN', 'NIL', 'MISSING', '#N/A')) from faa_master")
def null_token_counts(spark, d):
    def counted(t: str, c: str):
        col = F.col(c).cast("string")
        hit = col.isNull() if c == "o_orderkey" else col.isNotNull() & cleaning.null_tokens(col).isNull()
        return table(spark, d, t).agg(F.lit(c).alias("column"), F.sum(hit.cast("int")).alias("n"))

    return counted("orders", "o_orderkey").unionByName(counted("customer", "c_name")).unionByName(counted("faa_master", "city"))


# the store, read in other ways


@query(f"with {_CELLS_SQL}, w as (select entity_uri, prop, value_num, value_str from (select *, value_num::varchar as value_str, row_number() over (partition by entity_uri, prop order by src_rank, confidence desc, created_at desc, seq desc) n from cells where expired_at >= {FOREVER}) where n = 1) select entity_uri, prop, value_num from w where entity_uri in (select entity_uri from w where prop = 'click' and value_num >= 0 and value_str = (select value_str from w where prop = 'click' order by entity_uri limit 1))")
def scan_equal(spark, d):
    """Entities whose winning cell of one property has a given value."""
    cells = event_cells(spark, d)
    won = scan(cells, F.col("expired_at") >= FOREVER)
    value = won.where("prop = 'click'").orderBy("entity_uri").first()["value_str"]
    return scan(cells, F.col("expired_at") >= FOREVER, {"click": value}).select("entity_uri", "prop", "value_num")


@query("select distinct 'order/' || o_orderkey as uri, 'customer/' || o_custkey as neighbor from orders where o_orderkey % 3 <> 0")
def link_neighbors(spark, d):
    return neighbors(_order_links(spark, d), "placed_by")


@query("select distinct 'customer/' || o_custkey as uri, 'order/' || o_orderkey as neighbor from orders where o_orderkey % 3 <> 0")
def link_neighbors_reverse(spark, d):
    return neighbors(_order_links(spark, d), "placed_by", reverse=True)


def _order_links(spark, d):
    closed = F.col("o_orderkey") % 3 == 0
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("subject_uri"), F.lit("placed_by").alias("predicate"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("object_uri"), F.lit(0).cast("long").alias("valid_from"), F.when(closed, F.lit(10)).otherwise(F.lit(FOREVER)).cast("long").alias("valid_to"), F.lit(1).cast("long").alias("created_at"), F.lit(FOREVER).alias("expired_at"))


# profiles of whole tables


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(" union all ".join(f"select '{c}' as \"column\", round((count(*) - count({c}))::double / count(*), 6) as null_rate, round(count(distinct {c})::double / count({c}), 6) as uniqueness from orders" for c in _ORDER_COLUMNS) + " union all " + " union all ".join(f"select '{c}', round((count(*) - count({c}))::double / count(*), 6), round(count(distinct {c})::double / nullif(count({c}), 0), 6) from faa_master" for c in _ALL_FAA))
def null_rates(spark, d):
    a = profile.profile_columns(table(spark, d, "orders"), _ORDER_COLUMNS)
    b = profile.profile_columns(table(spark, d, "faa_master"), _ALL_FAA)
    return a.unionByName(b).select("column", r6("null_rate"), r6("uniqueness"))


@query("with l as (select l_orderkey as k, count(*) as n from lineitem group by 1) select round(max(n), 6) as fan_out_max, 1::bigint as reverse_fan_out_max, (select count(*) from l) as right_keys from l")
def key_multiplicity(spark, d):
    """The most lines an order has, from the executed join's multiplicities."""
    from siltstone.operators import dependencies

    return dependencies.validate_join(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey").select("fan_out_max", "reverse_fan_out_max", "right_keys")


@query("select event_id, user_id from events where event_id % 10 <> 0")
def header_rows(spark, d):
    """Every tenth row repeats the header; these go."""
    e = table(spark, d, "events")
    cell = lambda c: F.when(F.col("event_id") % 10 == 0, F.lit(f" {c.upper()} ")).otherwise(F.col(c).cast("string")).alias(c)
    out = cleaning.without_header_rows(e.select(cell("event_id"), cell("user_id")), ["event_id", "user_id"])
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"))


@query("select 'constant' as \"column\" union all select 'empty'")
def constant_columns(spark, d):
    o = table(spark, d, "orders").withColumn("constant", F.lit(7)).withColumn("empty", F.lit(None).cast("string"))
    return spark.createDataFrame([(c,) for c in cleaning.constant_columns(o)], "column string")


# provenance


@query("select distinct 'a' || (c_custkey % 1000) as atom_id from customer where 'a' || (c_custkey % 1000) not in (select 'a' || (s_suppkey % 1000) from supplier)")
def register_atoms(spark, d):
    atom = lambda t, k: table(spark, d, t).select(F.concat(F.lit("a"), (F.col(k) % 1000).cast("string")).alias("atom_id"))
    return provenance.register_atoms(atom("supplier", "s_suppkey"), atom("customer", "c_custkey"))


@query("select '[[0,1],[2]]' as shape_json, count(*) filter (o_custkey % 2 = 0) as terms from orders union all select '[[0,1],[0]]', count(*) filter (o_custkey % 2 = 1) from orders")
def intern_terms(spark, d):
    """Terms of two shapes over ever other atoms are stored as two shapes."""
    a = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.array(F.array(a("x", "o_orderkey"), a("y", "o_custkey")), F.array(a("z", "o_custkey")))).otherwise(F.array(F.array(a("x", "o_orderkey"), a("y", "o_custkey")), F.array(a("x", "o_orderkey")))).alias("term"))
    shapes, terms = provenance.intern_terms(t)
    return terms.join(F.broadcast(shapes), "shape_hash").groupBy("shape_json").agg(F.count(F.lit(1)).alias("terms"))


@query("select prov_ref, least(2, len(x)) as n_union, len(x) >= 1 as derivable, round(case when len(x) >= 1 then 0.5 end, 6) as best from (select distinct prov_ref, list_distinct(regexp_extract_all(leaf_ids, 'a[0-9]+')) as x from prov_term) where len(x) >= 1")
def provenance_sums(spark, d):
    """The union of two terms, whether one can be derived from its first atom, and its best confidence."""
    leaves = F.array_distinct(F.regexp_extract_all("leaf_ids", F.lit("(a[0-9]+)"), F.lit(1)))
    t = table(spark, d, "prov_term").select("prov_ref", leaves.alias("x")).where("size(x) >= 1").distinct()
    first, last = F.array(F.array(F.get("x", 0))), F.array(F.array(F.element_at("x", -1)))
    return t.select("prov_ref", F.size(provenance.plus(first, last)).cast("long").alias("n_union"), provenance.derivable(first, F.array(F.get("x", 0))).alias("derivable"), F.round(provenance.best_confidence(first, F.create_map(F.get("x", 0), F.lit(0.5))), 6).alias("best"))


# evolution


@query("select c_custkey, c_name, c_acctbal from customer")
def backward_chain(spark, d):
    """Added, dropped, specialized, generalized, faceted, retired and demoted: the old version still answers."""
    t = {"Customer": table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")}
    ops = [evolve.AddProperty("Customer", "note", "string"), evolve.DropProperty("Customer", "c_custkey", "c_name"), evolve.Specialize("Customer", "c_acctbal > 0"), evolve.Generalize("Customer", "c_acctbal > 0", "c_acctbal > -500"), evolve.AddFacet("Customer", "Money", "c_custkey", ("c_acctbal",)), evolve.RetireFacet("Customer", "Money", "c_custkey", ("c_acctbal",)), evolve.AddClass("Visit", "id long"), evolve.DropClass("Visit", "id long")]
    return evolve.view(evolve.evolve(t, ops), ops)["Customer"].select("c_custkey", "c_name", "c_acctbal")


@query("select c_custkey, c_acctbal from customer where c_acctbal > -500")
def generalized(spark, d):
    t = {"Customer": table(spark, d, "customer").select("c_custkey", "c_acctbal")}
    return evolve.evolve(t, [evolve.Specialize("Customer", "c_acctbal > 0"), evolve.Generalize("Customer", "c_acctbal > 0", "c_acctbal > -500")])["Customer"]


@query("select c_custkey, c_mktsegment from customer")
def promoted_and_demoted(spark, d):
    t = {"Customer": table(spark, d, "customer").select("c_custkey", "c_mktsegment")}
    return evolve.evolve(t, [evolve.PromoteProperty("Customer", "c_mktsegment", "Segment"), evolve.DemoteClass("Customer", "c_mktsegment", "Segment")])["Customer"].select("c_custkey", "c_mktsegment")


# the algebra over a hierarchy; exports; clusters


@query("select k::varchar as k, balance from (select s_suppkey as k, s_acctbal as balance from supplier union all select c_custkey, c_acctbal from customer) where balance > 9000")
def subclass_union(spark, d):
    """A class with two below it: its extent is theirs together."""
    props = {"k": "integer", "balance": "float"}
    party = Ontology({"Party": ClassDef("Party", "k", props), "Supplier": ClassDef("Supplier", "k", {}, ("Party",)), "Customer": ClassDef("Customer", "k", {}, ("Party",))}, {})
    s, c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return compile_term(Select("Party", (Condition("balance", ">", 9000),)), World(party, {"Supplier": s, "Customer": c})).select(F.col("k").cast("string").alias("k"), "balance")


@query(f"with {_CELLS_SQL}, w as (select * from (select *, row_number() over (partition by entity_uri, prop order by src_rank, confidence desc, created_at desc, seq desc) n from cells where expired_at >= {FOREVER}) where n = 1) select entity_uri, prop, value_num from w")
def triples_roundtrip(spark, d):
    """The winning cells written as triples and read again."""
    lines = bundle.triples(event_cells(spark, d))
    part = lambda i: F.regexp_extract("line", r'^<urn:siltstone:([^>]*)> <urn:siltstone:([^>]*)> "([^"]*)" \.$', i)
    return lines.select(part(1).alias("entity_uri"), part(2).alias("prop"), part(3).cast("double").alias("value_num"))


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal >= 100.5 and c_name <> 'x' and contains(lower(c_mktsegment), 'build')")
def csv_slice(spark, d):
    c = table(spark, d, "customer")
    return bundle.extract(c, "c_custkey", ["c_name", "c_acctbal"], [("c_acctbal", ">=", "100.5"), ("c_name", "!=", "x"), ("c_mktsegment", "contains", "BUILD")], 2**31 - 1)


@query("with o as (select o_custkey as c, o_orderstatus as s, count(*) as n from orders group by 1, 2), b as (select c, s, row_number() over (partition by s order by n desc, c desc) as i from o) select s as uri, c as cluster from (select s, max_by(c, struct_pack(n := n, c := c)) as c from (select c, max(n) as n, any_value(s) as s from (select o.*, max(n) over (partition by c) as m from o) where n = m group by c having count(*) = 1) group by s)")
def uri_owner(spark, d):
    """Of the customers whose most frequent status is clear, the one that holds most orders of each status keeps its uri."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("cluster"), F.col("o_orderstatus").alias("uri"))
    counts = o.groupBy("cluster", "uri").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cluster").agg(F.max("n").alias("m"))
    clear = counts.join(best, "cluster").where("n = m").groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("cluster")
    kept = o.join(clear, "cluster", "left_semi")
    named = clusters.assign_identifiers(kept.select("record", "cluster"), kept.select("record", "uri"))
    return named.join(kept.select("record", "cluster"), "record").where(~F.col("uri").startswith("ent/")).select("uri", "cluster").distinct()
