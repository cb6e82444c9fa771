"""The queries p1, p3, p5 and p7: the core operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import is_absent, key_chars, micros, parse_day, present
from siltstone.operators import event_time, load_profile, orphans, unit_conversion
from siltstone.session import table


def tail(c):
    """A tail number ignoring case, blanks, hyphens and one leading N; null for null tokens."""
    return F.regexp_replace(key_chars(present(c)), "^N", "")


def registration_versions(faa: DataFrame) -> DataFrame:
    day = 86_400_000_000
    issued, known = micros(parse_day(F.col("cert_issue_date"))), micros(F.col("loaded_at"))
    expires = micros(parse_day(F.col("expiration_date")))
    return faa.select(
        tail(F.col("n_number")).alias("entity"),
        F.col("reg_key").alias("version"),
        F.when(issued.isNotNull() & known.isNotNull(), F.greatest(issued, known)).alias("start"),
        (expires + day).alias("end"),
        issued.alias("major"),
        known.alias("minor"),
    )


def work_orders_with_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "maintenance_erp").select("work_order_id", tail(F.col("tail_number")).alias("entity"), micros(F.col("open_date")).alias("at"))
    segments = event_time.timeline(registration_versions(table(spark, sf_dir, "faa_master")))
    return event_time.carry_forward(orders, segments)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = work_orders_with_registration(spark, sf_dir).where("version is not null")
    return known.select(F.col("version").alias("reg_key"), "work_order_id").distinct()


P1_FOUND_SQL = r"""
with day as (
  select *, upper(regexp_replace(n_number, '[\s\-]+', '', 'g')) k,
    case when regexp_matches(trim(cert_issue_date), '^\d{8}$') then try_strptime(trim(cert_issue_date), '%Y%m%d')
         else try_strptime(trim(cert_issue_date), ['%Y-%m-%d', '%d-%b-%Y', '%m/%d/%Y']) end issued,
    case when regexp_matches(trim(expiration_date), '^\d{8}$') then try_strptime(trim(expiration_date), '%Y%m%d')
         else try_strptime(trim(expiration_date), ['%Y-%m-%d', '%d-%b-%Y', '%m/%d/%Y']) end expires
  from faa_master where upper(trim(coalesce(n_number, ''))) not in ('', 'NULL', 'N/A', '-', 'TBD')),
orders as (
  select distinct work_order_id, open_date, regexp_replace(upper(regexp_replace(tail_number, '[\s\-]+', '', 'g')), '^N', '') k
  from maintenance_erp where upper(trim(coalesce(tail_number, ''))) not in ('', 'NULL', 'N/A', '-', 'TBD')),
best as (
  select work_order_id, reg_key, row_number() over (partition by work_order_id, orders.k, open_date order by issued desc, loaded_at desc, reg_key desc) n
  from orders join (select distinct reg_key, regexp_replace(k, '^N', '') k, issued, expires, loaded_at from day where issued is not null) d using (k)
  where issued <= open_date and (expires is null or open_date < expires + interval 1 day) and d.loaded_at <= open_date)
select distinct reg_key, work_order_id from best where n = 1
"""


def weight_records(shipments: DataFrame) -> DataFrame:
    number = lambda c: unit_conversion.amount(F.col(c))
    return unit_conversion.prepare(shipments, table_name="shipments", row_key=F.col("shipment_id"), family="weight", figure=F.col("gross_weight"), unit_column=F.col("weight_uom"), category=F.col("transport_mode"), place=F.col("origin_port"), near=[number("freight_cost")])


def area_records(leases: DataFrame) -> DataFrame:
    rent, size = unit_conversion.amount(F.col("base_rent_annual")), unit_conversion.amount(F.col("square_footage"))
    stated = F.when(is_absent(F.col("area_uom")), F.when(F.upper(F.trim("country")).isin("US", "CA"), "sqft").otherwise("sqm"))
    return unit_conversion.prepare(leases, table_name="leases", row_key=F.concat_ws("|", "lease_id", "amendment_no"), family="area", figure=F.col("square_footage"), unit_column=F.col("area_uom"), default=stated, category=F.col("property_type"), place=F.col("country"), near=[rent, F.try_divide(rent, size)])


def count_records(lines: DataFrame) -> DataFrame:
    number = lambda c: unit_conversion.amount(F.col(c))
    per_line = F.try_divide(number("net_value_usd"), F.try_divide(number("order_qty") * number("net_price"), number("price_unit")))
    text = F.when(is_absent(F.col("order_uom")), unit_conversion.count_unit_in_text(F.col("short_text")))
    return unit_conversion.prepare(lines, table_name="purchase_order_lines", row_key=F.concat_ws("|", "po_number", "po_line_item"), family="count", figure=F.col("order_qty"), unit_column=F.col("order_uom"), unit_text=text, category=F.col("purch_group"), place=F.col("plant_code"), near=[number("net_price"), per_line])


def quantity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weight_records(table(spark, sf_dir, "shipments")).unionByName(area_records(table(spark, sf_dir, "leases"))).unionByName(count_records(table(spark, sf_dir, "purchase_order_lines")))


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity with its unit, basis, confidence and value in the common unit; 'review' rows await a person."""
    records = quantity_records(spark, sf_dir)
    out = unit_conversion.convert(records, unit_conversion.fit(records))
    return out.select("table_name", "row_key", "value", "unit", "stated_unit", "predicted_unit", "basis", F.round("confidence", 6).alias("confidence"), F.round("canon_value", 6).alias("canon_value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = quantity_records(spark, sf_dir)
    out = unit_conversion.convert(records, unit_conversion.fit(records))
    foreign = out.where((F.col("basis") == "model") & ~F.col("unit").isin(*unit_conversion.COMMON.values()) & F.col("canon_value").isNotNull())
    return foreign.select("table_name", "row_key", F.round("canon_value").cast("long").alias("canon_value")).distinct()


def reference_rows(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """(table, references, parents) of the three kinds of reference."""
    digits = lambda c: F.when(~is_absent(c), F.when(F.length(F.trim(c)) < 10, F.lpad(F.trim(c), 10, "0")).otherwise(F.trim(c)))
    model = lambda c: key_chars(present(c))
    shape = lambda c: F.upper(F.regexp_replace(present(c), r"[\s ]+", ""))
    get = lambda name: table(spark, sf_dir, name)
    refs = lambda df, key, at, row: df.select(key.alias("key"), micros(F.col(at)).alias("at"), row.alias("row_key"))
    held = lambda df, key, at: df.select(key.alias("key"), micros(F.col(at)).alias("start"), micros(F.col("deleted_at")).alias("end"))
    return [
        ("purchase_order_lines", refs(get("purchase_order_lines"), digits(F.col("vendor_id")), "loaded_at", F.concat_ws("|", "po_number", "po_line_item")), held(get("supplier_contracts"), digits(F.col("supplier_id")), "loaded_at")),
        ("bom_components", refs(get("bom_components"), model(F.col("parent_model_code")), "loaded_at", F.col("bom_id")), held(get("products"), model(F.col("model_code")), "loaded_at")),
        ("prov_term", refs(get("prov_term"), shape(F.col("shape_hash")), "created_at", F.col("prov_ref")), held(get("prov_shape"), shape(F.col("shape_hash")), "created_at")),
    ]


def all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of the three tables in one pass: the table's name goes before the key."""
    references, parents = None, None
    for name, refs, held in reference_rows(spark, sf_dir):
        mark = lambda df, n=name: df.withColumn("key", F.concat(F.lit(n + ":"), "key"))
        refs = mark(refs).withColumn("row_key", F.concat(F.lit(name + ":"), "row_key"))
        references = refs if references is None else references.unionByName(refs)
        parents = mark(held) if parents is None else parents.unionByName(mark(held))
    found = orphans.orphans(references, parents)
    return found.select(F.substring_index("row_key", ":", 1).alias("table_name"), F.expr("substr(row_key, instr(row_key, ':') + 1)").alias("row_key"), "key", "at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_orphans(spark, sf_dir).select("table_name", "row_key").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(all_orphans(spark, sf_dir).distinct(), ["table_name"])


_P7_ORPHANS_SQL = r"""
refs as (
  select distinct 'purchase_order_lines' table_name, po_number || '|' || po_line_item row_key,
    case when length(trim(vendor_id)) < 10 then lpad(trim(vendor_id), 10, '0') else trim(vendor_id) end k, vendor_id raw, loaded_at seen from purchase_order_lines
  union select distinct 'bom_components', bom_id, upper(regexp_replace(parent_model_code, '[\s\-]+', '', 'g')), parent_model_code, loaded_at from bom_components
  union select distinct 'prov_term', prov_ref, upper(regexp_replace(shape_hash, '\s+', '', 'g')), shape_hash, created_at from prov_term),
parents as (
  select 'purchase_order_lines' table_name, lpad(trim(supplier_id), 10, '0') k, loaded_at s, deleted_at e from supplier_contracts
  union all select 'bom_components', upper(regexp_replace(model_code, '[\s\-]+', '', 'g')), loaded_at, deleted_at from products
  union all select 'prov_term', upper(regexp_replace(shape_hash, '\s+', '', 'g')), created_at, deleted_at from prov_shape),
orphans as (
  select table_name, row_key, k, seen from refs r where upper(trim(coalesce(raw, ''))) not in ('', 'NULL', 'N/A', '-', 'TBD')
  and not exists (select 1 from parents p where p.table_name = r.table_name and p.k = r.k and p.s <= r.seen and (p.e is null or p.e > r.seen)))
"""
P7_FOUND_SQL = f"with {_P7_ORPHANS_SQL} select distinct table_name, row_key from orphans"
P7_REPORT_SQL = f"with {_P7_ORPHANS_SQL} select table_name, strftime(seen, '%Y-%m') as month, count(*) as orphan_rows, count(distinct k) as missing_keys from orphans group by 1, 2"

def load_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiled cells of both tables that are delivered again and again."""
    skip = {"row_id", "load_no", "survey_year", "loaded_at"}
    parts = []
    for name in ("sb_penguins", "ds_employment_us_aat1"):
        df = table(spark, sf_dir, name)
        parts.append(load_profile.cells(df, name, "load_no", [c for c in df.columns if c not in skip]))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_departures(spark, sf_dir).drop("kinds")


def p5_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p5_found with the kinds of class that show each: masks, values or quantile bins."""
    found = load_profile.departures(load_cells(spark, sf_dir))
    return found.withColumn("kinds", F.array_join("kinds", ","))


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_profile.describe(load_cells(spark, sf_dir)).drop("top_mask")


def p5_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = load_profile.drift(load_cells(spark, sf_dir))
    return scores.select("table_name", "load_no", "column_name", "kind", "rare", F.round("divergence", 6).alias("divergence"), F.round("score", 6).alias("score"))


def p5_rare_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_profile.rare_masks(load_cells(spark, sf_dir))


_P5_COLUMNS = {
    "sb_penguins": ["species", "island", "bill_length_mm", "bill_depth_mm", "flipper_length_mm", "body_mass_g", "sex"],
    "ds_employment_us_aat1": ["population", "labor_force", "population_percent", "employed_total", "employed_percent", "unemployed", "unemployed_percent", "not_in_labor", "footnotes"],
}
_TEXTS = {"species", "island", "sex", "footnotes"}
P5_PROFILE_SQL = " union all ".join(
    f"select '{t}' as table_name, load_no, '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct, "
    + ("null::double as min_number, null::double as max_number" if c in _TEXTS else f"min({c})::double as min_number, max({c})::double as max_number")
    + f" from {t} group by load_no"
    for t, columns in _P5_COLUMNS.items()
    for c in columns
)

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_units": p3_units, "p5_found": p5_found, "p5_departures": p5_departures, "p5_profile": p5_profile, "p5_drift": p5_drift, "p5_rare_masks": p5_rare_masks, "p7_found": p7_found, "p7_report": p7_report}
SQL = {"p1_found": P1_FOUND_SQL, "p5_profile": P5_PROFILE_SQL, "p7_found": P7_FOUND_SQL, "p7_report": P7_REPORT_SQL}
