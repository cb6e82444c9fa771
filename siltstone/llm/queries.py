"""The queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import fold, is_absent
from siltstone.llm import groups, matching, mixing, name_variants, packing, text_stats, tokens
from siltstone.session import cut, release, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = groups.latest_matches(table(spark, sf_dir, "er_pairs"), "left_id", "right_id", "verdict", "decided_at")
    return groups.group_records(table(spark, sf_dir, "mention_to_uri"), "mention_id", edges)


P4_FOUND_SQL = """
with recursive decided as (
  select least(left_id, right_id) a, greatest(left_id, right_id) b, decided_at, coalesce(lower(trim(verdict)) = 'match', false) ok
  from er_pairs where left_id is not null and right_id is not null and left_id <> right_id),
last as (select a, b, ok, row_number() over (partition by a, b order by decided_at desc, ok desc) n from decided),
edges as (select a, b from last where n = 1 and ok union select b, a from last where n = 1 and ok),
reach(node, root) as (
  select mention_id, mention_id from (select distinct mention_id from mention_to_uri)
  union
  select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b)
select min(root) as group_id, node as mention_id from reach group by node
"""

def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.text_quality(table(spark, sf_dir, "documents")).where(F.col("kind") == "not_prose").select("doc_id")


def p10_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = text_stats.text_quality(table(spark, sf_dir, "documents"))
    return measures.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in measures.dtypes])


def _capacities(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    """Three rows, fixed."""
    return {r["pack_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return packing.pack(sizes, _capacities(spark, sf_dir), "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir), _capacities(spark, sf_dir))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def registrant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.link_registrants(table(spark, sf_dir, "faa_master"), "reg_key", "registrant_name", "street", "city", "state_code", "zip_code", "county")


def described_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bom_components without a model code: the model that the description means."""
    rows = table(spark, sf_dir, "bom_components").where(is_absent(F.col("parent_model_code"))).select("bom_id", fold(F.col("parent_description")).alias("name"))
    models = table(spark, sf_dir, "products").select(fold(F.col("product_name")).alias("name"), F.col("model_code").alias("model"))
    named = models.groupBy("model").agg(F.min("name").alias("product_name"))
    return rows.join(name_variants.link_models(rows, models), "name").join(named, "model")


def p2_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described_models(spark, sf_dir).select("bom_id", "name", "model").distinct()


def p2_registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrant_groups(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each half is cut off before the next is planned: one plan of all of it, and what planning leaves, fills the driver
    groups = cut(registrant_groups(spark, sf_dir))
    release(spark)
    pairs = name_variants.variant_pairs(groups)
    models = described_models(spark, sf_dir).where("name <> product_name").select(F.lit("bom_components").alias("table_name"), F.col("bom_id").alias("key_a"), F.col("model").alias("key_b"))
    models = cut(models.distinct())
    release(spark)
    return pairs.select(F.lit("faa_master").alias("table_name"), "key_a", "key_b").unionByName(models)


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(table(spark, sf_dir, "er_identity"), table(spark, sf_dir, "faa_master"))
    return found.withColumn("confidence", F.round("confidence", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("reg_key", "identity_id")


QUERIES = {"p6_found": p6_found, "p6_matches": p6_matches, "p2_found": p2_found, "p2_models": p2_models, "p2_registrants": p2_registrants, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p4_found": p4_found, "p10_found": p10_found, "p10_text_quality": p10_text_quality}
SQL = {"p4_found": P4_FOUND_SQL}
