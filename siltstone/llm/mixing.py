"""Mixing sources to target weights.

Each source gets its target share of the total size in tokens. A text that occurs m times in its source is due
min(cap, rate * m) copies, where the source's rate makes its tokens meet the target. Whole copies are certain; for
the fraction that remains each text has inclusion probability p, and Pareto order sampling takes the texts with
the smallest (u / (1 - u)) / (p / (1 - p)), u uniform, until the source's remaining tokens are used: a sample of
fixed size with unequal probabilities.

The rank within a source is never computed over the whole source in one task: ranks are cut into BUCKETS of the
rank's own scale, buckets are summed, and only the one bucket in which the target is met is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tokens import TOKENIZER_FILE, with_token_counts
from siltstone.session import cut

BUCKETS = 65_536


def source_name(c):
    """A source's name without padding and case; null and null tokens give null."""
    t = F.lower(F.trim(c))
    return F.when(~t.isin("", "null", "n/a", "-", "tbd"), t)


def distinct_texts(documents: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(source, text_key, doc, n_tokens, times): one row per text that isn't empty. A text that stands in several
    sources belongs to the one of its smallest key, so that it is never used beyond one source's cap."""
    rows = with_token_counts(documents.select(F.col(key).alias("doc"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")), "text", tokenizer)
    rows = rows.where("text_key is not null and n_tokens > 0 and source is not null").distinct()
    return rows.groupBy("text_key").agg(F.min_by("source", F.struct("doc", "source")).alias("source"), F.min("doc").alias("doc"), F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("times"))


def _rate(groups: list[tuple[int, int]], cap: int, wanted: float) -> float:
    """rate with sum(tokens * min(cap, rate * times)) = wanted, over (times, tokens) of texts seen equally often."""
    groups = sorted(groups, reverse=True)
    capped, open_weight = 0, sum(times * tokens for times, tokens in groups)
    for times, tokens in groups:
        rate = (wanted - cap * capped) / open_weight if open_weight else 0.0
        if rate * times <= cap:
            return max(rate, 0.0)
        capped += tokens
        open_weight -= times * tokens
    return float(cap)


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(source, key, n_tokens, copies) of the texts used, copies >= 1.

    targets: source, target_share, max_repeats. total_tokens: the size of the mixture; by default the largest at
    which every source that has texts can meet its share within its cap. A source that can't meet its share of a
    larger given total gives all it may. Sources without a target, and texts that are null or empty, are not used.
    Shares of sources without any text are left out of the default total; `shares` reports them with 0.
    """
    texts = cut(distinct_texts(documents, key, text, source, tokenizer))
    goal = {}
    for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").collect():  # one row a source
        goal[r["source"]] = (float(r["target_share"]), max(0, int(r["max_repeats"] or 0)))
    # texts seen equally often: distinct counts whose sum is a source's rows, so few
    seen = texts.where(F.col("source").isin(list(goal))).groupBy("source", "times").agg(F.sum("n_tokens").alias("tokens")).collect()
    held: dict[str, list[tuple[int, int]]] = {}
    for r in seen:
        held.setdefault(r["source"], []).append((r["times"], r["tokens"]))
    room = {s: goal[s][1] * sum(t for _, t in g) for s, g in held.items()}
    if total_tokens is None:
        total_tokens = int(min((room[s] / goal[s][0] for s in held), default=0))
    plans = []
    for s, groups in held.items():
        wanted = min(float(room[s]), total_tokens * goal[s][0])
        plans.append((s, _rate(groups, goal[s][1], wanted), goal[s][1], wanted))
    spark = documents.sparkSession
    plan = spark.createDataFrame(plans, "source string, rate double, cap int, wanted double")
    due = texts.join(F.broadcast(plan), "source").withColumn("due", F.least(F.col("cap").cast("double"), F.col("rate") * F.col("times")))
    due = due.withColumn("whole", F.floor(F.col("due") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    due = due.withColumn("q", F.when(F.col("p") > 1e-9, odds)).withColumn("bucket", F.floor(BUCKETS * F.col("q") / (1 + F.col("q"))).cast("int"))
    due = cut(due)
    certain = due.groupBy("source").agg(F.sum(F.col("whole").cast("long") * F.col("n_tokens")).alias("certain"))
    sums = due.where("q is not null").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    below = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # per source the bucket in which what is left to fill is met: one row a source
    left = plan.join(certain, "source").select("source", (F.col("wanted") - F.col("certain")).alias("left"))
    edge = sums.withColumn("below", below).join(F.broadcast(left), "source").where("below < left").groupBy("source").agg(F.max("bucket").alias("edge"), F.max("below").alias("below"), F.first("left").alias("left"))
    ranked = due.join(F.broadcast(edge), "source", "left")
    inner = ranked.where("bucket = edge")
    order = Window.partitionBy("source").orderBy("q", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("extra", (F.col("below") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) + F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    outer = ranked.where("bucket is null or edge is null or bucket <> edge").withColumn("extra", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    used = inner.unionByName(outer).withColumn("copies", F.col("whole") + F.col("extra"))
    return used.where("copies > 0").select("source", F.col("doc").alias(key), "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: target_share, actual_share, tokens, texts and the most copies of one text."""
    held = mixed.groupBy("source").agg(F.sum(F.col("copies").cast("long") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = goal.join(held, "source", "left").na.fill(0, ["tokens", "texts", "most_copies"])
    everything = rows.agg(F.sum("tokens").alias("all_tokens"))
    return rows.join(F.broadcast(everything)).select("source", "target_share", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), "tokens", "texts", "most_copies", "max_repeats")
