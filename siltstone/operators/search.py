"""Search over texts and labels: hashed TF-IDF cosine, federated score bands, and usage-based criticality."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.session import cut

DIMENSIONS = 4096
#: Queries searched in one pass over the documents, and documents held against them at a time.
BLOCK, CHUNK = 1000, 1000


def _tokens(text: Column) -> Column:
    """The words of a text and the trigrams of each word longer than 3, so that parts of words are found."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 3, F.concat(F.array(w), grams(w))).otherwise(F.array(w))))


def _term_weights(df: DataFrame, key: str, text: str, dimensions: int) -> DataFrame:
    """(id, dim, tf): the sublinear weights of the tokens in each hash bucket, summed."""
    counts = df.select(F.col(key).alias("id"), F.explode(_tokens(F.col(text))).alias("t")).groupBy("id", "t").agg(F.count(F.lit(1)).alias("c"))
    dim = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    return counts.groupBy("id", dim.alias("dim")).agg(F.sum(1 + F.ln("c")).alias("tf"))


def _idf(tf: DataFrame, n: int) -> DataFrame:
    return tf.groupBy("dim").agg((F.ln((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))


def tfidf_search(df: DataFrame, key: str, text: str, query: str, k: int = 10, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, score) of the k documents nearest to the query by cosine of sublinear TF times smoothed IDF, ties by id."""
    spark = df.sparkSession
    tf = _term_weights(df, key, text, dimensions)
    idf = _idf(tf, df.count())
    # at most `dimensions` rows
    w = tf.join(F.broadcast(idf), "dim").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = _term_weights(spark.createDataFrame([("q", query)], "k string, t string"), "k", "t", dimensions).select("dim", F.col("tf").alias("qtf"))
    q = q.join(F.broadcast(idf), "dim", "left").withColumn("qw", F.col("qtf") * F.coalesce("idf", F.lit(1.0)))
    length = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = w.join(F.broadcast(q.select("dim", "qw")), "dim").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(norm, "id").join(F.broadcast(length)).select("id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _dense(dims, weights, dimensions: int) -> np.ndarray:
    out = np.zeros((len(dims), dimensions))
    for i, (at, w) in enumerate(zip(dims, weights, strict=True)):
        out[i, at] = w
    return out


def tfidf_search_rows(df: DataFrame, key: str, text: str, asked: Column, k: int = 10, dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """(query, id, score): as tfidf_search for every row that meets asked (a condition on the key) against all rows,
    itself included; scores to 9 digits, ties by id. Keys are unique.

    Queries go to the executors in blocks of about `block`, each a pass over the documents' vectors that keeps the
    best k of every partition."""
    spark = df.sparkSession
    tf = cut(_term_weights(df.where(F.col(key).isNotNull()), key, text, dimensions))
    w = tf.join(F.broadcast(_idf(tf, df.count())), "dim").select("id", F.struct("dim", (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    # the norm is an aggregate: as an expression on the array it would be evaluated for each of its elements
    x = w.groupBy("id").agg(F.collect_list("x").alias("x"), F.sum(F.col("x.w") * F.col("x.w")).alias("square"))
    vectors = cut(x.withColumn("norm", F.sqrt("square")).select("id", F.col("x.dim").alias("dims"), F.transform("x", lambda e: e["w"] / F.col("norm")).alias("ws")))
    ids = df.where(asked).select(F.col(key).alias("id")).distinct()
    queries = cut(vectors.join(ids, "id", "left_semi"))
    blocks = max(1, -(-queries.count() // block))
    kind = df.schema[key].dataType.simpleString()

    def search(rows: list) -> DataFrame:
        held = spark.sparkContext.broadcast(([r["id"] for r in rows], [np.array(r["dims"], dtype=np.int32) for r in rows], [np.array(r["ws"]) for r in rows]))

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, dims, ws = held.value
            q, best, least = _dense(dims, ws, dimensions), [], np.full(len(names), 1e-9)
            for batch in batches:
                for i in range(0, len(batch), CHUNK):
                    part = batch.iloc[i : i + CHUNK]
                    scores = np.round(q @ _dense(part["dims"], part["ws"], dimensions).T, 9)
                    if len(part) > k:  # the k-th of any part is a lower bound of the k-th of all
                        least = np.maximum(least, np.partition(scores, len(part) - k, axis=1)[:, len(part) - k])
                    a, b = np.nonzero(scores >= least[:, None])
                    best.append(pd.DataFrame({"query": a, "id": part["id"].to_numpy()[b], "score": scores[a, b]}))
            if best:
                out = pd.concat(best).sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)
                yield out.assign(query=[names[i] for i in out["query"]])

        return cut(vectors.select("id", "dims", "ws").mapInPandas(nearest, f"query {kind}, id {kind}, score double"))

    found = None
    for b in range(blocks):
        part = search(queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect())  # about `block` rows
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of two texts that lies in matching blocks, as difflib counts it; null for null."""
    def one(x: str | None, y: str | None) -> float | None:
        return None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Least ratio of the fuzzy band, and what parts the words of a label.
FUZZY_FLOOR = 0.6
WORD_BREAKS = r"[\s_\-./:#@]+"


def search_bands(df: DataFrame, key: str, label: str, query: str, k: int = 20) -> DataFrame:
    """(id, label, score) of the k best labels, ties by label and id: exact and prefix above word prefix above substring
    above fuzzy; a longer share of the label scores more inside its band. Null and blank labels, and a blank query,
    match nothing."""
    t, q = F.lower(F.trim(F.col(label))), query.lower().strip()
    size = F.length(t)
    r = F.least(F.lit(float(len(q))) / size, F.lit(1.0))
    word = F.exists(F.split(t, WORD_BREAKS), lambda w: w.startswith(q))
    score = F.when(t.startswith(q), 0.75 + 0.25 * r).when(word, 0.55 + 0.15 * r).when(F.instr(t, q) > 0, 0.35 + 0.10 * r)
    # no ratio is above that of the lengths: labels much shorter or longer are never compared
    likely = 2 * F.least(size, F.lit(len(q))) >= FUZZY_FLOOR * (size + len(q))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), t.alias("t"), score.alias("score"), likely.alias("likely")).where(F.lit(bool(q)) & (F.col("t") != "") & (F.col("score").isNotNull() | F.col("likely")))
    near = sequence_ratio(F.lit(q), F.when(F.col("score").isNull(), F.col("t")))
    rows = rows.withColumn("score", F.coalesce("score", F.when(near >= FUZZY_FLOOR, 0.30 * near)))
    return rows.where("score is not null").select("id", "label", "score").orderBy(F.desc("score"), "label", "id").limit(k)


def criticality(usage: DataFrame, degree: DataFrame, half_life: float = 50.0) -> DataFrame:
    """(uri, score) from usage (uri, seq) and degree (uri, degree, dependents): 0.40 usage + 0.25 degree + 0.20
    recency + 0.15 dependents, each relative to its largest value."""
    last = usage.agg(F.max("seq").alias("now"))
    u = usage.groupBy("uri").agg(F.count(F.lit(1)).alias("uses"), F.max("seq").alias("last"))
    both = degree.join(u, "uri", "full_outer").join(F.broadcast(last)).na.fill(0, ["uses", "degree", "dependents"])
    recency = F.coalesce(F.pow(F.lit(0.5), (F.col("now") - F.col("last")) / half_life), F.lit(0.0))
    top = both.agg(F.greatest(F.max("uses"), F.lit(1)).alias("mu"), F.greatest(F.max("degree"), F.lit(1)).alias("md"), F.greatest(F.max("dependents"), F.lit(1)).alias("mp"))
    s = both.withColumn("recency", recency).join(F.broadcast(top))
    return s.select("uri", (0.40 * F.col("uses") / F.col("mu") + 0.25 * F.col("degree") / F.col("md") + 0.20 * F.col("recency") + 0.15 * F.col("dependents") / F.col("mp")).alias("score"))
