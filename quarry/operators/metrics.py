"""Quality metrics of retrieval and answers, drift, budgets and rates (extensions beyond parity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, totals: DataFrame, k: int = 8) -> DataFrame:
    """Per request recall, precision, reciprocal rank, ndcg and hit at k.

    ranked: request_id, chunk_id, rank. judged: chunk_id, gain (0: irrelevant). totals: request_id, n_relevant, ideal (its best gains, descending).
    """
    gain = F.coalesce("gain", F.lit(0))
    rows = ranked.where(F.col("rank") <= k).join(judged, "chunk_id", "left").select("request_id", "rank", gain.alias("gain"))
    weight = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1.0)
    found = rows.groupBy("request_id").agg(F.count_if(F.col("gain") > 0).alias("hits"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"), F.sum(weight).alias("dcg"))
    best = F.aggregate(F.transform(F.slice("ideal", 1, k), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    joined = totals.join(found, "request_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.select(
        "request_id",
        rate(F.col("hits"), F.col("n_relevant")).alias("recall"),
        (F.col("hits") / k).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        rate(F.coalesce("dcg", F.lit(0.0)), best).alias("ndcg"),
        (F.col("hits") > 0).cast("int").alias("hit"),
    )


def citation_quality(cited: Column, supporting: Column) -> Column:
    """precision and recall of cited ids against those that support the answer."""
    shared = F.size(F.array_intersect(cited, supporting))
    part = lambda n: F.when(n > 0, shared / n).otherwise(F.lit(0.0))
    return F.struct(part(F.size(cited)).alias("precision"), part(F.size(supporting)).alias("recall"))


def shares(rows: DataFrame, bucket: str) -> DataFrame:
    """(bucket, p, q): shares among rows of side 'p' and 'q'; a bucket's count is raised by one half where it is zero."""
    counts = rows.groupBy(bucket).agg(F.count_if(F.col("side") == "p").alias("np"), F.count_if(F.col("side") == "q").alias("nq"))
    total = rows.agg(F.count_if(F.col("side") == "p").alias("tp"), F.count_if(F.col("side") == "q").alias("tq"))
    some = lambda n, t: F.greatest(n.cast("double"), F.lit(0.5)) / t
    return counts.crossJoin(F.broadcast(total)).select(bucket, some(F.col("np"), F.col("tp")).alias("p"), some(F.col("nq"), F.col("tq")).alias("q"))  # total is one row


def drift(rows: DataFrame, bucket: str) -> DataFrame:
    """Population stability index and Jensen-Shannon divergence (natural logarithms) between side 'p' and side 'q'."""
    p, q = F.col("p"), F.col("q")
    middle = (p + q) / 2
    return shares(rows, bucket).agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.sum((p * F.log(p / middle) + q * F.log(q / middle)) / 2).alias("jsd"), F.count("*").alias("buckets"))


def earth_mover(rows: DataFrame, position: str, width: float) -> DataFrame:
    """Wasserstein distance of two histograms on a line: the summed gap of their running shares. The buckets are few."""
    line = Window.orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    gaps = shares(rows, position).select(F.abs(F.sum(F.col("p") - F.col("q")).over(line)).alias("gap"))
    return gaps.agg((F.sum("gap") * width).alias("distance"))


def within_budget(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their running size stays within the budget."""
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(running)).where(F.col("running") <= budget)


def recent(rows: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Each row with how many of its key came in the seconds up to it, and whether that is over the limit."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count("*").over(window)).withColumn("limited", F.col("recent") > limit)


def unknown_share(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Of rows (key, term) the share of terms that the vocabulary (term) does not have, by key."""
    known = vocabulary.select("term").distinct().withColumn("known", F.lit(True))
    return terms.join(known, "term", "left").groupBy(key).agg(F.count("*").alias("n_terms"), F.count_if(F.col("known").isNull()).alias("unknown")).withColumn("share", F.col("unknown") / F.col("n_terms"))
