"""Retrieval metrics of results against ground truth, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIT_AT = RECALL_AT = (1, 5, 10, 20)
#: Ranks within which diverse hits are counted, whatever the other cut-offs.
DIVERSE = 20
METRICS = [*(f"hit_at_{k}" for k in HIT_AT), *(f"recall_at_{k}" for k in RECALL_AT), "mrr", "diversity_node_types", "diversity_count", "dr_at_20"]


def per_query(results: DataFrame, truth: DataFrame, queries: DataFrame, node_types: DataFrame | None = None, types_cutoff: int = 20) -> DataFrame:
    """One row a query with all METRICS and gt_count; zeros without results or truth.

    Ids are compared as text. Results without an id are left out before ranks
    count; truths count once. Types come from ``node_types`` (node_id,
    node_type); a missing one is 'unknown'.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    own = results.where("node_id IS NOT NULL").withColumn("r", F.row_number().over(order)).withColumn("id", F.col("node_id").cast("string"))
    if node_types is not None:
        own = own.join(node_types.select("node_id", "node_type"), "node_id", "left")
    elif "node_type" not in own.columns:
        own = own.withColumn("node_type", F.lit(None).cast("string"))
    right = truth.where("node_id IS NOT NULL").select("query_id", F.col("node_id").cast("string").alias("id")).distinct()
    counts = right.groupBy("query_id").agg(F.count("*").alias("gt_count"))
    # of each right id the best rank, so that counts are plain sums
    best = own.join(right, ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.min("r").alias("r"))
    found = best.groupBy("query_id").agg(*(F.count_if(F.col("r") <= k).alias(f"n_{k}") for k in sorted({*HIT_AT, *RECALL_AT, DIVERSE})), F.min("r").alias("first"))
    kinds = own.where(F.col("r") <= types_cutoff).select("query_id", F.coalesce("node_type", F.lit("unknown")).alias("kind")).distinct().groupBy("query_id").agg(F.count("*").alias("types"))
    rows = queries.select("query_id").join(found, "query_id", "left").join(kinds, "query_id", "left").join(counts, "query_id", "left")
    share = lambda n: F.coalesce(F.col(n) / F.col("gt_count"), F.lit(0.0))
    return rows.select(
        "query_id",
        *(F.when(F.col(f"n_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in HIT_AT),
        *(share(f"n_{k}").alias(f"recall_at_{k}") for k in RECALL_AT),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce("types", F.lit(0)).cast("bigint").alias("diversity_node_types"),
        F.coalesce(f"n_{DIVERSE}", F.lit(0)).cast("bigint").alias("diversity_count"),
        share(f"n_{DIVERSE}").alias("dr_at_20"),
        F.coalesce("gt_count", F.lit(0)).cast("bigint").alias("gt_count"),
    )


def long_form(metrics: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    return metrics.select(*keys, *(F.col(m).cast("double").alias(m) for m in names or METRICS)).unpivot(keys, names or METRICS, "metric", "value")


def summary(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(run, metric, mean, std): sample deviation, null for one query."""
    return long_form(metrics, ["run"], names).groupBy("run", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


def formatted(summarised: DataFrame) -> DataFrame:
    """(run, metric, value): mean ± std at 4 decimals, the mean alone without a std."""
    value = F.when(F.col("std").isNull(), F.format_string("%.4f", "mean")).otherwise(F.format_string("%.4f ± %.4f", "mean", "std"))
    return summarised.select("run", "metric", value.alias("value"))


def plotted(summarised: DataFrame, wanted: list[str], missing: float | None = None) -> DataFrame:
    """(place, metric, ..., value) of the wanted metrics in order, means at 4 decimals as reports write them. Metrics that aren't there have the value ``missing``, or without one no row."""
    asked = summarised.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, metric string")
    rows = asked.join(summarised.withColumnRenamed("mean", "value").drop("std"), "metric", "inner" if missing is None else "left")
    value = F.round("value", 4)
    return rows.withColumn("value", value if missing is None else F.coalesce(value, F.lit(missing)))
