"""Pheromone levels from a stream of visits: an extension of the batch walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_deposits(visits: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, node_id, deposit) for a stream or table of visits(ts, node_id, deposit); rows later than ``late`` are left out of a stream."""
    if visits.isStreaming:
        visits = visits.withWatermark("ts", late)
    sums = visits.where("deposit > 0").groupBy(F.window("ts", window), "node_id").agg(F.sum("deposit").alias("deposit"))
    return sums.select(F.col("window.start").alias("window_start"), "node_id", "deposit")


def levels(deposits: DataFrame, decay: float = 0.5, window: str = "1 hour") -> DataFrame:
    """(node_id, pheromone): each window's deposits, decayed once for every window of that length up to the last of all."""
    last = F.broadcast(deposits.agg(F.max("window_start").alias("last")))  # one row
    length = F.unix_micros(F.to_timestamp(F.lit("1970-01-01 00:00:00")) + F.expr(f"INTERVAL {window}")) - F.unix_micros(F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    age = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("window_start").cast("timestamp"))) / length
    return deposits.join(last).withColumn("age", age).groupBy("node_id").agg(F.sum(F.col("deposit") * F.pow(F.lit(decay), "age")).alias("pheromone"))
