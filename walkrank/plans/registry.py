"""Runs of retrieval, stored once: found by their settings and source files."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.params import Params
from walkrank.scratch import Folders, released
from walkrank.store import Store

_KIND = "runs"
_INFO = "run string, settings string, queries bigint, batch_seconds double"


def plain(params: Params) -> dict:
    """Settings that name a run; strategies that are functions have no name, and such runs aren't stored."""
    return {k: dict(v) if isinstance(v, Mapping) else v for k, v in asdict(params).items()}


class Registry:
    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store or Store(spark)

    def run(self, name: str, settings: Mapping, paths: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a run, one or more a query; made, timed as a batch and stored if there are none for these settings and files."""

        def write(folder: str) -> None:
            began = time.perf_counter()
            with Folders(self.spark), released(self.spark):
                make().write.parquet(f"{folder}/rows")
            took = time.perf_counter() - began
            n = self.spark.read.parquet(f"{folder}/rows").select("query_id").distinct().count()
            self.spark.createDataFrame([(name, json.dumps(settings, sort_keys=True), n, took)], _INFO).write.parquet(f"{folder}/info")

        return self.spark.read.parquet(f"{self.store.entry(_KIND, {'run': name, **settings}, paths, write)}/rows")

    def listed(self) -> DataFrame:
        """(run, settings, queries, batch_seconds, query_seconds) of all stored runs: a batch's time, and each query's share of it."""
        names = [f"{_KIND}/{n}" for n in self.store.names(_KIND)]
        found = [self.spark.read.parquet(f"{folder}/info") for folder in map(self.store.find, names) if folder]
        rows = reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], _INFO))
        return rows.withColumn("query_seconds", F.when(F.col("queries") > 0, F.col("batch_seconds") / F.col("queries")))
