"""Tables that cut lineage, written to the folder all executors share, in small pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from walkrank import scratch
from walkrank.scratch import Folders, bounded, shared_root

__all__ = ["Folders", "Scratch", "bounded", "shared_root", "small"]

#: Most bytes of a row group that a task holds before writing.
GROUP_BYTES = 16 << 20


def small(keys: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """A table of n keys, to be sent to every task if these are not too many; else joined as any table, whose large keys Spark splits."""
    return F.broadcast(keys) if n <= most else keys


class Scratch(scratch.Scratch):
    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        bounded(spark)

    def save(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        return super().save(frame, name, **{"parquet.block.size": str(GROUP_BYTES), **options})

    def measured(self, frame: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
        """``save``, with aggregates of the rows that are formed while they are written."""
        seen = Observation()
        return self.save(frame.observe(seen, *(v.alias(k) for k, v in values.items())), name), seen.get
