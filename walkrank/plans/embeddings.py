"""Vectors of texts, kept across runs: each text is embedded once for a model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.plans.retriever import Embedder
from walkrank.store import Store

_ROWS = "hash bigint, text string, qvec array<double>"


class CachedEmbedder:
    """An embedder that asks another one only for texts that no run before has embedded with this model.

    What is missing is written as a partition of its own, seen once it is
    whole; a lost attempt leaves nothing, and the texts are embedded again.
    Two runs at a time may both embed a text: one of the vectors counts.
    """

    def __init__(self, spark: SparkSession, model: str, embed: Embedder, store: Store | None = None):
        self.spark, self.embed, self.store = spark, embed, store or Store(spark)
        self.kind = self.store.key("embeddings", {"model": model})

    def _keys(self) -> list[str]:
        return [f"{self.kind}/{n}" for n in self.store.names(self.kind)]

    def known(self) -> DataFrame:
        """(hash, text, qvec), one row a text."""
        folders = [f for f in map(self.store.find, self._keys()) if f]
        rows = self.spark.read.schema(_ROWS).parquet(*folders) if folders else self.spark.createDataFrame([], _ROWS)
        return rows if len(folders) < 2 else rows.groupBy("hash", "text").agg(F.min("qvec").alias("qvec"))

    def _new(self, rows: DataFrame) -> str:
        key = f"{self.kind}/{uuid.uuid4().hex[:12]}"
        self.store.put(key, lambda folder: rows.write.parquet(folder))
        return key

    def __call__(self, texts: DataFrame) -> DataFrame:
        """(text, qvec) of the different texts; null has no vector."""
        asked = texts.where("text IS NOT NULL").select(F.xxhash64("text").alias("hash"), "text").distinct()
        missing = asked.join(self.known().select("hash", "text"), ["hash", "text"], "left_anti")
        if not missing.isEmpty():
            self._new(self.embed(missing.select("text")).select(F.xxhash64("text").alias("hash"), "text", F.col("qvec").cast("array<double>").alias("qvec")))
        return asked.join(self.known(), ["hash", "text"]).select("text", "qvec")

    def compact(self) -> None:
        """All partitions as one."""
        before = self._keys()
        if len(before) > 1:
            key = self._new(self.known())
            self.store.tidy(self.kind, [key])
