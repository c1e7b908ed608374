"""Batch retrieval: one plan, whatever the number of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkrank.functions.rng import draw
from walkrank.operators import search, walk
from walkrank.params import Params, profile
from walkrank.sources.graph import Graph

Embedder = Callable[[DataFrame], DataFrame]


class Retriever:
    """Ranks the nodes that walkers of each query visit.

    ``mode`` "expected" counts mean votes exactly, "sampled" draws walks that
    repeat for equal settings. Use as a context manager to release what a run
    has cached.
    """

    def __init__(self, graph: Graph, params: Params | None = None, mode: str = "expected"):
        if mode not in ("expected", "sampled"):
            raise ValueError(f"no mode {mode!r}")
        self.graph, self.params, self.mode = graph, params or profile(), mode

    def __enter__(self) -> Retriever:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.graph.release()

    def retrieve(self, queries: DataFrame, errors: str = "skip", **changes) -> DataFrame:
        """(query_id, rank, node_id, votes, score) for queries(query_id, qvec), at most ``top_k`` a query; none for queries without a pool.

        Queries of faulty vectors have no rows and don't stop a batch (see
        ``rejected``); with ``errors`` "raise" the first fails it. Changed
        settings hold for this call; None keeps them.
        """
        params = self.params.but(**changes)
        queries = checked(queries.select("query_id", "qvec").dropDuplicates(["query_id"]), self.dims, errors)
        if self.mode == "expected":
            return walk.rank_visits(walk.expected_visits(queries, self.graph, params), queries, self.graph, params, "visit_weighted")
        votes = walk.count_votes(walk.sampled_visits(queries, self.graph, params))
        return walk.rank_visits(votes, queries, self.graph, params)

    def retrieve_texts(self, texts: DataFrame, embed: Embedder, **changes) -> DataFrame:
        """For texts(query_id, text): each different text is embedded once."""
        vectors = embed(texts.select("text").distinct())
        return self.retrieve(texts.join(vectors, "text").select("query_id", "qvec"), **changes)

    @cached_property
    def dims(self) -> int | None:
        return search.common_length(self.graph.nodes, "vec")

    def rejected(self, queries: DataFrame) -> DataFrame:
        """(query_id, reason) of the queries that ``retrieve`` goes on without."""
        return rejects(queries, self.dims)


def _reason(dims: int | None) -> Column:
    zero = F.forall("qvec", lambda x: x == 0)
    return F.coalesce(search.faulty("qvec", F.lit(dims)), F.when(zero, "zero"))


def rejects(queries: DataFrame, dims: int | None) -> DataFrame:
    """(query_id, reason) of queries(query_id, qvec) that can't be asked: null (no vector), length (not ``dims``; not tested if that is None), non-finite (a component that is null, NaN or infinite), or zero (no direction). The first that fits."""
    return queries.select("query_id", _reason(dims).alias("reason")).where("reason IS NOT NULL").distinct()


def checked(queries: DataFrame, dims: int | None, errors: str = "skip") -> DataFrame:
    """The queries without those that are rejected, or with ``errors`` "raise" a failure when the first of them is read."""
    if errors not in ("skip", "raise"):
        raise ValueError(f"no policy {errors!r}")
    reason = _reason(dims)
    if errors == "skip":
        return queries.where(reason.isNull())
    failure = F.raise_error(F.concat(F.lit("query "), F.col("query_id").cast("string"), F.lit(" is rejected: "), reason)).cast("array<double>")
    return queries.withColumn("qvec", F.when(reason.isNull(), F.col("qvec")).otherwise(failure))


def without_vectors(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Queries for which there is no vector."""
    return queries.join(vectors.where("qvec IS NOT NULL"), "query_id", "left_anti")


def lookup_embedder(vectors: DataFrame) -> Embedder:
    """Vectors by text from a table; a missing one fails the run when it is read."""

    def embed(texts: DataFrame) -> DataFrame:
        found = texts.join(vectors, "text", "left")
        missing = F.raise_error(F.concat(F.lit("no vector for: "), F.col("text"))).cast("array<double>")
        return found.withColumn("qvec", F.when(F.col("qvec").isNull(), missing).otherwise(F.col("qvec"))).select("text", "qvec")

    return embed


def hashing_embedder(dims: int = 64) -> Embedder:
    """Signed counts of hashed words at length 1, zeros without words: an offline stand-in for a remote model, in SQL functions."""

    def embed(texts: DataFrame) -> DataFrame:
        words = texts.select("text", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("w"))
        spot = F.pmod(draw(F.col("w")), F.lit(2 * dims))
        counts = words.groupBy("text", F.pmod(spot, F.lit(dims)).alias("i")).agg(F.sum(F.when(spot < dims, 1.0).otherwise(-1.0)).alias("c"))
        found = counts.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
        size = F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)
        vector = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("__size"))
        found = found.withColumn("__size", size).select("text", vector.alias("qvec"))
        return texts.select("text").distinct().join(found, "text", "left").withColumn("qvec", F.coalesce("qvec", F.array_repeat(F.lit(0.0), dims)))

    return embed
