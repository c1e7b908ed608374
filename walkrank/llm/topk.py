"""Exact top-k search by inner product: term-at-a-time accumulation over blocks of candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most candidates whose postings, and most queries whose vectors, are in one task at a time.
CANDIDATE_BLOCK, QUERY_BLOCK = 32_768, 2_048


def sparse_rows(frame: DataFrame, row_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, value array<bigint>): floor(scale * x) of each component; without rows whose id or vector is null, or that hold a null or non-finite component. Equal rows count once."""
    finite = F.forall(F.col("value"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    value = F.transform("value", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    return frame.select(F.col(row_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("value")).where(F.col("vec_id").isNotNull() & F.col("value").isNotNull()).where(finite).select("vec_id", value.alias("value")).distinct()


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The shortest integers that hold every sum of some terms of a score: none is above the product of the two lengths."""
    lengths = (math.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for rows in (queries, candidates))
    bound = math.prod(lengths) * (1 + 1e-9)
    longest = max(int(np.abs(rows).max(initial=0)) for rows in (queries, candidates))
    return next((kind for kind in (np.int16, np.int32) if max(bound, longest) < np.iinfo(kind).max), np.int64)


def _postings(candidates: np.ndarray, kind: type) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Of each term the rows that have it, and their weights."""
    out = []
    for term in range(candidates.shape[1]):
        rows = np.flatnonzero(candidates[:, term])
        # a term that many have needs no list of rows: adding zeros to the others costs less than scattering
        rows = slice(None) if 8 * len(rows) >= len(candidates) else rows
        out.append((rows, candidates[rows, term].astype(kind)))
    return out


def _accumulate(queries: np.ndarray, candidates: np.ndarray, k: int, q_ids: np.ndarray, c_ids: np.ndarray) -> Iterator[pd.DataFrame]:
    """The k best of a block for each query: its weighted postings are scattered into a dense array of scores, term by term."""
    kind = _kind(queries, candidates)
    postings = _postings(candidates, kind)
    rank = np.argsort(np.argsort(c_ids, kind="stable"), kind="stable")
    keep = min(len(candidates), k + 1)  # one more, as the query itself may be there
    scores, part = np.empty(len(candidates), kind), np.empty(len(candidates), kind)
    for q, vector in zip(q_ids, queries, strict=True):
        scores[:] = 0
        for term in np.flatnonzero(vector):
            rows, weights = postings[term]
            np.multiply(weights, kind(vector[term]), out=part[: len(weights)])
            if isinstance(rows, slice):
                scores += part
            else:
                scores[rows] += part[: len(weights)]
        least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        best = np.flatnonzero(scores >= least)
        best = best[c_ids[best] != q]
        best = best[np.lexsort((rank[best], -scores[best].astype(np.int64)))[:k]]
        yield pd.DataFrame({"query_id": q, "vec_id": c_ids[best], "score": scores[best].astype(np.int64)})


def top_k(frame: DataFrame, is_query: Column, k: int = 20, row_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of highest integer inner product for each query row, as query_id, rank from 1, vec_id, score; ties to the smaller id.

    Queries are the rows for which ``is_query`` holds over (vec_id), candidates
    all rows of another id. Blocks of queries meet blocks of candidates in a
    grid: each cell is a task of bounded memory that keeps k rows a query, and
    a ranking window merges the cells. Shorter vectors count as padded with
    zeros. Rows with nulls or non-finite components take no part; rows that
    are equal in id and vector count once. Scores must fit 64 bits. An empty
    table gives an empty result.
    """
    spark = frame.sparkSession
    rows = sparse_rows(frame, row_id, vector, scale)
    n = frame.count()
    cells = max(1, spark.sparkContext.defaultParallelism)
    c_blocks = max(-(-n // candidate_block), min(2 * cells, -(-n // 1024)), 1)
    q_blocks = max(1, -(-n // (20 * query_block)))
    spread = F.xxhash64("vec_id", "value")
    queries = rows.where(is_query).withColumn("qb", F.pmod(spread, F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    candidates = rows.withColumn("cb", F.pmod(spread, F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if q.empty or c.empty:
            return empty
        width = max(int(q.value.map(len).max()), int(c.value.map(len).max()))
        parts = _accumulate(_matrix(q.value, width), _matrix(c.value, width), k, q.vec_id.to_numpy(), c.vec_id.to_numpy())
        return pd.concat([empty, *parts], ignore_index=True)

    best = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb")).applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
