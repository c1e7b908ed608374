"""Exact nearest nodes that skip: nodes stand in blocks around pivots, and a block whose nodes can't reach a query's n-th score isn't multiplied."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkrank.operators.search import NODE_BLOCK, QUERY_BLOCK, best_of, finite, merged, unit
from walkrank.scratch import Scratch

#: Pivots, and slices of the angles around each; a slice of more than NODE_BLOCK nodes is split further.
PIVOTS, SLICES = 64, 32
#: What rounding may add to an angle or a score.
_SLACK = 1e-7


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


@dataclass(frozen=True)
class Blocks:
    """table(block, pivot, low, high, n): the angles between a pivot and the block's nodes; pivots, one unit vector a row. A block of zero vectors has pivot -1.

    It goes to every task: its size follows from PIVOTS, SLICES and NODE_BLOCK,
    some 50 bytes for each 8,192 nodes.
    """

    table: pd.DataFrame
    pivots: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """For each query and block a score that no node of the block exceeds: angles between directions obey the triangle inequality. Zero vectors score 0 everywhere."""
        own, size = unit(vectors), np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        pivot, low, high = (self.table[c].to_numpy() for c in ("pivot", "low", "high"))
        angle = np.arccos(np.clip(own @ self.pivots.T, -1, 1)) if len(self.pivots) else np.zeros((len(own), 1))
        near = angle[:, np.maximum(pivot, 0)]
        out = np.cos(np.maximum(0, np.maximum(low - near, near - high) - _SLACK))
        out[:, pivot < 0] = 0
        out[size == 0] = 0
        return out + _SLACK


@dataclass(frozen=True)
class PivotIndex:
    """rows(node_id, vec, block), and the list of blocks."""

    rows: DataFrame
    blocks: Blocks

    def cells(self, queries: DataFrame, n: int, after: DataFrame | None = None) -> DataFrame:
        """(query_id, qvec, block): the blocks that may hold most, with n nodes together; or after those, with the scores that they gave, all others that may still matter."""
        sent, later = queries.sparkSession.sparkContext.broadcast(self.blocks), after is not None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks = sent.value
            ids, held = blocks.table.block.to_numpy(), blocks.table.n.to_numpy()
            for frame in frames:
                bounds = blocks.bounds(stacked(frame.qvec)) if len(frame) and len(ids) else np.zeros((0, len(ids)))
                for lo in range(len(bounds)):
                    order = np.argsort(-bounds[lo], kind="stable")
                    first = int(np.searchsorted(np.cumsum(held[order]), n)) + 1
                    chosen = order[:first]
                    if later:
                        rest = order[first:]
                        chosen = rest[bounds[lo][rest] >= frame.least.iloc[lo]]
                    if len(chosen):
                        yield pd.DataFrame({"query_id": frame.query_id.iloc[lo], "qvec": [frame.qvec.iloc[lo]] * len(chosen), "block": ids[chosen]})

        source = queries if after is None else queries.join(after, "query_id")
        return source.mapInPandas(run, "query_id bigint, qvec array<double>, block bigint")

    def _met(self, cells: DataFrame, n: int) -> DataFrame:
        """Queries against the nodes of their blocks, some thousands of queries at a time."""

        def cell(asked: pa.Table, known: pa.Table) -> pa.Table:
            return best_of(asked, known, n)

        part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
        parts = cells.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
        asked = cells.join(parts, "block").withColumn("part", part)
        used = asked.select(F.col("block").alias("to"), F.col("part").alias("piece")).distinct()
        known = self.rows.join(used, F.col("block") == F.col("to")).select("node_id", "vec", "to", "piece")
        return asked.groupBy("block", "part").cogroup(known.groupBy("to", "piece")).applyInArrow(cell, "query_id bigint, node_id bigint, score double")

    def top_n(self, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, rank, node_id, score) as ``search.top_n`` has them, equal scores by id; and (query_id, met, blocks): in how many of all blocks nodes were multiplied."""
        scratch = Scratch(queries.sparkSession, "pivots")
        dims = self.blocks.pivots.shape[1] if len(self.blocks.pivots) else None
        asked = scratch.save(finite(queries.select("query_id", "qvec"), "qvec", dims), "queries")
        near = scratch.save(self.cells(asked, n), "near")
        found = scratch.save(merged(self._met(near, n), n), "found")
        # of a query with fewer than n so far, every block matters
        least = found.groupBy("query_id").agg(F.count("*").alias("c"), F.min(F.round("score", 10)).alias("s"))
        least = asked.select("query_id").join(least, "query_id", "left").select("query_id", F.when(F.col("c") >= n, F.col("s")).otherwise(F.lit(float("-inf"))).alias("least"))
        far = scratch.save(self.cells(asked, n, scratch.save(least, "least")), "far")
        more = self._met(far, n).unionByName(found.select("query_id", "node_id", "score"))
        met = near.select("query_id").unionByName(far.select("query_id")).groupBy("query_id").agg(F.count("*").alias("met"))
        return merged(more, n), met.withColumn("blocks", F.lit(len(self.blocks.table)).cast("bigint"))


def build_index(nodes: DataFrame, pivots: int = PIVOTS, slices: int = SLICES, most: int = NODE_BLOCK) -> PivotIndex:
    """Each node goes to the pivot nearest to it, and within that to a slice of angles of at most ``most`` nodes on average.

    Pivots are the nodes first by a hash of their id. Nodes without a finite
    vector of the common length take no part; equal nodes may be split between
    blocks; without nodes there are no blocks.
    """
    scratch = Scratch(nodes.sparkSession, "pivot-index")
    rows = scratch.save(finite(nodes.select("node_id", "vec"), "vec"), "nodes")
    first = rows.orderBy(F.xxhash64("node_id"), "node_id").limit(pivots).toPandas()  # a stated number of vectors
    centres = unit(stacked(first.vec)) if len(first) else np.zeros((0, 0))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            vectors = stacked(frame.vec)
            near = np.clip(unit(vectors) @ centres.T, -1, 1)
            pivot = near.argmax(1)
            zero = ~vectors.any(1)
            yield pd.DataFrame({"node_id": frame.node_id, "vec": frame.vec, "pivot": np.where(zero, -1, pivot), "angle": np.where(zero, 0.0, np.arccos(near[np.arange(len(near)), pivot]))})

    rows = scratch.save(rows.mapInPandas(assign, "node_id bigint, vec array<double>, pivot bigint, angle double"), "assigned")
    rows = rows.withColumn("slice", F.floor(F.col("angle") / (np.pi / slices)))
    # a row a pivot and slice: neighbours share a block while they are small, large ones are split
    sizes = rows.groupBy("pivot", "slice").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("pivot").orderBy("slice")) - F.col("c")
    sizes = sizes.select("pivot", "slice", F.floor(upto / most).alias("group"), F.ceil(F.col("c") / most).alias("parts"))
    rows = rows.join(F.broadcast(sizes), ["pivot", "slice"])
    block = F.xxhash64("pivot", "group", F.when(F.col("parts") > 1, F.struct("slice", F.pmod(F.xxhash64("node_id"), F.col("parts")))))
    rows = scratch.save(rows.select("node_id", "vec", block.alias("block"), "pivot", "angle"), "blocks")
    blocks = rows.groupBy("block").agg(F.min("pivot").alias("pivot"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    return PivotIndex(rows.select("node_id", "vec", "block"), Blocks(blocks.toPandas().sort_values("block", ignore_index=True), centres))
