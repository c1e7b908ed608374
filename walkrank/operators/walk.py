"""Walkers over the graph: expected visits, reproducible samples, and ranks of what was visited."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkrank.functions import heuristics as h
from walkrank.functions.rng import race
from walkrank.functions.vectors import cosine
from walkrank.operators import blocks
from walkrank.operators.search import all_pairs, similarity, sized, starts
from walkrank.params import Params
from walkrank.scratch import Scratch
from walkrank.sources.graph import Graph

#: Weights are compared as integers of this many parts of one, so that running sums are exact.
QUANTUM = 1_000_000


def node_weights(pairs: DataFrame, queries: DataFrame, graph: Graph, params: Params) -> DataFrame:
    """(query_id, node_id, w): the weight with which a walker of a query goes to a node, floored. Nodes without a vector can't be reached.

    The weight doesn't depend on where the walker stands, so it is formed once
    for each different pair.
    """
    traits = graph.traits().where("vec IS NOT NULL").select("node_id", "vec", "size", "degree", "avg_degree", "relevance")
    rows = pairs.join(traits, "node_id").join(sized(queries), "query_id")
    rows = rows.withColumn("cos", cosine("qvec", "vec", sizes=("qsize", "size"))).withColumn("pheromone", F.lit(0.0)).withColumn("max_pheromone", F.lit(1.0))
    return rows.select("query_id", "node_id", F.greatest(h.weighted(params.movement), F.lit(params.floor)).alias("w"))


def all_weights(queries: DataFrame, graph: Graph, params: Params) -> DataFrame:
    """The same of every query with every node that has a vector."""
    rows = all_pairs(queries, graph.traits().where("vec IS NOT NULL"), ["degree", "avg_degree", "relevance"])
    rows = rows.withColumn("pheromone", F.lit(0.0)).withColumn("max_pheromone", F.lit(1.0))
    return rows.select("query_id", "node_id", F.greatest(h.weighted(params.movement), F.lit(params.floor)).alias("w"))


def reached(at: DataFrame, graph: Graph) -> DataFrame:
    """(query_id, node_id), once each, to which the next hops may lead."""
    return graph.hops(at.select("query_id", "node_id")).select("query_id", F.col("dst").alias("node_id")).distinct()


def transitions(at: DataFrame, queries: DataFrame, graph: Graph, params: Params, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, src, dst, mass, p) for at(query_id, node_id, mass): the probabilities of each next hop; none from dead ends. ``weights`` has those of all nodes in reach, if they are known."""
    hops = graph.hops(at).select("query_id", F.col("node_id").alias("src"), "dst", "mass")
    weights = node_weights(reached(at, graph), queries, graph, params) if weights is None else weights
    rows = hops.join(weights.withColumnRenamed("node_id", "dst"), ["query_id", "dst"])
    # a hub's total is a partial sum, and a join that can be split: no task gets all of its edges
    total = rows.groupBy("query_id", "src").agg(F.sum("w").alias("total"))
    return rows.join(total, ["query_id", "src"]).select("query_id", "src", "dst", "mass", (F.col("w") / F.col("total")).alias("p"))


def expected_visits(queries: DataFrame, graph: Graph, params: Params, by: str | None = None) -> DataFrame:
    """(query_id, node_id, votes): the mean number of visits over all walks, exactly. Walkers in dead ends vote no more.

    Each step's frontier holds one row a query and node, whatever the number
    of walkers, and a pair is scored at the first step that reaches it. Where
    walks reach most of the graph, frontiers are vectors over blocks of nodes
    instead, and hops products of blocks; with many queries and nodes tasks
    walk for some queries each over all edges. Visits then have their cos, and
    those that can't be among the ``top_k`` by ``by`` may be left out.
    Heuristics with draws or live pheromones need samples.
    """
    if "jitter" in params.movement or params.pheromone != "off":
        raise ValueError("expected visits need weights without draws and pheromones")
    scratch = Scratch(queries.sparkSession, "expected")
    at = scratch.save(starts(queries, graph, params).select("query_id", "node_id", (F.col("share") * params.n_agents).alias("mass")), "0")
    if params.steps and params.floor > 0 and blocks.worth(graph, params.start_subset, params.steps):
        return _block_visits(at, queries, graph, params, scratch, by)
    visits, weights = at, None
    for step in range(params.steps):
        pairs = reached(at, graph)
        more = node_weights(pairs if weights is None else pairs.join(weights, ["query_id", "node_id"], "left_anti"), queries, graph, params)
        more = scratch.save(more, f"weights-{step}")
        weights = more if weights is None else weights.unionByName(more)
        moved = transitions(at, queries, graph, params, weights).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
        at = scratch.save(moved, str(step + 1))  # else each step's plan would hold those before it twice
        visits = visits.unionByName(at)
    return visits.groupBy("query_id", "node_id").agg(F.sum("mass").alias("votes"))


def _array_weight(params: Params):
    """A node's weight over arrays; the floor where ``missing`` says that there is no cos."""
    movement, floor = params.movement, params.floor

    def weight(columns: dict, missing: np.ndarray) -> np.ndarray:
        return np.where(missing, floor, np.maximum(h.weighted_arrays(movement, columns), floor))

    return weight


def _array_score(params: Params, by: str):
    """``rank_visits``'s score over arrays."""
    votes, rest = _split(params.ranking) if by == "visit_weighted" else (params.ranking, {})
    n = params.n_agents

    def score(columns: dict) -> np.ndarray:
        columns = columns | {"n_agents": float(n)}
        out = h.weighted_arrays(votes, columns)
        return out + h.weighted_arrays(rest, columns) * (1.0 - (1.0 - np.minimum(1.0, columns["votes"] / n)) ** n) if rest else out

    return score


def _split(ranking: dict) -> tuple[dict, dict]:
    """What falls with the votes, and the rest."""
    return {k: v for k, v in ranking.items() if k == "visited"}, {k: v for k, v in ranking.items() if k != "visited"}


def _block_visits(at: DataFrame, queries: DataFrame, graph: Graph, params: Params, scratch: Scratch, by: str | None = None) -> DataFrame:
    keep = ["degree", "avg_degree", "relevance"]
    nodes = graph.traits().where("vec IS NOT NULL").select("node_id", "vec", *keep)
    asked = queries.join(at.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "qvec")
    marked, n_queries = F.greatest(h.weighted(params.movement), F.lit(params.floor)), at.select("query_id").distinct().count()
    if blocks.streams(nodes.count(), n_queries):
        if h.over_arrays(params.movement) and "visited" not in params.movement:
            islands, n_nodes, n_edges = blocks.islands_of(nodes, graph, scratch)
            if blocks.holds(n_nodes, n_edges):
                few = blocks.few_by_score(params.top_k, _array_score(params, by)) if by and h.over_arrays(params.ranking) else blocks.few_by_votes(None)
                return blocks.island_visits(nodes, graph, at, params.steps, scratch, few, islands, asked, keep, _array_weight(params))
            scratch.drop("places")
        return blocks.streamed_weighted_visits(nodes, graph, at, asked, keep, marked, params.steps, scratch)
    dealt = blocks.Blocks(nodes, graph.edges.select("src", "dst"), scratch, n_queries)
    weights = dealt.weights(asked, nodes, keep, marked)
    return blocks.weighted_visits(dealt, dealt.masses(at), weights, params.steps)


def first_of_batches(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, votes, score): of each query in each Arrow batch the k that may be among its first k."""
    columns = ["query_id", "node_id", "votes", "score"]

    def run(batches):
        for batch in batches:
            query, node, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query_id", "node_id", "key"))
            key = np.where(np.isnan(key), -np.inf, key)
            order = np.lexsort((node, -key, query))
            begins = np.flatnonzero(np.diff(query[order], prepend=query[order[:1]] - 1))
            place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
            yield batch.take(pa.array(order[place < k])).select(columns)

    # NaN comes before all numbers there, null behind them
    key = F.when(F.isnan("score"), float("inf")).otherwise(F.round("score", 10))
    return rows.select(*columns, key.alias("key")).mapInArrow(run, rows.select(*columns).schema)


def rank_visits(visits: DataFrame, queries: DataFrame, graph: Graph, params: Params, by: str = "raw") -> DataFrame:
    """(query_id, rank, node_id, votes, score): the ``top_k`` by the ranking strategies; nodes without a vector score 0.

    ``visit_weighted`` is for expected votes: a part that doesn't fall with
    the votes counts as far as the node is visited at all, with
    1 - (1 - least(1, votes / n))^n for that chance (an upper bound).
    """
    scored = "cos" in visits.columns
    rows = (visits if scored else similarity(visits, queries, graph.nodes)).withColumn("n_agents", F.lit(params.n_agents))
    if by == "visit_weighted":
        votes, rest = _split(params.ranking)
        chance = 1.0 - F.pow(1.0 - F.least(F.lit(1.0), F.col("votes") / params.n_agents), F.lit(float(params.n_agents)))
        score = h.weighted(votes) + h.weighted(rest) * chance
    else:
        score = h.weighted(params.ranking)
    rows = rows.withColumn("score", F.when(F.col("cos").isNull(), 0.0).otherwise(score))
    if scored:  # a row for most nodes of each query: few of them are sent on
        rows = first_of_batches(rows.select("query_id", "node_id", "votes", "score"), params.top_k)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.top_k).select("query_id", "rank", "node_id", "votes", "score")


def pick(rows: DataFrame, key: list[str], order: str, weight: str, draws: tuple, value: str) -> DataFrame:
    """Of each key's rows one, with a chance in proportion to its weight: the first in a race of draws for ``draws`` and ``order``; null for keys without weights.

    The first of a race is that of the first of its parts, so tasks send one
    row a key, however many candidates a hub gives it.
    """
    arrival = race(F.col(weight), *draws, F.col(order))
    return rows.groupBy(*key).agg(F.min_by(value, F.when(arrival.isNotNull(), F.struct(arrival, order))).alias(value))


def quantised(weight: Column) -> Column:
    return F.round(weight * QUANTUM).cast("bigint")


def sampled_starts(zone: DataFrame, params: Params, uniform_zone: bool = False) -> DataFrame:
    """(query_id, agent_id, node_id): each walker's start, drawn with replacement."""
    agents = zone.select("query_id", "rank", "node_id", quantised(F.lit(1.0) if uniform_zone else F.col("weight")).alias("w")).withColumn("agent_id", F.explode(F.sequence(F.lit(0), F.lit(params.n_agents - 1))))
    return pick(agents, ["query_id", "agent_id"], "rank", "w", (F.col("query_id"), F.col("agent_id"), 0, "drop"), "node_id")


def sampled_visits(queries: DataFrame, graph: Graph, params: Params) -> DataFrame:
    """(query_id, agent_id, step, node_id) of every visit; a walker in a dead end stays and votes no more.

    With pheromone "sync", all walkers of a step see the levels that the step
    before left: a deposit on a node never marked lands on 1, others decay
    first. Draws are counters, so a lost partition repeats them. What a hop
    depends on but for the walker is formed once a query and node.
    """
    scratch = Scratch(queries.sparkSession, "sampled")
    at = scratch.save(sampled_starts(starts(queries, graph, params), params), "0")
    visits = at.withColumn("step", F.lit(0))
    level = None
    traits = graph.traits().where("vec IS NOT NULL").select(F.col("node_id").alias("dst"), "vec", "size", "degree", "avg_degree", "relevance")
    for step in range(1, params.steps + 1):
        hops = graph.hops(at, outer=True)
        pairs = hops.select("query_id", "dst").distinct().join(traits, "dst").join(sized(queries), "query_id")
        pairs = pairs.withColumn("cos", cosine("qvec", "vec", sizes=("qsize", "size"))).drop("vec", "qvec", "size", "qsize")
        if level is None:
            pairs = pairs.withColumn("pheromone", F.lit(0.0)).withColumn("max_pheromone", F.lit(1.0))
        else:
            top = level.groupBy("query_id").agg(F.max("pheromone").alias("max_pheromone"))
            pairs = pairs.join(level, ["query_id", "dst"], "left").join(top, "query_id", "left").withColumn("max_pheromone", F.coalesce("max_pheromone", F.lit(1.0)))
        hops = hops.join(pairs, ["query_id", "dst"], "left").withColumn("step", F.lit(step))
        hops = hops.withColumn("w", F.when(F.col("cos").isNotNull(), quantised(F.greatest(h.weighted(params.movement), F.lit(params.floor)))))
        hops = hops.withColumn("to", F.struct("dst", h.weighted(params.deposit).alias("deposit")))
        moved = scratch.save(pick(hops, ["query_id", "agent_id", "node_id"], "dst", "w", (F.col("query_id"), F.col("agent_id"), step, "hop"), "to"), str(step))
        visits = visits.unionByName(moved.where("to IS NOT NULL").select("query_id", "agent_id", F.col("to.dst").alias("node_id"), F.lit(step).alias("step")))
        if params.pheromone == "sync":
            left = moved.where("to.deposit > 0").groupBy("query_id", F.col("to.dst").alias("dst")).agg(F.sum("to.deposit").alias("added"))
            if level is None:
                level = left.select("query_id", "dst", (1.0 + F.col("added")).alias("pheromone"))
            else:
                level = level.join(left, ["query_id", "dst"], "full_outer").select("query_id", "dst", (F.when(F.col("pheromone").isNull(), 1.0).otherwise(F.col("pheromone") * params.decay) + F.coalesce("added", F.lit(0.0))).alias("pheromone"))
            level = scratch.save(level, f"level-{step}")
        at = moved.select("query_id", "agent_id", F.coalesce("to.dst", "node_id").alias("node_id"))
    return visits.select("query_id", "agent_id", "step", "node_id")


def count_votes(visits: DataFrame) -> DataFrame:
    """Visits of a node, starts and returns of the same walker included."""
    return visits.groupBy("query_id", "node_id").agg(F.count("*").cast("double").alias("votes"))
