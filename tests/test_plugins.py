"""Stores outside Spark, embeddings kept across runs, and heuristics as callables over columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from walkrank.functions import heuristics as h
from walkrank.operators import walk
from walkrank.params import Params
from walkrank.plans.embeddings import CachedEmbedder
from walkrank.plans.registry import plain
from walkrank.plans.retriever import Retriever, hashing_embedder
from walkrank.sources import graph as g
from walkrank.sources import plugins
from walkrank.store import Store

N = 40


class Ring:
    """Both stores, made up: each node leads to the next two. Parts are ranges of ids; ``log`` is a file that tells what was asked for."""

    def __init__(self, n, log=None):
        self.n, self.log = n, log

    def _told(self, text):
        if self.log:
            with open(self.log, "a") as f:
                f.write(text + "\n")

    def node_parts(self):
        return [(lo, min(lo + 16, self.n)) for lo in range(0, self.n, 16)]

    def nodes(self, part, ids):
        self._told(f"nodes {part} {ids}")
        own = [i for i in range(*part) if ids is None or i in ids]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([[np.cos(i), np.sin(i)] for i in own], pa.list_(pa.float64())), pa.array(["t"] * len(own)), pa.array([0.5] * len(own), pa.float64())], names=["node_id", "vec", "node_type", "relevance"])

    edge_parts = node_parts

    def edges(self, part, sources):
        self._told(f"edges {part} {sources}")
        own = [(i, (i + k) % self.n) for i in range(*part) if sources is None or i in sources for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.int64())], names=["src", "dst"])


MAKER = f"{Ring.__module__}:Ring"


def ring(spark):
    nodes = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))], "t", 0.5) for i in range(N)], plugins.SCHEMAS["nodes"])
    return g.Graph.of(nodes, spark.createDataFrame([(i, (i + k) % N) for i in range(N) for k in (1, 2)], plugins.SCHEMAS["edges"]))


@pytest.mark.parametrize("mode", ["expected", "sampled"])
def test_a_walk_over_a_plug_in_is_that_over_tables(spark, mode):
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id bigint, qvec array<double>")
    params = Params(n_agents=6, steps=2, initial_pool_size=5, start_subset=4)
    rows = [sorted(tuple(r)[:3] + (round(r.votes, 9), round(r.score, 9)) for r in Retriever(graph, params, mode).retrieve(queries).collect()) for graph in (ring(spark), plugins.store_graph(spark, MAKER, n=N))]
    assert rows[0] == rows[1] and rows[0]


def test_parts_and_filters_reach_the_store(spark, tmp_path):
    assert isinstance(Ring(3), plugins.VectorStore) and isinstance(Ring(3), plugins.GraphStore)
    nodes = plugins.read_store(spark, MAKER, "nodes", n=N)
    assert nodes.rdd.getNumPartitions() == 3 and nodes.count() == N
    log = str(tmp_path / "log")
    assert sorted(map(tuple, plugins.neighbours(spark, MAKER, 7, n=N, log=log).collect())) == [(7, 8), (7, 9)]
    some = plugins.read_store(spark, MAKER, "nodes", n=N, log=log).where(F.col("node_id").isin(3, 20) & (F.col("relevance") > 0.1))
    assert sorted(r.node_id for r in some.collect()) == [3, 20]
    told = open(log).read().splitlines()
    assert all(line.endswith("{7}") for line in told if line.startswith("edges")) and all(line.endswith(("{3, 20}", "{20, 3}")) for line in told if line.startswith("nodes")) and len(told) == 6
    with pytest.raises(ValueError, match="no table"):
        plugins.read_store(spark, MAKER, "labels", n=N)


def test_datasets_by_name(spark):
    plugins.register_dataset("ring", lambda spark, n: plugins.store_graph(spark, MAKER, n=n))
    assert plugins.load_dataset(spark, "ring", n=5).edges.count() == 10
    with pytest.raises(ValueError, match="no dataset 'unknown': parquet, ring"):
        plugins.load_dataset(spark, "unknown")


def test_batched_heuristics_are_those_of_columns(spark):
    calls = Params(movement={h.Batched(lambda c: (c["cos"].to_numpy(zero_copy_only=False) + 1) / 2, ("cos",)): 0.5, h.Batched(lambda c: [1.0] * len(c["step"]), ("step",)): 0.25, "semantic": 0.1}, n_agents=5, steps=2, deposit={h.Batched(lambda c: pa.array([2.0] * len(c["dst"])), ("dst",)): 1.0}, pheromone="sync")
    columns = calls.but(movement={"semantic": 0.6, "flat": 0.25}, deposit={"flat": 2.0})
    queries = spark.createDataFrame([(0, [1.0, 0.2])], "query_id bigint, qvec array<double>")
    rows = [sorted(map(tuple, walk.sampled_visits(queries, ring(spark), p).collect())) for p in (calls, columns)]
    assert rows[0] == rows[1] and len(rows[0]) == 15
    frame = spark.createDataFrame([(0.5, 1), (None, 2)], "cos double, step int")
    both = frame.select(h.weighted({k: v for k, v in calls.movement.items()}).alias("w"))
    assert [r.w for r in both.collect()] == [pytest.approx(0.75 * 0.6 + 0.25), None]
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    with pytest.raises(TypeError):
        Store(spark).key("runs", plain(calls))  # a function has no name that a stored run could be found by


def test_texts_are_embedded_once_across_runs(spark, tmp_path):
    store, seen = Store(spark, f"file://{tmp_path}/store"), []

    def embed(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return hashing_embedder(8)(texts)

    def fails(texts):
        return texts.withColumn("qvec", F.raise_error(F.lit("lost")).cast("array<double>"))

    one = spark.createDataFrame([("a b",), ("c",), ("a b",), (None,), ("",)], "text string")
    two = spark.createDataFrame([("c",), ("d",)], "text string")
    want = {r.text: r.qvec for r in hashing_embedder(8)(one.union(two).where("text IS NOT NULL")).collect()}
    with pytest.raises(Exception, match="lost"):
        CachedEmbedder(spark, "m", fails, store)(one)
    assert CachedEmbedder(spark, "m", embed, store).known().count() == 0
    for texts in (one, two, one, two):
        cached = CachedEmbedder(spark, "m", embed, store)  # a run of its own
        got = {r.text: r.qvec for r in cached(texts).collect()}
        assert got == {t: want[t] for t in got} and set(got) == {r.text for r in texts.collect()} - {None}
    assert seen == [["", "a b", "c"], ["d"]]
    CachedEmbedder(spark, "other", embed, store)(two)
    assert seen[2:] == [["c", "d"]]
    cached.compact()
    assert len(cached._keys()) == 1 and cached.known().count() == 4 and {r.text: r.qvec for r in cached(one.union(two)).collect()} == want and len(seen) == 3
