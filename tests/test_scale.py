"""What holds at scale: sampled hops, hubs, skipped blocks, faulty batches, kept tables, stored runs and owned folders."""

import math
import threading
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.oracle import SF_DIR
from walkrank.functions import heuristics as h
from walkrank.functions.rng import uniform_py
from walkrank.operators import blocks, pivots, prototype, search, walk
from walkrank.params import Params
from walkrank.plans import catalogue
from walkrank.plans.registry import Registry, plain
from walkrank.plans.retriever import Retriever, checked, rejects
from walkrank.scratch import Folders, Scratch
from walkrank.sources import graph as g
from walkrank.sources import synthetic
from walkrank.store import FOLDER, Store, read_buckets, write_buckets


def names(spark, folder):
    from walkrank.scratch import file_system

    path, files = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def test_races_choose_in_proportion(spark):
    weights = {1: 1, 2: 2, 3: 3, 4: 0, 5: 4, 6: None}
    rows = spark.range(20_000).withColumnRenamed("id", "key").join(spark.createDataFrame(list(weights.items()), "dst bigint, w bigint"))
    picked = walk.pick(rows, ["key"], "dst", "w", (F.col("key"), "test"), "dst")
    got = Counter(r.dst for r in picked.collect())
    total = sum(w or 0 for w in weights.values())
    assert set(got) == {1, 2, 3, 5}
    chi = sum((got[k] - 20_000 * w / total) ** 2 / (20_000 * w / total) for k, w in weights.items() if w)
    assert chi < 16.3  # 3 degrees of freedom, one in a thousand
    one = min((-math.log((uniform_py(7, "test", k) * 2**32 + 0.5) / 2**32) / w, k) for k, w in weights.items() if w)[1]
    assert picked.where("key = 7").first().dst == one
    assert walk.pick(rows.where("dst IN (4, 6)"), ["key"], "dst", "w", (F.col("key"), "test"), "dst").where("dst IS NOT NULL").count() == 0
    plan = picked._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_a_hub_is_spread_over_tasks(spark):
    nodes = spark.range(-1, 200_000).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("vec"), F.lit("t").alias("node_type"), F.lit(0.5).alias("relevance"))
    edges = spark.range(200_000).select(F.lit(-1).cast("bigint").alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(0, -1), (1, 0)], "src bigint, dst bigint"))
    graph = g.Graph.of(nodes, edges)
    places = graph.edges.where("src = -1").groupBy("place").count().collect()
    assert len(places) == 200_000 // g.SLOT_EDGES and max(r["count"] for r in places) < 2 * g.SLOT_EDGES
    at = spark.createDataFrame([(0, -1), (0, 1), (1, 0), (1, 5)], "query_id bigint, node_id bigint")
    hops = graph.hops(at)
    assert hops.columns == ["query_id", "node_id", "dst"] and hops.where("node_id = -1").agg(F.count("*"), F.count_distinct("dst")).first() == (200_000, 200_000)
    assert sorted(map(tuple, hops.where("node_id >= 0").collect())) == [(0, 1, 0), (1, 0, -1)]
    assert [tuple(r) for r in graph.hops(at, outer=True).where("node_id = 5").collect()] == [(1, 5, None)]
    queries = spark.createDataFrame([(0, [1.0, 1.0])], "query_id bigint, qvec array<double>")
    visits = walk.sampled_visits(queries, graph, Params(n_agents=6, steps=2, initial_pool_size=5, start_subset=5))
    assert visits.where("step = 0").count() == 6


def clustered(spark, n, centres, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16))
    rows = [(i, (middle[i % centres] + 0.05 * rng.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n, [0.0] * 16), (n + 1, None), (n + 2, [float("nan")] * 16), (n + 3, [1.0]), (n + 4, [1.0] * 15 + [None]), (n + 5, [float("inf")] + [0.0] * 15)]
    rows += [(n + 10 + i, rows[i % 4][1]) for i in range(12)]  # ties
    return spark.createDataFrame(rows, "node_id bigint, vec array<double>")


def test_a_cell_holds_little_besides_its_vectors():
    rng = np.random.default_rng(1)
    asked, known = rng.normal(size=(search.QUERY_BLOCK, 8)), rng.normal(size=(search.NODE_BLOCK, 8))
    q = pa.table({"query_id": np.arange(len(asked)), "qvec": list(asked)})
    r = pa.table({"node_id": np.arange(len(known))[::-1], "vec": list(known)})
    tracemalloc.start()
    got = search.best_of(q, r, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # of whole scores it would be 134 MB
    scores = search.unit(asked[:50]) @ search.unit(known).T
    want = [(i, len(known) - 1 - j) for i, row in enumerate(scores) for j in np.argsort(-row)[:5]]
    assert list(zip(got["query_id"].to_pylist(), got["node_id"].to_pylist()))[:250] == want


@pytest.mark.parametrize("n", [1, 7, 40])
def test_skipping_blocks_loses_nothing(spark, n):
    nodes = clustered(spark, 1200, 30)
    queries = nodes.where("node_id % 100 = 0 OR node_id > 1200").select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    index = pivots.build_index(nodes, pivots=40, slices=16, most=50)
    got, met = index.top_n(queries, n)
    want = search.top_n(queries, nodes, n)
    key = lambda r: (r.query_id, r["rank"], r.node_id, round(r.score, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    # zero queries score 0 with all and skip nothing; on clusters others skip most
    seen = met.where("query_id <> 1200").agg(F.sum("met").alias("m"), F.sum("blocks").alias("b")).first()
    assert seen.m < 0.5 * seen.b
    assert index.top_n(queries.where("false"), n)[0].count() == 0 and pivots.build_index(nodes.where("false")).top_n(queries, n)[0].count() == 0


def test_vectors_that_are_not_whole_hide_no_others(spark):
    good = [(i, [float(i), 1.0]) for i in range(40)]
    for m in (1, 3, 12, 40):
        bad = [(100 + i, [float("nan"), 1.0]) for i in range(m)] + [(300, [float("inf"), 0.0]), (301, [1.0]), (302, [None, 1.0]), (303, None), (304, [])]
        nodes = spark.createDataFrame(good + bad, "node_id bigint, vec array<double>")
        queries = spark.createDataFrame([(0, [0.0, 1.0]), (1, [float("nan"), 1.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "query_id bigint, qvec array<double>")
        assert [(r.query_id, r.node_id) for r in search.top_n(queries, nodes, 5).orderBy("query_id", "rank").collect()] == [(0, i) for i in range(5)]


def test_errors_of_a_batch(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [1.0, float("nan")]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [float("-inf"), 0.0]), (7, [0.5, 0.5]), (1, None)]
    batch = spark.createDataFrame(rows, "query_id bigint, qvec array<double>")
    assert sorted(map(tuple, rejects(batch, 2).collect())) == [(1, "null"), (2, "length"), (3, "non-finite"), (4, "non-finite"), (5, "zero"), (6, "non-finite")]
    nodes = spark.createDataFrame([(i, [1.0, i / 4], "t", 0.5) for i in range(6)], "node_id bigint, vec array<double>, node_type string, relevance double")
    graph = g.Graph.of(nodes, spark.createDataFrame([(i, (i + k) % 6) for i in range(6) for k in (1, 2)], "src bigint, dst bigint"))
    params = Params(n_agents=4, steps=2, initial_pool_size=4, start_subset=3)
    for mode in ("expected", "sampled"):
        retriever = Retriever(graph, params, mode)
        alone = sorted(map(tuple, retriever.retrieve(batch.where("query_id IN (0, 7)")).collect()))
        assert alone and sorted(map(tuple, retriever.retrieve(batch).collect())) == alone
        assert retriever.rejected(batch).count() == 6
        with pytest.raises(Exception, match="is rejected: "):
            retriever.retrieve(batch, errors="raise").collect()
        assert sorted(map(tuple, retriever.retrieve(batch.where("query_id IN (0, 7)"), errors="raise").collect())) == alone
    with pytest.raises(ValueError, match="no policy"):
        checked(batch, 2, "hide")


def test_entries_are_whole_or_unseen(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.range(3).write.parquet(source)
    store = Store(spark, f"file://{tmp_path}/store")
    made = []

    def write(folder):
        made.append(folder)
        spark.read.parquet(source).write.parquet(folder)

    first = store.entry("t", {"a": 1}, [source], write)
    assert store.entry("t", {"a": 1}, [source], write) == first and len(made) == 1
    assert store.entry("t", {"a": 2}, [source], write) != first and len(made) == 2
    spark.range(9).write.mode("overwrite").parquet(source)  # another file: another key
    assert spark.read.parquet(store.entry("t", {"a": 1}, [source], write)).count() == 9 and len(made) == 3

    def fails(folder):
        spark.range(1).write.parquet(f"{folder}/half")
        raise OSError("lost")

    key = store.key("t", {"a": 3})
    with pytest.raises(OSError):
        store.put(key, fails)
    assert store.find(key) is None and store.entry("t", {"a": 3}, [], write) and store.find(key)
    two = {store.put(store.key("t", {"a": 4}), write) for _ in range(2)}
    assert len(two) <= 2 and store.find(store.key("t", {"a": 4})) in two
    assert store.tidy("t", [store.key("t", {"a": 4})]) == 4 and store.find(store.key("t", {"a": 4})) in two and store.find(key) is None
    with pytest.raises(TypeError):
        store.key("t", {"a": len})


def test_buckets_do_not_move(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") * 2).write.parquet(f"file://{tmp_path}/plain")
    write_buckets(spark.read.parquet(f"file://{tmp_path}/plain"), f"file://{tmp_path}/kept", "rows", 6, "id")
    kept = read_buckets(spark, f"file://{tmp_path}/kept", "rows", "id")
    assert kept.agg(F.sum("v")).first()[0] == 999_000 and read_buckets(spark, f"file://{tmp_path}/kept", "rows", "id").count() == 1000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.range(50).join(kept, "id")._jdf.queryExecution().executedPlan().toString()
        graph = g.load_graph(spark, SF_DIR)
        hop = graph.hops(spark.range(50).select(F.col("id").alias("node_id")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for text in (plan, hop):  # the other side alone is dealt out
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text


def test_runs_are_stored_once(spark, tmp_path):
    registry, made = Registry(spark, Store(spark, f"file://{tmp_path}/store")), []

    def make():
        made.append(1)
        return Scratch(spark, "made").save(spark.createDataFrame([(0, 0.5), (1, 0.25)], "query_id bigint, mrr double"), "rows")

    for _ in range(3):
        assert registry.run("a", plain(Params()), [], make).count() == 2
    registry.run("a", plain(Params(steps=2)), [], make)
    registry.run("b", plain(Params()), [], make)
    assert len(made) == 3
    listed = registry.listed().collect()
    assert sorted(r.run for r in listed) == ["a", "a", "b"] and all(r.queries == 2 and r.query_seconds == r.batch_seconds / 2 > 0 for r in listed)


def test_queries_share_runs_and_cache_nothing(spark):
    catalogue.queries()["metrics_per_query"](spark, SF_DIR).count()
    catalogue.queries()["ab_summary"](spark, SF_DIR).count()
    before = Registry(spark).listed().count()
    for name in ("ab_ttest", "ab_pivot", "metrics_summary", "ab_quartiles"):
        catalogue.queries()[name](spark, SF_DIR).count()
    assert Registry(spark).listed().count() == before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_owners_remove_their_own_folders_alone(spark, tmp_path):
    seen, meet = {}, threading.Barrier(2, timeout=60)

    def work(name, first):
        with Folders(spark):
            if not first:
                meet.wait()  # the other has begun and ends before this one reads
            kept = Scratch(spark, name).save(spark.range(10), "t")
            if first:
                meet.wait()
            with Folders(spark):
                inner = Scratch(spark, name)
                assert inner.save(spark.range(3), "u").count() == 3
            seen[name, "inner"] = names(spark, inner.path)
            if not first:
                done.wait(60)
            seen[name] = kept.count()
        if first:
            done.set()

    done = threading.Event()
    threads = [threading.Thread(target=work, args=a) for a in (("one", True), ("two", False))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"one": 10, "two": 10, ("one", "inner"): [], ("two", "inner"): []}
    own = Scratch(spark, "free")
    with Folders(spark):
        pass
    assert own.save(spark.range(2), "t").count() == 2


def test_all_pairs_lose_none(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIR_BLOCK", 3)
    vectors = [[float(i % 5), 1.0, -float(i)] for i in range(17)] + [None, [1.0], [None, 1.0, 2.0], [0.0, 0.0, 0.0]]
    nodes = spark.createDataFrame([(i, v, i * 10) for i, v in enumerate(vectors)], "node_id bigint, vec array<double>, degree int")
    queries = nodes.where("node_id % 2 = 0").select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    got = {(r.query_id, r.node_id): (r.degree, r.cos) for r in search.all_pairs(queries, nodes, ["degree"]).collect()}
    assert set(got) == {(q, n) for q in range(0, 21, 2) for n in range(21)}
    for (q, n), (degree, cos) in got.items():
        a, b = vectors[q], vectors[n]
        whole = a and b and len(a) == len(b) and None not in a + b
        assert degree == n * 10 and (cos is not None) == bool(whole)
        assert not whole or abs(cos - sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b) + 1e-8)) < 1e-12


@pytest.mark.parametrize("name", ["h_semantic", "h_dataset_centrality", "dep_collab", "movement_scores"])
def test_heuristics_are_asked_about_all_pairs(spark, name):
    pairs = g.load_queries(spark, SF_DIR).count() * g.load_nodes(spark, SF_DIR).count()
    assert catalogue.queries()[name](spark, SF_DIR).count() == pairs


@pytest.mark.parametrize("size", [20, 60_000])
def test_products_of_blocks_are_the_walks_of_rows(spark, monkeypatch, size):
    rng = np.random.default_rng(size)
    nodes = spark.createDataFrame([(i, rng.normal(size=4).tolist() if i % 19 else None, "t", (i % 5 + 1) / 5) for i in range(60)], "node_id bigint, vec array<double>, node_type string, relevance double")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a != b and a % 13}  # some have no way on
    graph = g.Graph.of(nodes, spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"))
    queries = nodes.where("node_id % 4 = 0").select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    params = Params(steps=3, initial_pool_size=9, start_subset=4)
    monkeypatch.setattr(blocks, "NODES", size)
    monkeypatch.setattr(blocks, "CELL_EDGES", 40 if size == 20 else 1 << 22)
    monkeypatch.setattr(blocks, "EDGES", 20 if size == 20 else 1 << 20)
    found = {}
    for way in (True, False):
        monkeypatch.setattr(blocks, "worth", lambda *_, way=way: way)
        for visits in (walk.expected_visits(queries, graph, params), prototype.relevance_visits(queries, graph, params)):
            found.setdefault(way, []).append({(r.query_id, r.node_id): r.votes for r in visits.collect()})
        found[way].append({(r.query_id, r["rank"]): r.node_id for r in walk.rank_visits(walk.expected_visits(queries, graph, params), queries, graph, params, "visit_weighted").collect()})
    for got, want in zip(found[True], found[False], strict=True):
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("small", [True, False])
def test_walks_by_relevance_shuffle_no_vectors(spark, monkeypatch, small):
    rng = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "t", (i % 5 + 1) / 5) for i in range(60)], "node_id bigint, vec array<double>, node_type string, relevance double")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2)) if a != b and a % 13} | {(i, 7) for i in range(60) if i != 7 and i % 13}
    graph = g.Graph.of(nodes, spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"))
    queries = nodes.where("node_id % 4 = 0").select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    params = Params(steps=3, initial_pool_size=9, start_subset=4)
    if small:  # many rows, a node with several, and a query a task
        for name, value in {"NODES": 20, "ROW_EDGES": 16, "VECTORS": 16 * 60, "LONG": 5, "PIECE": 3}.items():
            monkeypatch.setattr(blocks, name, value)
    found = {}
    for way in (True, False):
        monkeypatch.setattr(blocks, "worth", lambda *_, way=way: way)
        found[way] = prototype.relevance_visits(queries, graph, params)
    assert "CartesianProduct" in found[True]._jdf.queryExecution().toString()
    got, want = ({(r.query_id, r.node_id): r.votes for r in found[way].collect()} for way in (True, False))
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(blocks, "worth", lambda *_: True)
    few = prototype.relevance_visits(queries, graph, params, most=6)
    assert few.count() < len(want)
    ranks = [{(r.query_id, r["rank"]): r.node_id for r in prototype.rank_by_votes(rows, 6).collect()} for rows in (few, found[False])]
    assert ranks[0] == ranks[1]
    monkeypatch.setattr(blocks, "fits", lambda *_: False)  # of graphs too large for a task, hops are products of blocks
    large = {(r.query_id, r.node_id): r.votes for r in prototype.relevance_visits(queries, graph, params).collect()}
    assert large.keys() == want.keys() and all(abs(large[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("small", [True, False])
def test_walks_by_weights_of_queries_shuffle_no_vectors(spark, monkeypatch, small):
    rng = np.random.default_rng(6)
    vector = {0: None, 1: [1.0, 2.0], 2: [0.0] * 4}  # none, of another length, without direction
    nodes = spark.createDataFrame([(i, vector[i % 19] if i % 19 < 3 else rng.normal(size=4).tolist(), "t", (i % 5 + 1) / 5 if i % 7 else None) for i in range(60)], "node_id bigint, vec array<double>, node_type string, relevance double")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2)) if a != b and a % 13} | {(i, 7) for i in range(60) if i != 7 and i % 13}
    graph = g.Graph.of(nodes, spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"))
    queries = nodes.where("node_id % 4 = 0 AND vec IS NOT NULL").select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    near = h.Batched(lambda columns: (columns["cos"].to_numpy(zero_copy_only=False) + 1) / 2, ("cos",))
    params = Params(steps=3, initial_pool_size=9, start_subset=4, movement={near: 0.3, "centrality": 0.4, "relevance": 0.3})
    if small:  # many rows, a node with several, and a query a task
        for name, value in {"ROW_NODES": 20, "ROW_EDGES": 16, "VECTORS": blocks.PER_NODE * 60, "LONG": 5, "PIECE": 3}.items():
            monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(blocks, "FEW", 0)
    found, kept, save = {}, [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, frame, name, **options: (kept.append(name), save(self, frame, name, **options))[1])
    for way in (True, False):
        monkeypatch.setattr(blocks, "worth", lambda *_, way=way: way)
        visits = walk.expected_visits(queries, graph, params)
        found[way] = {(r.query_id, r.node_id): r.votes for r in visits.collect()}, {(r.query_id, r["rank"]): (r.node_id, round(r.score, 9)) for r in walk.rank_visits(visits, queries, graph, params, "visit_weighted").collect()}
        assert not way or kept == ["0", "places", "rows", "starts"]
    got, want = found[True][0], found[False][0]
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert found[True][1] == found[False][1]


def test_first_of_batches_hold_the_first_ranks(spark):
    rows = [(q, n, 1.0, [0.5, None, float("nan"), n / 9][n % 4]) for q in (1, 2, -(2**63)) for n in range(40)]
    frame = spark.createDataFrame(rows, "query_id bigint, node_id bigint, votes double, score double").repartition(3)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "node_id")
    first = lambda rows: {(r.query_id, r.node_id) for r in rows.withColumn("rank", F.row_number().over(order)).where("rank <= 12").collect()}
    few = walk.first_of_batches(frame, 12)
    assert few.count() < len(rows) and first(few) == first(frame)
    assert walk.first_of_batches(frame.where("false"), 12).count() == 0


def test_walks_over_most_of_a_graph_make_no_row_for_an_edge_and_query(spark):
    queries, graph = g.load_queries(spark, SF_DIR), g.load_graph(spark, SF_DIR)
    assert blocks.worth(graph, 10, 4) and not blocks.worth(graph, 1, 0)
    plan = walk.expected_visits(queries, graph, Params())._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("rows", [3, 250_000])
def test_places_of_documents_in_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(synthetic, "TASK_ROWS", rows)
    docs = spark.createDataFrame([(7 * i % 101 * (1 + i % 3), f"t{i % 4}") for i in range(1, 40)], "doc bigint, topic string").dropDuplicates(["doc"])
    by_topic = {}
    for r in docs.orderBy("doc").collect():
        by_topic.setdefault(r.topic, []).append(r.doc)
    assert {(r.topic, r.place): r.doc for r in synthetic.places(docs, 39).collect()} == {(t, i): x for t, own in by_topic.items() for i, x in enumerate(own)}
    assert synthetic.places(docs.where("false"), 0).count() == 0
    plan = synthetic.typed_edges(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_ablations_walk_for_their_own_queries_alone(spark, monkeypatch):
    asked = []
    for name in ("async_votes", "relevance_visits", "flow_visits"):
        def seen(queries, *more, own=getattr(prototype, name)):
            asked.append(queries.count())
            return own(queries, *more)

        monkeypatch.setattr(prototype, name, seen)
    monkeypatch.setattr(catalogue, "ABLATION_QUERIES", 2)  # so that no stored run answers
    assert catalogue.queries()["ablation_summary"](spark, SF_DIR).count() == 4
    assert asked == [2, 2, 2, 2]


def test_disk_holds_no_shuffle_files_of_what_is_done(spark, tmp_path, monkeypatch):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in map(found.apply, range(found.size())) if f.getName().startswith("shuffle_")}

    monkeypatch.setattr(blocks, "FEW", 0)
    begun, own, before = [], Scratch.__init__, files()
    monkeypatch.setattr(Scratch, "__init__", lambda self, *args: (own(self, *args), begun.append(self.path))[0])
    spark.conf.set(FOLDER, f"file://{tmp_path}")  # so that no kept graph answers
    try:
        queries, graph = g.load_queries(spark, SF_DIR), g.load_graph(spark, SF_DIR)
        assert sum(n for name, n in files().items() if name not in before) < 1000  # of counts, which are one row
        plan = walk.expected_visits(queries, graph, Params())._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and names(spark, begun[-1]) == ["0", "rows", "starts"]
    finally:
        spark.conf.unset(FOLDER)


@pytest.mark.parametrize(("small", "both"), [(True, False), (False, True)])
def test_tasks_that_hold_the_edges_of_an_island_walk_as_rows_do(spark, monkeypatch, small, both):
    rng = np.random.default_rng(7)
    vector = {0: None, 1: [1.0, 2.0], 2: [0.0] * 4}  # none, of another length, without direction
    nodes = spark.createDataFrame([(3 * i, vector[i % 19] if i % 19 < 3 else rng.normal(size=4).tolist(), "t", (i % 5 + 1) / 5) for i in range(80)], "node_id bigint, vec array<double>, node_type string, relevance double")
    one_way = {(3 * int(a), 3 * int(b)) for a, b in rng.integers(0, 60, (200, 2)) if a != b and a % 13 and a // 30 == b // 30} | {(3 * i, 21) for i in range(30) if i != 7 and i % 13}  # two islands, and nodes without edges
    queries = nodes.where("node_id % 4 = 0 AND vec IS NOT NULL").select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))
    params = Params(steps=3, initial_pool_size=9, start_subset=4, top_k=6, movement={"semantic": 0.3, "centrality": 0.4, "relevance": 0.2, "repulsion": 0.1})
    if small:  # many rows, a node with several, and few queries a task
        for name, value in {"ROW_NODES": 20, "ROW_EDGES": 16, "SOURCES": 16, "CELLS": 8, "ISLAND": 16, "LONG": 5, "PIECE": 3}.items():
            monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(blocks, "FEW", 0)
    for name in ("streamed_weighted_visits", "streamed_visits"):
        monkeypatch.setattr(blocks, name, None)
    kept, own = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, frame, name, **options: (kept.append((name, own(self, frame, name, **options))), kept[-1][1])[1])
    pairs = one_way | ({(b, a) for a, b in one_way} if both else set())
    graph = g.Graph.of(nodes, spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"))
    found = {}
    for way in (True, False):
        monkeypatch.setattr(blocks, "worth", lambda *_, way=way: way)
        visits = walk.expected_visits(queries, graph, params)
        found[way] = [{(r.query_id, r.node_id): r.votes for r in visits.collect()}]
        if way:  # edges against their direction are those along it where each has its reverse
            rows = [frame for name, frame in kept if name == "rows"][-1].select("island", "kind").collect()
            assert {r["kind"] for r in rows} == ({0, 1} if both else {0, 1, 2})
            assert len({r["island"] for r in rows}) > 2 if small else len({r["island"] for r in rows}) == 1
            visits = walk.expected_visits(queries, graph, params, "visit_weighted")
            assert visits.count() < len(found[way][0])
        found[way].append({(r.query_id, r.node_id): r.votes for r in prototype.relevance_visits(queries, graph, params).collect()})
        found[way].append({(r.query_id, r["rank"]): (r.node_id, round(r.score, 9)) for r in walk.rank_visits(visits, queries, graph, params, "visit_weighted").collect()})
    for got, want in zip(found[True][:2], found[False][:2], strict=True):
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert found[True][2] == found[False][2]
