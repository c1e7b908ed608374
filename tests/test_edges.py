"""Edge cases of graph retrieval against plain Python: dead ends, missing vectors, small pools, live pheromones, known p-values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from walkrank.functions.rng import uniform_py
from walkrank.functions.vectors import cosine
from walkrank.operators import analysis, metrics, prototype, search, walk
from walkrank.params import PROFILES, Params, profile
from walkrank.plans.retriever import Retriever, hashing_embedder, lookup_embedder, without_vectors
from walkrank.sources import graph as g
from walkrank.streaming import pheromones

#: 0-1-2-3 in a ring, 4 a dead end behind 0, 5 an edge to a node without a vector, 9 not in the graph.
VECTORS = {0: [1.0, 0.0], 1: [0.8, 0.6], 2: [0.0, 1.0], 3: [-1.0, 0.0], 4: [0.6, 0.8], 5: [0.5, 0.5], 6: None, 9: [1.0, 0.1]}
RELEVANCE = {0: 0.2, 1: 0.9, 2: None, 3: 0.5, 4: 0.7, 5: 0.4, 6: 0.8, 9: 1.0}
EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (5, 6), (1, 5)]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(i, v, f"t{i % 2}", RELEVANCE[i]) for i, v in VECTORS.items()], "node_id bigint, vec array<double>, node_type string, relevance double")
    return g.Graph.of(nodes, spark.createDataFrame(EDGES, "src bigint, dst bigint"))


def asked(spark, *vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "query_id bigint, qvec array<double>")


def cos(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_top_n_is_brute_force(spark, small):
    queries = asked(spark, [1.0, 0.0], [0.0, -1.0], None, [0.0, 0.0])
    got = {}
    for r in search.top_n(queries, small.nodes, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.node_id, round(r.score, 9)))
    for i, q in ((0, [1.0, 0.0]), (1, [0.0, -1.0]), (3, None)):
        scores = sorted((-round(cos(q, v), 10) if q else 0.0, n) for n, v in VECTORS.items() if v)[:3]
        assert sorted(got[i]) == [(k + 1, n, round(-s, 9) + 0.0) for k, (s, n) in enumerate(scores)]
    assert 2 not in got and search.top_n(queries.where("false"), small.nodes, 3).count() == 0


def test_pools_that_are_empty_or_small(spark, small):
    params = Params(initial_pool_size=1, start_subset=10, steps=2, n_agents=4)
    outside = asked(spark, [1.0, 0.1])  # its nearest node isn't in the graph
    assert Retriever(small, params).retrieve(outside).count() == 0
    assert Retriever(small, params, "sampled").retrieve(outside).count() == 0
    zone = search.starts(asked(spark, [1.0, 0.0]), small, params.but(initial_pool_size=3)).orderBy("rank").collect()
    assert [(r.node_id, round(r.weight, 6)) for r in zone] == [(0, 1.45), (1, 1.4)] and abs(sum(r.share for r in zone) - 1) < 1e-12


def test_walkers_in_dead_ends_stay_and_vote_no_more(spark, small):
    params = Params(n_agents=8, steps=3, initial_pool_size=2, start_subset=1)
    visits = walk.sampled_visits(asked(spark, [0.6, 0.8]), small, params).collect()  # 4 has no edges of its own, so all start in 5, whose only neighbour has no vector
    assert {(r.node_id, r.step) for r in visits} == {(5, 0)} and len(visits) == 8
    expected = walk.expected_visits(asked(spark, [0.6, 0.8]), small, params.but(initial_pool_size=9, start_subset=9)).collect()
    mass = {0: {}}
    for r in search.starts(asked(spark, [0.6, 0.8]), small, params.but(initial_pool_size=9, start_subset=9)).collect():
        mass[0][r.node_id] = r.share * 8
    degree = {n: sum(a == n for a, _ in EDGES) for n in VECTORS}
    mean = sum(degree.values()) / sum(1 for d in degree.values() if d)

    def weight(n):
        central = math.log(1 + degree[n]) / (math.log(1 + degree[n]) + math.log(1 + mean))
        return max(0.3 * (cos([0.6, 0.8], VECTORS[n]) + 1) / 2 + 0.4 * central + 0.3, 0.001)

    total = dict(mass[0])
    for step in range(3):
        mass[step + 1] = {}
        for n, m in mass[step].items():
            out = [b for a, b in EDGES if a == n and VECTORS[b]]
            for b in out:
                mass[step + 1][b] = mass[step + 1].get(b, 0) + m * weight(b) / sum(map(weight, out))
        for n, m in mass[step + 1].items():
            total[n] = total.get(n, 0) + m
    assert {r.node_id: pytest.approx(r.votes, abs=1e-6) for r in expected} == total and 6 not in total


def test_no_steps_and_one_query(spark, small):
    params = Params(n_agents=5, steps=0, initial_pool_size=3, start_subset=2)
    rows = Retriever(small, params).retrieve(asked(spark, [1.0, 0.0])).collect()
    assert {r.node_id for r in rows} == {0, 1} and sum(r.votes for r in rows) == pytest.approx(5)
    one = metrics.per_query(Retriever(small, params).retrieve(asked(spark, [1.0, 0.0])), spark.createDataFrame([(0, 0)], "query_id bigint, node_id bigint"), asked(spark, [1.0, 0.0]))
    told = metrics.summary(one.withColumn("run", F.lit("r"))).where("metric = 'mrr'").first()
    assert told["mean"] == 1.0 and told["std"] is None


def test_nodes_without_a_vector_score_zero(spark, small):
    visits = spark.createDataFrame([(0, 6, 3.0), (0, 1, 1.0)], "query_id bigint, node_id bigint, votes double")
    rows = {r.node_id: r.score for r in walk.rank_visits(visits, asked(spark, [1.0, 0.0]), small, Params()).collect()}
    assert rows[6] == 0.0 and rows[1] > 0


def test_empty_truths_and_results(spark):
    results = spark.createDataFrame([(0, 1, 7), (0, 2, None), (0, 3, 8), (0, 4, 8)], "query_id bigint, rank int, node_id bigint")
    truth = spark.createDataFrame([(0, 8), (0, 8), (0, 5), (2, 1), (0, None)], "query_id bigint, node_id bigint")
    rows = {r.query_id: r for r in metrics.per_query(results, truth, asked(spark, [1.0], [1.0], [1.0])).collect()}
    assert (rows[0].mrr, rows[0].recall_at_5, rows[0].hit_at_1, rows[0].gt_count, rows[0].diversity_count) == (0.5, 0.5, 0.0, 2, 1)
    for i in (1, 2):
        assert (rows[i].mrr, rows[i].recall_at_20, rows[i].dr_at_20, rows[i].diversity_node_types) == (0.0, 0.0, 0.0, 0)
    assert rows[1].gt_count == 0 and rows[2].gt_count == 1


def live_walk(query, qvec, params, starts):
    """The walk of one query, step by step, as the prototype has it."""
    where, level, votes = dict(starts), {}, {}
    for n in where.values():
        votes[n] = votes.get(n, 0) + 1
    for step in range(1, params.steps + 1):
        for agent in sorted(where):
            options = sorted(b for a, b in EDGES if a == where[agent])
            if not options:
                continue
            top = max(level.values(), default=1.0)
            scores = []
            for b in options:
                level.setdefault(b, 1.0)
                like = cos(qvec, VECTORS[b]) if VECTORS[b] else 0.0
                scores.append(max(0.0, 0.4 * (RELEVANCE[b] or 0.0) + 0.3 * like + 0.3 * (1.0 + top - level[b])))
            scores = scores if sum(scores) > 0 else [1.0] * len(scores)
            left, to = uniform_py(query, agent, step, "live") * sum(scores), options[-1]
            for b, s in zip(options, scores, strict=True):
                left -= s
                if left < 0:
                    to = b
                    break
            level[to] += RELEVANCE[to] or 0.0
            where[agent] = to
            votes[to] = votes.get(to, 0) + 1
        level = {k: v * params.decay for k, v in level.items()}
    return votes


@pytest.mark.parametrize("agents", [20, 5])
def test_live_pheromones_are_the_plain_loop(spark, small, agents):
    params = Params(n_agents=agents, initial_pool_size=6, start_subset=4)
    vectors = [[1.0, 0.2], [0.1, 1.0], [-1.0, 0.3]]
    queries = asked(spark, *vectors)
    pool = search.top_n(queries, small.nodes, 6).where("rank <= 4")
    begun = {}
    for r in walk.sampled_starts(pool, params, uniform_zone=True).collect():
        begun.setdefault(r.query_id, {})[r.agent_id] = r.node_id
    got = {}
    for r in prototype.async_votes(queries, small, params).collect():
        got.setdefault(r.query_id, {})[r.node_id] = r.votes
    assert got == {i: live_walk(i, q, params, begun[i]) for i, q in enumerate(vectors)}
    ranked = prototype.consensus(prototype.async_votes(queries, small, params), small, params).where("query_id = 0").orderBy("rank").collect()
    want = sorted(((-round(0.6 * v / agents + 0.4 * (RELEVANCE[n] or 0.0), 10), n) for n, v in got[0].items()))
    assert [r.node_id for r in ranked] == [n for _, n in want]


def test_p_values_are_those_of_tables(spark):
    told = [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1_000_000, 0.05), (2.0452, 29, 0.05), (0.0, 5, 1.0), (0.6998, 10, 0.5), (636.619, 1, 0.001), (1e9, 3, 0.0), (1e-9, 3, 1.0)]
    frame = spark.createDataFrame([*told, *((-t, df, p) for t, df, p in told)], "t double, df bigint, p double")
    for r in frame.select("*", analysis.student_p(F.col("t"), F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=2e-4 if r.p > 0.002 else 1e-6), r
    x, lgamma = [0.5, 1.0, 1.5, 7.25, 300.5, 1e6], lambda c: analysis.log_gamma(c).alias("g")
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", lgamma(F.col("x"))).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-10) for r in rows)


def test_quantiles_need_no_buffer(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, rng.random(), round(rng.random(), 1)])) for _ in range(500)] + [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0)]
    frame = spark.createDataFrame(rows, "run string, value double").repartition(3)
    shares = {"low": 0.0, "q1": 0.25, "third": 1 / 3, "median": 0.5, "high": 1.0}
    got = {r.run: tuple(r)[1:] for r in analysis.quantiles(frame, "run", "value", shares).collect()}
    want = frame.groupBy("run").agg(F.percentile("value", F.array(*map(F.lit, shares.values()))).alias("q")).where("q IS NOT NULL").collect()
    assert got == {r.run: pytest.approx(tuple(r.q)) for r in want} and "none" not in got
    many = spark.range(10_000_000).select(F.lit("x").alias("run"), (F.xxhash64("id") % 1_000_000 / 7.0).alias("value"))
    plan = analysis.quantiles(many, "run", "value", shares)
    assert tuple(plan.first())[1:] == pytest.approx(tuple(many.agg(F.percentile("value", F.array(*map(F.lit, shares.values())))).first()[0]))
    assert "percentile" not in plan._jdf.queryExecution().toString()


def test_significance_of_tests_without_spread(spark):
    rows = spark.createDataFrame([("a", 2.228, 10), ("b", None, 0), ("c", 50.0, 10), ("d", 0.1, 10)], "metric string, t double, df bigint")
    got = {r.metric: (r.p_value, r.stars) for r in analysis.with_significance(rows).collect()}
    assert got["a"][0] == pytest.approx(0.05, abs=1e-4) and got["b"][0] is None and got["c"][1] == "***" and got["d"][1] == "ns"


def test_ablation_has_all_variants(spark):
    rows = spark.createDataFrame([("full", 0, 0.5, 0.6, 3), ("full", 1, 0.5, 0.2, 1), ("few", 0, 0.1, 0.2, 1), ("few", 1, 0.3, 0.2, 1), ("none", 0, 0.0, 0.0, 0)], "method string, query_id int, mrr double, dr_at_20 double, diversity_count bigint")
    got = {r.method: tuple(r)[1:] for r in analysis.ablation(rows, "full").collect()}
    assert got == {"full": (0.5, 0.4, 2.0, 0.0), "few": (0.2, 0.2, 1.0, 100.0), "none": (0.0, 0.0, 0.0, None)}


def test_settings_keep_what_is_null_and_replace_maps_whole():
    params = profile("fast").but(top_k=7, steps=None, movement={"semantic": 1.0}, ranking=None)
    assert params.top_k == 7 and params.steps == PROFILES["fast"].steps and params.movement == {"semantic": 1.0} and params.ranking == PROFILES["fast"].ranking
    with pytest.raises(ValueError, match="no profile"):
        profile("unknown")


def test_texts_are_embedded_once_and_bad_queries_are_named(spark, small):
    texts = spark.createDataFrame([(0, "red fish"), (1, "blue fish"), (2, "red fish"), (3, "")], "query_id bigint, text string")
    seen = []

    def embed(frame):
        seen.append(sorted(r.text for r in frame.collect()))
        return hashing_embedder(2)(frame)

    with Retriever(small, Params(n_agents=3, steps=1)) as retriever:
        rows = retriever.retrieve_texts(texts, embed).collect()
    assert seen == [["", "blue fish", "red fish"]]
    by = {i: [(r.rank, r.node_id) for r in rows if r.query_id == i] for i in range(4)}
    assert by[0] and sorted(by[0]) == sorted(by[2])
    vectors = {r.text: r.qvec for r in hashing_embedder(8)(texts.select("text")).collect()}
    assert vectors[""] == [0.0] * 8 and math.isclose(sum(x * x for x in vectors["red fish"]), 1.0)
    bad = asked(spark, [1.0, 0.0], None)
    assert [r.query_id for r in Retriever(small).rejected(bad).collect()] == [1]
    assert [r.query_id for r in without_vectors(bad.select("query_id"), bad).collect()] == [1]
    table = spark.createDataFrame([("red fish", [1.0, 0.0])], "text string, qvec array<double>")
    assert lookup_embedder(table)(texts.where("query_id = 0").select("text")).first().qvec == [1.0, 0.0]
    with pytest.raises(Exception, match="no vector for: blue fish"):
        lookup_embedder(table)(texts.where("query_id = 1").select("text")).collect()


def test_release_leaves_other_tables_cached(spark):
    other = spark.range(7).persist()
    other.count()
    kept = g.Graph.of(spark.range(3).select(F.col("id").alias("node_id")), spark.createDataFrame([(0, 1)], "src bigint, dst bigint")).kept()
    kept.nodes.count()
    Retriever(kept).close()
    assert other.storageLevel.useMemory and not kept.nodes.storageLevel.useMemory
    other.unpersist()


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string").repartition(2)
    assert sorted(map(tuple, g.write_table(frame, f"file://{tmp_path}/t").collect())) == [(1, "a"), (2, "b")]
    g.write_csv(frame, f"file://{tmp_path}/c")
    files = list((tmp_path / "c").glob("*.csv"))
    assert len(files) == 1 and sorted(files[0].read_text().splitlines()) == ["1,a", "2,b", "i,t"]


def test_cosine_of_zero_and_missing_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], None)], "a array<double>, z array<double>, n array<double>").select(cosine("a", "z").alias("p"), cosine("a", "z", 0.0).alias("q"), cosine("a", "n").alias("r"), cosine("a", "a", 0.0).alias("s")).first()
    assert row.p == 0.0 and row.q is None and row.r is None and row.s == 1.0


def test_pheromones_of_windows(spark):
    rng = random.Random(3)
    rows = [(f"2024-01-01 {rng.randrange(0, 6):02d}:{rng.randrange(60):02d}:00", rng.randrange(3), rng.choice([0.0, 1.0, 2.5])) for _ in range(60)]
    visits = spark.createDataFrame(rows, "at string, node_id bigint, deposit double").select(F.to_timestamp("at").alias("ts"), "node_id", "deposit")
    for minutes in (60, 15):
        got = {r.node_id: r.pheromone for r in pheromones.levels(pheromones.windowed_deposits(visits, f"{minutes} minutes"), 0.5, f"{minutes} minutes").collect()}
        window = lambda at: (int(at[11:13]) * 60 + int(at[14:16])) // minutes  # noqa: E731, B023
        last = max(window(at) for at, _, d in rows if d > 0)
        want = {}
        for at, n, d in rows:
            want[n] = want.get(n, 0.0) + d * 0.5 ** (last - window(at))
        assert got == {n: pytest.approx(v) for n, v in want.items() if v}
