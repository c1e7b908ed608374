"""Named queries over the test tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.functions import heuristics as h
from walkrank.operators import analysis, metrics, pivots, prototype, search, walk
from walkrank.params import Params, profile
from walkrank.plans import oracle as o
from walkrank.plans.embeddings import CachedEmbedder
from walkrank.plans.registry import Registry, plain
from walkrank.plans.retriever import Retriever, checked, hashing_embedder, rejects, without_vectors
from walkrank.sources import graph as g
from walkrank.sources import plugins, synthetic

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Metrics of comparisons.
COMPARED = ["hit_at_1", "hit_at_5", "hit_at_10", "hit_at_20", "recall_at_5", "recall_at_20", "mrr", "dr_at_20"]
ABLATED = ["hit_at_10", "mrr", "dr_at_20"]
#: Queries, the first by id, that the summary of ablations is about.
ABLATION_QUERIES = 10
SEED = 42
#: Years after which questions ask for documents.
YEARS = (1998, 2000)


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@register("vector_topn", o.query(o.pool(30), "SELECT query_id, rank, node_id, round(score, 6) AS score FROM pool"))
def vector_topn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_n(g.load_queries(spark, d), g.load_nodes(spark, d), 30), "score")


@register("vector_topn_pivots", o.query(o.pool(30), "SELECT query_id, rank, node_id, round(score, 6) AS score FROM pool"))
def vector_topn_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The same by blocks around pivots, of which those that can't matter are skipped."""
    return _rounded(pivots.build_index(g.load_nodes(spark, d)).top_n(g.load_queries(spark, d), 30)[0], "score")


@register(
    "vector_fetch_batch",
    o.query("", "SELECT query_id AS request_id, CAST(pos AS INTEGER) AS pos, r.node_id, round(n.vec[1], 6) AS first, len(n.vec) AS dims FROM (SELECT query_id, unnest([query_id, query_id + 1, -1, query_id]) AS node_id, unnest([0, 1, 2, 3]) AS pos FROM queries) r LEFT JOIN nodes n USING (node_id)"),
)
def vector_fetch_batch(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_id")
    requests = g.load_queries(spark, d).select(q.alias("request_id"), F.array(q, q + 1, F.lit(-1).cast("bigint"), q).alias("ids"))
    return search.fetch(requests, g.load_nodes(spark, d)).select("request_id", "pos", "node_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.when(F.col("vec").isNotNull(), F.size("vec").cast("bigint")).alias("dims"))


@register("pool_membership", o.query(o.pool(30), "SELECT query_id, rank, node_id, round(score, 6) AS score FROM pool WHERE node_id IN (SELECT src FROM edges)"))
def pool_membership(spark: SparkSession, d: str) -> DataFrame:
    graph = g.load_graph(spark, d)
    return _rounded(search.members_of_pool(search.top_n(g.load_queries(spark, d), graph.nodes, 30), graph.members), "score")


@register("drop_zone_weights", o.query(o.zone(Params()), "SELECT query_id, rank, node_id, round(weight, 6) AS weight, round(share, 6) AS share FROM zone"))
def drop_zone_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.starts(g.load_queries(spark, d), g.load_graph(spark, d), Params()), "weight", "share")


@register("adjacency_build", o.query("", "SELECT src AS node_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs, count(*) AS degree FROM edges GROUP BY src"))
def adjacency_build(spark: SparkSession, d: str) -> DataFrame:
    return g.adjacency(g.load_edges(spark, d)).select("node_id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"), F.col("degree").cast("bigint").alias("degree"))


@register("adjacency_blocks", o.query("", f"SELECT src AS node_id, CAST(0 AS INTEGER) AS block, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs, count(*) AS n FROM edges GROUP BY src HAVING count(*) <= {g.SLOT_EDGES}"))
def adjacency_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lists of bounded length, of nodes that have one: SQL knows no others in these tables."""
    blocks = g.adjacency_blocks(g.load_graph(spark, d)).where("blocks = 1")
    return blocks.select("node_id", "block", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"), F.size("nbrs").cast("bigint").alias("n"))


@register("degree_stats", o.query("", "SELECT min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree, (SELECT degree FROM degree ORDER BY degree LIMIT 1 OFFSET (SELECT count(*) // 2 FROM degree)) AS median_degree FROM degree"))
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.degree_stats(g.load_graph(spark, d).degree)


@register("neighbor_expand", o.query("", "SELECT q.query_id AS node_id, e.dst, coalesce(t.degree, 0) AS degree FROM queries q JOIN edges e ON e.src = q.query_id JOIN traits t ON t.node_id = e.dst"))
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    graph = g.load_graph(spark, d)
    asked = g.load_queries(spark, d).select(F.col("query_id").alias("node_id"))
    return graph.hops(asked).join(graph.degree.withColumnRenamed("node_id", "dst"), "dst", "left").select("node_id", "dst", F.coalesce("degree", F.lit(0)).alias("degree"))


def _heuristic(name: str, value, spark: SparkSession, d: str) -> DataFrame:
    graph = g.load_graph(spark, d)
    marks = g.read(spark, d, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") / 10.0).alias("pheromone"))
    top = F.broadcast(marks.join(graph.nodes, "node_id", "left_semi").agg(F.max("pheromone").alias("max_pheromone")))
    nodes = graph.traits().join(marks, "node_id", "left").join(top)
    rows = search.all_pairs(g.load_queries(spark, d), nodes, ["degree", "avg_degree", "relevance", "pheromone", "max_pheromone"])
    rows = rows.withColumns({"agent_id": F.lit(3), "step": F.lit(2), "dst": F.col("node_id"), "votes": F.col("degree").cast("double"), "n_agents": F.lit(20)})
    return rows.select("query_id", "node_id", F.round(value(), 6).alias("value"))


_MARKED = "marked AS (SELECT s.*, p_size / 10e0 AS pheromone, (SELECT max(p_size / 10e0) FROM part WHERE p_partkey IN (SELECT node_id FROM nodes)) AS max_pheromone, 3 AS agent_id, 2 AS step, node_id AS dst, CAST(degree AS DOUBLE) AS votes, 20 AS n_agents FROM sims s LEFT JOIN part ON p_partkey = node_id)"
for _key, _name in {
    "h_semantic": "semantic", "h_cosine": "cosine", "h_centrality": "centrality", "h_log_degree": "log_degree", "h_repulsion": "repulsion", "h_jitter": "jitter", "h_visited": "visited", "h_diversity": "diversity", "h_relevance": "relevance",
    "dep_flat": "flat", "dep_hub": "dep_hub", "dep_hub_raw": "dep_hub_raw", "dep_semantic": "dep_semantic", "dep_semantic_raw": "dep_semantic_raw", "dep_explorer": "dep_explorer", "dep_collab": "dep_collab",
}.items():
    register(_key, o.query(_MARKED, f"SELECT query_id, node_id, round({o.HEURISTIC[_name]}, 6) AS value FROM marked"))(partial(_heuristic, _name, h.NAMED[_name]))
register("h_dataset_centrality", o.query(_MARKED, "SELECT query_id, node_id, round(coalesce(ln(1 + degree) / nullif(ln(1 + degree) + ln(1 + 18.2e0), 0), 0), 6) AS value FROM marked"))(partial(_heuristic, "amazon", h.dataset_centrality("amazon")))


@register("movement_scores", o.query("", f"SELECT query_id, node_id, round(greatest({o.weighted(Params().movement)}, 0.001e0), 6) AS w FROM (SELECT *, 0e0 AS pheromone, 1e0 AS max_pheromone FROM sims)"))
def movement_scores(spark: SparkSession, d: str) -> DataFrame:
    graph, queries = g.load_graph(spark, d), g.load_queries(spark, d)
    return _rounded(walk.all_weights(queries, graph, Params()), "w")


@register("transition_matrix", o.query(o.expected(Params()), "SELECT t.query_id, t.src, t.dst, round(t.p, 6) AS p FROM t JOIN zone z ON z.query_id = t.query_id AND z.node_id = t.src"))
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    graph, queries = g.load_graph(spark, d), g.load_queries(spark, d)
    at = search.starts(queries, graph, Params()).select("query_id", "node_id", F.col("share").alias("mass"))
    return _rounded(walk.transitions(at, queries, graph, Params()).drop("mass"), "p")


def _expected(params: Params, by: str, spark: SparkSession, d: str) -> DataFrame:
    graph, queries = g.load_graph(spark, d), g.load_queries(spark, d)
    return walk.rank_visits(walk.expected_visits(queries, graph, params, by), queries, graph, params, by)


def _sampled(params: Params, spark: SparkSession, d: str) -> DataFrame:
    return Retriever(g.load_graph(spark, d), params, "sampled").retrieve(g.load_queries(spark, d))


_RESULT = "SELECT query_id, rank, node_id, round(votes, 6) AS votes, round(score, 6) AS score FROM res"
for _name in ("default", "fast", "high_exploration"):
    _p = profile(_name)
    register(f"walk_expected_{_name}", o.query(o.expected(_p) + ",\n" + o.ranked(_p, "visit_weighted"), _RESULT))(lambda s, d, p=_p: _rounded(_expected(p, "visit_weighted", s, d), "votes", "score"))
register("rank_votes", o.query(o.expected(Params()) + ",\n" + o.ranked(Params()), _RESULT))(lambda s, d: _rounded(_expected(Params(), "raw", s, d), "votes", "score"))
for _name, _p in {"walk_sampled_off": Params(), "walk_sampled_sync": Params(pheromone="sync"), "walk_profile_benchmark": profile("benchmark"), "walk_benchmark_sync": profile("benchmark", pheromone="sync")}.items():
    register(_name, o.query(o.sampled(_p) + ",\n" + o.ranked(_p), _RESULT))(lambda s, d, p=_p: _rounded(_sampled(p, s, d), "votes", "score"))


def _near(columns: dict) -> np.ndarray:
    return (columns["cos"].to_numpy(zero_copy_only=False) + 1) / 2


def _central(columns: dict) -> np.ndarray:
    own, mean = (np.log1p(columns[c].to_numpy(zero_copy_only=False).astype(float)) for c in ("degree", "avg_degree"))
    return own / np.where(own + mean > 0, own + mean, 1.0)


#: The default strategy with two of its heuristics as callables over columns.
_MIXED = Params(movement={h.Batched(_near, ("cos",)): 0.3, h.Batched(_central, ("degree", "avg_degree")): 0.4, "repulsion": 0.3})
register("walk_sampled_batched", _SQL["walk_sampled_off"])(lambda s, d: _rounded(_sampled(_MIXED, s, d), "votes", "score"))


@register("walk_plugin", _SQL["walk_expected_fast"])
def walk_plugin(spark: SparkSession, d: str) -> DataFrame:
    """A walk over the same graph as a store outside Spark has it: read in parts by the data source of stores."""
    kept = g.graph_folder(spark, d)
    graph = plugins.load_dataset(spark, "parquet", nodes=g.kept_folder(spark, kept, "nodes"), edges=g.kept_folder(spark, kept, "edges"))
    params, queries = profile("fast"), g.load_queries(spark, d)
    return _rounded(walk.rank_visits(walk.expected_visits(queries, graph, params), queries, graph, params, "visit_weighted"), "votes", "score")


@register("flow_greedy", o.query(o.flow(), "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, node_id) AS rank, node_id, votes FROM votes) WHERE rank <= 20"))
def flow_greedy(spark: SparkSession, d: str) -> DataFrame:
    return prototype.rank_by_frequency(prototype.flow_visits(g.load_queries(spark, d), g.load_graph(spark, d)))


def _relevance_walk(params: Params, spark: SparkSession, d: str, queries: DataFrame | None = None) -> DataFrame:
    return prototype.rank_by_votes(prototype.relevance_visits(g.load_queries(spark, d) if queries is None else queries, g.load_graph(spark, d), params, 20), 20)


_FEW = Params(n_agents=5)
register("ablation_no_pheromone", o.query(o.relevance_walk(Params()), "SELECT query_id, rank, node_id, round(votes, 6) AS votes FROM res2"))(lambda s, d: _rounded(_relevance_walk(Params(), s, d), "votes"))
register("walk_sampled_few_agents", o.query(o.sampled(_FEW) + ",\n" + o.ranked(_FEW), _RESULT))(lambda s, d: _rounded(_sampled(_FEW, s, d), "votes", "score"))


def _live_walk(params: Params, spark: SparkSession, d: str, queries: DataFrame | None = None) -> DataFrame:
    graph = g.load_graph(spark, d)
    return prototype.consensus(prototype.async_votes(g.load_queries(spark, d) if queries is None else queries, graph, params), graph, params)


register("walk_async")(lambda s, d: _rounded(_live_walk(Params(), s, d), "votes", "score"))
register("ablation_few_agents")(lambda s, d: _rounded(_live_walk(_FEW, s, d), "votes", "score"))


@register("ground_truth", o.query("", "SELECT query_id, node_id FROM truth"))
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return g.load_truth(spark, d)


def _metrics(spark: SparkSession, d: str, results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    return metrics.per_query(results, g.load_truth(spark, d), g.load_queries(spark, d) if queries is None else queries, g.load_nodes(spark, d))


_WALK = o.expected(Params()) + ",\n" + o.ranked(Params(), "visit_weighted") + ",\n" + o.metrics("res", "mw")
_BOTH = _WALK + ",\n" + o.relevance_walk(Params()) + ",\n" + o.metrics("res2", "mr") + ",\nruns AS MATERIALIZED (SELECT 'walk' AS method, * FROM mw UNION ALL SELECT 'relevance' AS method, * FROM mr)"
_ROUNDED_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in o.NAMES if not m.startswith("diversity")) + ", diversity_node_types, diversity_count, gt_count"


def _stored(name: str, params: Params, results: Callable[[], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a run, from the registry: queries of one session, and later ones, walk once."""
    return Registry(spark).run(name, plain(params), g.sources(d), lambda: _metrics(spark, d, results()))


def _walk_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _stored("walk", Params(), lambda: _expected(Params(), "visit_weighted", spark, d), spark, d)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    relevance = _stored("relevance", Params(), lambda: _relevance_walk(Params(), spark, d), spark, d)
    return analysis.union_runs({"walk": _walk_metrics(spark, d), "relevance": relevance})


@register("metrics_per_query", o.query(_WALK, f"SELECT query_id, {_ROUNDED_METRICS} FROM mw"))
def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_walk_metrics(spark, d), *(m for m in metrics.METRICS if not m.startswith("diversity")))


_LONG = f"long AS ({o.stacked('runs', o.NAMES, 'method AS run, query_id')}), sums AS (SELECT run, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY 1, 2)"


@register("metrics_summary", o.query(_BOTH + ",\n" + _LONG, "SELECT * FROM sums"))
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_runs(spark, d).withColumnRenamed("method", "run"))


@register("metrics_formatted", o.query(_BOTH + ",\n" + _LONG, "SELECT run, metric, CASE WHEN std IS NULL THEN printf('%.4f', mean) ELSE printf('%.4f ± %.4f', mean, std) END AS value FROM sums"))
def metrics_formatted(spark: SparkSession, d: str) -> DataFrame:
    return metrics.formatted(metrics_summary(spark, d))


#: What a plot asks for: some metrics, of which one isn't measured.
PLOTTED = ["mrr", "hit_at_5", "ndcg_at_5", "recall_at_20"]
_SHOWN = "asked AS (SELECT unnest(['mrr', 'hit_at_5', 'ndcg_at_5', 'recall_at_20']) AS metric, unnest([0, 1, 2, 3]) AS place)"


@register("plot_bars", o.query(_BOTH + ",\n" + _LONG + ", " + _SHOWN, "SELECT CAST(place AS INTEGER) AS place, metric, coalesce(round(mean, 4), 0e0) AS value FROM asked LEFT JOIN (SELECT * FROM sums WHERE run = 'walk') USING (metric)"))
def plot_bars(spark: SparkSession, d: str) -> DataFrame:
    """The bars of one run: a metric that it lacks is 0."""
    return metrics.plotted(metrics_summary(spark, d).where("run = 'walk'").drop("run"), PLOTTED, missing=0.0)


@register("plot_comparison", o.query(_BOTH + ",\n" + _LONG + ", " + _SHOWN, "SELECT CAST(place AS INTEGER) AS place, metric, run, round(mean, 4) AS value FROM asked JOIN sums USING (metric)"))
def plot_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The bars of several runs, a group a metric: what a run lacks is left out."""
    return metrics.plotted(metrics_summary(spark, d), PLOTTED)


@register("metrics_node_types", o.query(_WALK, "SELECT query_id, diversity_node_types FROM mw"))
def metrics_node_types(spark: SparkSession, d: str) -> DataFrame:
    return _walk_metrics(spark, d).select("query_id", "diversity_node_types")


@register("ab_summary", o.query(_BOTH, f"SELECT method, {', '.join(f'round(avg({m}), 4) AS {m}' for m in COMPARED)} FROM runs GROUP BY method"))
def ab_summary(spark: SparkSession, d: str) -> DataFrame:
    return analysis.group_means(_runs(spark, d), COMPARED)


_PAIRS = f"stack AS ({o.stacked('runs', COMPARED, 'method, query_id')}), pairs AS (SELECT x.query_id, x.metric, x.value AS x, y.value AS y FROM stack x JOIN stack y ON x.query_id = y.query_id AND x.metric = y.metric AND x.method = 'walk' AND y.method = 'relevance')"


_TESTED = "SELECT metric, n, round(m, 6) AS mean_diff, CASE WHEN sd > 1e-12 THEN round(m / (sd / sqrt(n)), 6) END AS t, n - 1 AS df FROM (SELECT metric, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS sd FROM pairs GROUP BY metric)"
#: The density of t summed over its angle, by Simpson's rule.
_P_VALUE = "1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - lgamma(0.5)) * atan(abs(t) / sqrt(df)) / 6000 * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(abs(t) / sqrt(df)) * i / 2000), df - 1)))"


@register("ab_ttest", o.query(_BOTH + ",\n" + _PAIRS, _TESTED))
def ab_ttest(spark: SparkSession, d: str) -> DataFrame:
    return analysis.paired_t(_runs(spark, d), "walk", "relevance", COMPARED)


@register("ab_significance", o.query(_BOTH + ",\n" + _PAIRS + f", tested AS ({_TESTED}), p AS (SELECT *, CASE WHEN df >= 1 THEN round({_P_VALUE}, 6) END AS p_value FROM (SELECT * REPLACE (CAST(df AS DOUBLE) AS df) FROM tested))", "SELECT metric, n, mean_diff, t, CAST(df AS BIGINT) AS df, p_value, CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' ELSE 'ns' END AS stars FROM p"))
def ab_significance(spark: SparkSession, d: str) -> DataFrame:
    return analysis.with_significance(ab_ttest(spark, d))


@register("ab_pct_change", o.query(_BOTH + ",\n" + _PAIRS, "SELECT metric, round(x, 4) AS mean_a, round(y, 4) AS mean_b, round(CASE WHEN y > 0 THEN (x - y) / y * 100 ELSE 0e0 END, 4) AS change, CASE WHEN round(x - y, 9) > 0 THEN 'walk' WHEN round(x - y, 9) < 0 THEN 'relevance' ELSE 'tie' END AS winner FROM (SELECT metric, avg(x) AS x, avg(y) AS y FROM pairs GROUP BY metric)"))
def ab_pct_change(spark: SparkSession, d: str) -> DataFrame:
    return analysis.percent_change(_runs(spark, d), "walk", "relevance", COMPARED)


@register("ab_pivot", o.query(_BOTH, "SELECT query_id, round(coalesce(avg(mrr) FILTER (method = 'walk'), 0), 6) AS walk, round(coalesce(avg(mrr) FILTER (method = 'relevance'), 0), 6) AS relevance FROM runs GROUP BY query_id"))
def ab_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.pivot_metric(_runs(spark, d), ["walk", "relevance"]), "walk", "relevance")


_DIFFS = "diffs AS (SELECT w.query_id, round(w.mrr - r.mrr, 6) AS diff FROM mw w JOIN mr r USING (query_id))"


@register("ab_pivot_extremes", o.query(_BOTH + ",\n" + _DIFFS, "SELECT 'low' AS side, CAST(row_number() OVER (ORDER BY diff, query_id) AS INTEGER) AS place, query_id, diff FROM diffs QUALIFY place <= 3 UNION ALL SELECT 'high' AS side, CAST(row_number() OVER (ORDER BY diff DESC, query_id) AS INTEGER) AS place, query_id, diff FROM diffs QUALIFY place <= 3"))
def ab_pivot_extremes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.extremes(analysis.pivot_metric(_runs(spark, d), ["walk", "relevance"]), "walk", "relevance")


_BUCKETS = "b AS (SELECT *, CASE WHEN gt_count <= 3 THEN 'Simple' WHEN gt_count <= 6 THEN 'Medium' ELSE 'Complex' END AS complexity FROM runs), cells AS (SELECT unnest(['walk', 'relevance']) AS method), kinds AS (SELECT unnest(['Simple', 'Medium', 'Complex']) AS complexity)"


@register("ab_complexity", o.query(_BOTH + ",\n" + _BUCKETS, f"SELECT c.method, k.complexity, {', '.join(f'coalesce(round(avg({m}), 4), 0e0) AS {m}' for m in ABLATED)} FROM cells c CROSS JOIN kinds k LEFT JOIN b ON b.method = c.method AND b.complexity = k.complexity GROUP BY 1, 2"))
def ab_complexity(spark: SparkSession, d: str) -> DataFrame:
    return analysis.by_complexity(_runs(spark, d), ["walk", "relevance"], ABLATED)


@register("ab_quartiles", o.query(_BOTH, "SELECT method, round(quantile_cont(mrr, 0.25), 6) AS q1, round(quantile_cont(mrr, 0.5), 6) AS median, round(quantile_cont(mrr, 0.75), 6) AS q3 FROM runs GROUP BY method"))
def ab_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return analysis.quartiles(_runs(spark, d))


@register("ablation_pair", o.query(_BOTH, f"SELECT method, {', '.join(f'round(avg({m}), 4) AS {m}' for m in ABLATED)} FROM runs GROUP BY method"))
def ablation_pair(spark: SparkSession, d: str) -> DataFrame:
    return analysis.group_means(_runs(spark, d), ABLATED)


@register("ablation_summary")
def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The full walk, that without pheromones, that of five walkers and the greedy flow, over the first ten queries."""
    asked = analysis.first_queries(g.load_queries(spark, d), ABLATION_QUERIES)  # queries walk by themselves: no other changes what these find

    def stored(name: str, params: Params, results: Callable[[], DataFrame]) -> DataFrame:
        settings = plain(params) | {"first_queries": ABLATION_QUERIES}
        return Registry(spark).run(name, settings, g.sources(d), lambda: _metrics(spark, d, results(), asked))

    runs = {
        "full": stored("live", Params(), lambda: _live_walk(Params(), spark, d, asked)),
        "no_pheromone": stored("relevance", Params(), lambda: _relevance_walk(Params(), spark, d, asked)),
        "few_agents": stored("live", _FEW, lambda: _live_walk(_FEW, spark, d, asked)),
        "greedy": stored("greedy", Params(), lambda: prototype.rank_by_frequency(prototype.flow_visits(asked, g.load_graph(spark, d)))),
    }
    return analysis.ablation(analysis.union_runs(runs), "full")


@register("first_queries_topn", o.query(o.pool(30), "SELECT query_id, rank, node_id, round(score, 6) AS score FROM pool WHERE query_id IN (SELECT query_id FROM queries ORDER BY query_id LIMIT 3)"))
def first_queries_topn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_n(analysis.first_queries(g.load_queries(spark, d), 3), g.load_nodes(spark, d), 30), "score")


@register("questions_by_split", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def questions_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Turns of users are questions that people wrote."""
    asked = g.read(spark, d, "conversations").withColumn("human", F.col("role") == "user")
    return g.split_questions(asked, human=True).select("conv_id", "turn", "text")


_EMBEDDED = f"""WITH t AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM t),
s AS (SELECT text, {o.draw("w")} % 128 AS spot FROM w),
c AS (SELECT text, spot % 64 AS i, sum(CASE WHEN spot < 64 THEN 1e0 ELSE -1e0 END) AS c FROM s GROUP BY 1, 2),
n AS (SELECT text, sqrt(sum(c * c)) AS size FROM c GROUP BY 1)
SELECT item_id, CAST(i AS BIGINT) AS dim, round(c / size, 6) AS value FROM benchmark JOIN c USING (text) JOIN n USING (text) WHERE c <> 0"""


@register("embed_texts", _EMBEDDED)
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each different text of the items is embedded once; components that aren't zero."""
    items = g.read(spark, d, "benchmark").where("text IS NOT NULL")
    vectors = hashing_embedder(64)(items.select("text").distinct())
    rows = items.join(vectors, "text").select("item_id", F.posexplode("qvec").alias("dim", "value"))
    return rows.where("value <> 0").select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@register("embed_texts_cached", _EMBEDDED)
def embed_texts_cached(spark: SparkSession, d: str) -> DataFrame:
    """The same, with vectors that earlier runs have kept: only new texts are embedded."""
    items = g.read(spark, d, "benchmark").where("text IS NOT NULL")
    vectors = CachedEmbedder(spark, "hashing-64", hashing_embedder(64))(items.select("text"))
    rows = items.join(vectors, "text").select("item_id", F.posexplode("qvec").alias("dim", "value"))
    return rows.where("value <> 0").select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@register("rejected_queries", "SELECT vec_id AS query_id FROM embeddings LEFT JOIN part ON p_partkey = vec_id WHERE vec_id % 100 = 0 AND (p_size IS NULL OR p_size > 25)")
def rejected_queries(spark: SparkSession, d: str) -> DataFrame:
    """A batch in which only queries of small parts have a vector: the others are named, and don't stop it."""
    small = g.read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("query_id"))
    vectors = g.load_queries(spark, d).join(small, "query_id", "left_semi")
    return without_vectors(g.load_queries(spark, d).select("query_id"), vectors)


_FAULTS = "CASE vec_id % 9 WHEN 1 THEN 'null' WHEN 2 THEN 'length' WHEN 3 THEN 'non-finite' WHEN 4 THEN 'non-finite' WHEN 5 THEN 'zero' END"


def _faulty_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth node asks; in most ninths of them something is wrong with the vector."""
    v, kind = F.col("vec"), F.col("node_id") % 9
    wrong = F.when(kind == 1, F.lit(None).cast("array<double>")).when(kind == 2, F.slice(v, 2, 1000)).when(kind == 3, F.concat(F.slice(v, 2, 1000), F.array(F.lit(float("nan"))))).when(kind == 4, F.concat(F.array(F.lit(float("-inf"))), F.slice(v, 2, 1000))).when(kind == 5, F.transform(v, lambda _: F.lit(0.0))).otherwise(v)
    return g.load_nodes(spark, d).where("node_id % 10 = 0").select(F.col("node_id").alias("query_id"), wrong.alias("qvec"))


@register("checked_rejects", f"SELECT vec_id AS query_id, {_FAULTS} AS reason FROM embeddings WHERE vec_id % 10 = 0 AND vec_id % 9 BETWEEN 1 AND 5")
def checked_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejects(_faulty_batch(spark, d), search.common_length(g.load_nodes(spark, d), "vec"))


_CHECKED = o.query(o.pool(5), "SELECT query_id, rank, node_id, round(score, 6) AS score FROM pool").replace(f"node_id % {g.QUERY_EVERY} = 0", "node_id % 10 = 0 AND node_id % 9 NOT BETWEEN 1 AND 5")


@register("checked_topn", _CHECKED)
def checked_topn(spark: SparkSession, d: str) -> DataFrame:
    """The good queries of the same batch: their results are those they have alone."""
    nodes = g.load_nodes(spark, d)
    return _rounded(search.top_n(checked(_faulty_batch(spark, d), search.common_length(nodes, "vec")), nodes, 5), "score")


@register("h_relation", f"WITH {o.typed_edges()}\nSELECT src, dst, CASE relation WHEN 'cites' THEN 1e0 WHEN 'extends' THEN 0.8e0 ELSE 0.5e0 END AS value FROM typed")
def h_relation(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.typed_edges(spark, d).select("src", "dst", h.relation_preference({"cites": 1.0, "extends": 0.8})().alias("value"))


@register("kb_documents", f"WITH {o.kb()} SELECT * FROM docs")
def kb_documents(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.documents(spark, d)


@register("kb_graph", f"WITH {o.kb()},\n{o.kb_graph(SEED)}")
def kb_graph(spark: SparkSession, d: str) -> DataFrame:
    docs = synthetic.topics(spark, d)
    return synthetic.graph(docs, docs.count(), SEED)


def _kb_truth(kind: str, answer, spark: SparkSession, d: str) -> DataFrame:
    return answer(synthetic.documents(spark, d), synthetic.questions(spark, 50, SEED, YEARS).where(F.col("kind") == kind))


for _key, _kind, _answer in (("gt_two_topic", "two_topic", synthetic.truth_two_topics), ("gt_topic_year", "topic_year", synthetic.truth_topic_year), ("gt_topic", "topic", synthetic.truth_topic)):
    register(_key, f"WITH {o.kb()},\n{o.kb_questions(50, SEED, YEARS)}\n{o.kb_truth(_kind)}")(partial(_kb_truth, _kind, _answer))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
