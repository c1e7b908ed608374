"""SQL that states the same results as the plans, for a second engine on the same tables."""

from __future__ import annotations

from walkrank.params import Params
from walkrank.sources.graph import QUERY_EVERY
from walkrank.sources.synthetic import FLAGS, RELATIONS, TOPICS


def draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def uniform(*parts: str) -> str:
    return f"({draw(*parts)} / 4294967296.0e0)"


def race(weight: str, *parts: str) -> str:
    return f"(-ln(({draw(*parts)} + 0.5e0) / 4294967296.0e0) / {weight})"


BASE = f"""
nodes AS MATERIALIZED (
  SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS vec, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm, label,
         'label_' || label AS node_type, 0.1e0 + 0.9e0 * (p_size - 1) / 49.0e0 AS relevance
  FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
lines AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT node_id FROM nodes)),
edges AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lines a JOIN lines b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey),
degree AS MATERIALIZED (SELECT src AS node_id, count(*) AS degree FROM edges GROUP BY src),
traits AS MATERIALIZED (SELECT n.*, coalesce(d.degree, 0) AS degree, (SELECT avg(degree) FROM degree) AS a FROM nodes n LEFT JOIN degree d USING (node_id)),
queries AS MATERIALIZED (SELECT node_id AS query_id, vec AS qvec, norm AS qnorm, label FROM nodes WHERE node_id % {QUERY_EVERY} = 0),
truth AS MATERIALIZED (
  SELECT query_id, node_id FROM (
    SELECT q.query_id, n.node_id, count(*) OVER (PARTITION BY q.query_id) AS c, row_number() OVER (PARTITION BY q.query_id ORDER BY n.node_id) AS i
    FROM nodes n JOIN queries q ON n.label = q.label AND n.node_id <> q.query_id WHERE n.relevance > 0.6e0) WHERE c >= 2 AND i <= 10),
sims AS MATERIALIZED (
  SELECT q.query_id, n.node_id, list_dot_product(qvec, vec) / (qnorm * norm) AS unit_cos, list_dot_product(qvec, vec) / (qnorm * norm + 1e-8) AS cos, degree, a, relevance
  FROM queries q, traits n)"""

HEURISTIC = {
    "cosine": "cos",
    "semantic": "(cos + 1) / 2",
    "log_degree": "ln(1 + degree)",
    "centrality": "coalesce(ln(1 + degree) / nullif(ln(1 + degree) + ln(1 + a), 0), 0)",
    "repulsion": "1 - coalesce(pheromone, 0e0) / greatest(max_pheromone, 0.0001e0)",
    "jitter": uniform("query_id", "agent_id", "step", "dst", "'jitter'"),
    "visited": "votes / n_agents",
    "flat": "1e0",
    "dep_hub": "coalesce(ln(1 + degree) / nullif(ln(1 + degree) + ln(1 + a), 0), 0)",
    "dep_hub_raw": "ln(1 + degree)",
    "dep_semantic": "CASE WHEN (cos + 1) / 2 > 0.5e0 THEN ((cos + 1) / 2 - 0.5e0) * 2 ELSE 0e0 END",
    "dep_semantic_raw": "greatest(0e0, cos)",
    "dep_explorer": "2e0 - 1.5e0 * coalesce(pheromone, 0e0) / greatest(max_pheromone, 0.0001e0)",
    "dep_collab": "least(1 + coalesce(pheromone, 0e0), 5e0)",
    "diversity": "1 + (max_pheromone - coalesce(pheromone, 1e0))",
    "relevance": "coalesce(relevance, 0e0)",
}


def weighted(strategies) -> str:
    return " + ".join(f"({HEURISTIC[name]}) * {weight}e0" for name, weight in strategies.items()) or "0e0"


def query(ctes: str, select: str) -> str:
    return f"WITH {BASE}{',' if ctes else ''}\n{ctes}\n{select}"


def pool(n: int, name: str = "pool") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, node_id, unit_cos AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(unit_cos, 10) DESC, node_id) AS rank FROM sims) WHERE rank <= {n})"


def zone(p: Params) -> str:
    return f"""{pool(p.initial_pool_size)},
inside AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM pool WHERE node_id IN (SELECT src FROM edges)),
weighed AS (SELECT query_id, i AS rank, node_id, 1 + {p.drop_slope}e0 * ({p.start_subset} - i) AS weight FROM inside WHERE i <= {p.start_subset}),
zone AS MATERIALIZED (SELECT *, weight / sum(weight) OVER (PARTITION BY query_id) AS share FROM weighed)"""


def expected(p: Params, prefix: str = "") -> str:
    """CTEs up to ``votes``."""
    steps = "".join(f",\nm{s} AS MATERIALIZED (SELECT t.query_id, t.dst AS node_id, sum(m.mass * t.p) AS mass FROM m{s - 1} m JOIN t ON t.query_id = m.query_id AND t.src = m.node_id GROUP BY 1, 2)" for s in range(1, p.steps + 1))
    union = " UNION ALL ".join(f"SELECT * FROM m{s}" for s in range(p.steps + 1))
    return f"""{zone(p)},
w AS MATERIALIZED (SELECT query_id, node_id, greatest({weighted(p.movement)}, {p.floor}e0) AS w FROM (SELECT *, 0e0 AS pheromone, 1e0 AS max_pheromone FROM sims)),
t AS MATERIALIZED (SELECT w.query_id, e.src, e.dst, w.w / sum(w.w) OVER (PARTITION BY w.query_id, e.src) AS p FROM edges e JOIN w ON w.node_id = e.dst),
m0 AS MATERIALIZED (SELECT query_id, node_id, share * {p.n_agents} AS mass FROM zone){steps},
votes AS MATERIALIZED (SELECT query_id, node_id, sum(mass) AS votes FROM ({union}) GROUP BY 1, 2)"""


def ranked(p: Params, by: str = "raw", name: str = "res") -> str:
    score = weighted(p.ranking)
    if by == "visit_weighted":
        score = f"{weighted({k: v for k, v in p.ranking.items() if k == 'visited'})} + ({weighted({k: v for k, v in p.ranking.items() if k != 'visited'})}) * (1 - pow(1 - least(1e0, votes / {p.n_agents}), {p.n_agents}))"
    return f"""scored AS (SELECT query_id, node_id, votes, {score} AS score FROM (SELECT v.*, s.cos, {p.n_agents} AS n_agents FROM votes v JOIN sims s USING (query_id, node_id))),
{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, node_id) AS rank, node_id, votes, score FROM scored) WHERE rank <= {p.top_k})"""


def sampled(p: Params) -> str:
    """CTEs up to ``votes`` of drawn walks."""
    out = f"""{zone(p)},
d AS (SELECT query_id, rank, node_id, CAST(round(weight * 1000000) AS BIGINT) AS w, unnest(range({p.n_agents})) AS agent_id FROM zone),
a0 AS MATERIALIZED (SELECT query_id, agent_id, arg_min(node_id, row({race("w", "query_id", "agent_id", "0", "'drop'", "rank")}, rank)) AS node_id FROM d GROUP BY 1, 2)"""
    union = ["SELECT query_id, node_id FROM a0"]
    for s in range(1, p.steps + 1):
        level = f"l{s - 1}" if p.pheromone == "sync" and s > 1 else None
        marks = f"l.pheromone, coalesce((SELECT max(x.pheromone) FROM {level} x WHERE x.query_id = a.query_id), 1e0) AS max_pheromone" if level else "0e0 AS pheromone, 1e0 AS max_pheromone"
        join = f"LEFT JOIN {level} l ON l.query_id = a.query_id AND l.dst = e.dst" if level else ""
        out += f""",
h{s} AS (SELECT a.query_id, a.agent_id, e.dst, {s} AS step, s.cos, s.degree, s.a, s.relevance, {marks} FROM a{s - 1} a JOIN edges e ON e.src = a.node_id JOIN sims s ON s.query_id = a.query_id AND s.node_id = e.dst {join}),
w{s} AS (SELECT query_id, agent_id, dst, CAST(round(greatest({weighted(p.movement)}, {p.floor}e0) * 1000000) AS BIGINT) AS w, {weighted(p.deposit)} AS deposit FROM h{s}),
c{s} AS (SELECT *, row({race("w", "query_id", "agent_id", str(s), "'hop'", "dst")}, dst) AS arrival FROM w{s} WHERE w > 0),
p{s} AS MATERIALIZED (SELECT query_id, agent_id, arg_min(dst, arrival) AS dst, arg_min(deposit, arrival) AS deposit FROM c{s} GROUP BY 1, 2),
a{s} AS MATERIALIZED (SELECT a.query_id, a.agent_id, coalesce(p.dst, a.node_id) AS node_id FROM a{s - 1} a LEFT JOIN p{s} p USING (query_id, agent_id))"""
        if p.pheromone == "sync":
            left = f"(SELECT query_id, dst, sum(deposit) AS added FROM p{s} WHERE deposit > 0 GROUP BY 1, 2)"
            if s == 1:
                out += f",\nl1 AS MATERIALIZED (SELECT query_id, dst, 1 + added AS pheromone FROM {left})"
            else:
                out += f",\nl{s} AS MATERIALIZED (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.dst, y.dst) AS dst, CASE WHEN x.pheromone IS NULL THEN 1 ELSE x.pheromone * {p.decay}e0 END + coalesce(y.added, 0) AS pheromone FROM l{s - 1} x FULL JOIN {left} y ON x.query_id = y.query_id AND x.dst = y.dst)"
        union.append(f"SELECT query_id, dst AS node_id FROM p{s}")
    return out + f",\nvotes AS MATERIALIZED (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS votes FROM ({' UNION ALL '.join(union)}) GROUP BY 1, 2)"


def relevance_walk(p: Params, name: str = "res2") -> str:
    steps = "".join(f",\nr{s} AS MATERIALIZED (SELECT m.query_id, e.dst AS node_id, sum(m.mass * e.p) AS mass FROM r{s - 1} m JOIN re e ON e.src = m.node_id GROUP BY 1, 2)" for s in range(1, p.steps + 1))
    union = " UNION ALL ".join(f"SELECT * FROM r{s}" for s in range(p.steps + 1))
    return f"""{pool(p.initial_pool_size, "pool2")},
re AS MATERIALIZED (SELECT src, dst, CASE WHEN sum(w) OVER (PARTITION BY src) > 0 THEN w / sum(w) OVER (PARTITION BY src) ELSE 1e0 / count(*) OVER (PARTITION BY src) END AS p FROM (SELECT e.src, e.dst, coalesce(n.relevance, 0e0) AS w FROM edges e JOIN nodes n ON n.node_id = e.dst)),
r0 AS MATERIALIZED (SELECT query_id, node_id, {p.n_agents}e0 / count(*) OVER (PARTITION BY query_id) AS mass FROM pool2 WHERE rank <= {p.start_subset}){steps},
votes2 AS (SELECT query_id, node_id, sum(mass) AS votes FROM ({union}) GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(votes, 9) DESC, node_id) AS rank, node_id, votes FROM votes2) WHERE rank <= 20)"""


def flow() -> str:
    out = f"{pool(1)},\nf0 AS MATERIALIZED (SELECT query_id, node_id, unnest(range(20)) AS agent_id, [node_id] AS seen FROM pool)"
    union = ["SELECT query_id, node_id FROM f0"]
    for s in range(1, 5):
        out += f""",
g{s} AS (SELECT f.query_id, f.agent_id, f.seen, e.dst, coalesce(n.relevance, 0e0) AS relevance, CAST(round(exp(5e0 * coalesce(n.relevance, 0e0)) * 1000000) AS BIGINT) AS w FROM f{s - 1} f JOIN edges e ON e.src = f.node_id JOIN nodes n ON n.node_id = e.dst WHERE NOT list_contains(f.seen, e.dst)),
k{s} AS (SELECT *, row({race("w", "query_id", "agent_id", str(s), "'flow'", "dst")}, dst) AS arrival FROM g{s}),
f{s} AS MATERIALIZED (SELECT query_id, arg_min(dst, arrival) AS node_id, agent_id, list_append(any_value(seen), arg_min(dst, arrival)) AS seen FROM k{s} GROUP BY query_id, agent_id HAVING arg_min(relevance, arrival) >= 0.1e0)"""
        union.append(f"SELECT query_id, node_id FROM f{s}")
    return out + f",\nvotes AS (SELECT query_id, node_id, count(*) AS votes FROM ({' UNION ALL '.join(union)}) GROUP BY 1, 2)"


def metrics(results: str, name: str) -> str:
    hits = ", ".join(f"max(CASE WHEN hit AND rank <= {k} THEN 1e0 ELSE 0e0 END) AS hit_at_{k}" for k in (1, 5, 10, 20))
    counts = ", ".join(f"count(DISTINCT CASE WHEN hit AND rank <= {k} THEN node_id END) AS n_{k}" for k in (1, 5, 10, 20))
    return f"""{name}_f AS (SELECT r.query_id, {hits}, {counts}, min(CASE WHEN hit THEN rank END) AS first, count(DISTINCT CASE WHEN rank <= 20 THEN node_type END) AS types
  FROM (SELECT r.query_id, r.rank, r.node_id, n.node_type, t.node_id IS NOT NULL AS hit FROM {results} r LEFT JOIN truth t USING (query_id, node_id) LEFT JOIN nodes n ON n.node_id = r.node_id) r GROUP BY 1),
{name} AS MATERIALIZED (SELECT q.query_id, {", ".join(f"coalesce(f.hit_at_{k}, 0e0) AS hit_at_{k}" for k in (1, 5, 10, 20))}, {", ".join(f"coalesce(f.n_{k} / g.c, 0e0) AS recall_at_{k}" for k in (1, 5, 10, 20))},
    coalesce(1e0 / f.first, 0e0) AS mrr, coalesce(f.types, 0) AS diversity_node_types, coalesce(f.n_20, 0) AS diversity_count, coalesce(f.n_20 / g.c, 0e0) AS dr_at_20, coalesce(g.c, 0) AS gt_count
  FROM queries q LEFT JOIN {name}_f f USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM truth GROUP BY 1) g USING (query_id))"""


NAMES = ["hit_at_1", "hit_at_5", "hit_at_10", "hit_at_20", "recall_at_1", "recall_at_5", "recall_at_10", "recall_at_20", "mrr", "diversity_node_types", "diversity_count", "dr_at_20"]


def stacked(source: str, names: list[str], keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in names)


def choice(values: list[str], *parts: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{draw(*parts)} % {len(values)} + 1]"


def between(low: int, high: int, *parts: str) -> str:
    return f"CAST({draw(*parts)} % {high - low + 1} + {low} AS INTEGER)"


def kb() -> str:
    return f"""docs AS MATERIALIZED (SELECT doc, 'doc_' || doc AS id, topic || ' ' || doc AS title, content, topic, coalesce(citations, 0) AS citations, coalesce(authors, 0) AS authors, year, relevance FROM
  (SELECT p_partkey AS doc, p_name AS content, {choice(TOPICS, "p_type", "'topic'")} AS topic, round(0.1e0 + 0.9e0 * (p_size - 1) / 49.0e0, 9) AS relevance FROM part)
  LEFT JOIN (SELECT l_partkey AS doc, count(*) AS citations, count(DISTINCT l_suppkey) AS authors, CAST(max(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY 1) USING (doc))"""


def typed_edges() -> str:
    flags = " ".join(f"WHEN '{flag}' THEN '{name}'" for flag, name in FLAGS.items())
    return f"""lines AS (SELECT DISTINCT l_orderkey, l_partkey AS src, CASE l_returnflag {flags} END AS relation FROM lineitem),
typed AS (SELECT a.src, b.dst, min(relation) AS relation FROM lines a JOIN (SELECT DISTINCT l_orderkey, l_partkey AS dst FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.src <> b.dst GROUP BY 1, 2)"""


def kb_questions(n: int, seed: int, years: tuple[int, int]) -> str:
    s, i = str(seed), "query_id"
    names = f"[{', '.join(repr(t) for t in TOPICS)}]"
    return f"""ask0 AS (SELECT query_id, {choice(["topic_year", "two_topic", "topic", "topic", "topic"], s, i, "'kind'")} AS kind, {draw(s, i, "'first'")} % {len(TOPICS)} AS a, {draw(s, i, "'second'")} % {len(TOPICS) - 1} + 1 AS b, {between(*years, s, i, "'after'")} AS after FROM (SELECT unnest(range({n})) AS query_id)),
ask AS MATERIALIZED (SELECT query_id, kind, {names}[a + 1] AS topic1, {names}[(a + b) % {len(TOPICS)} + 1] AS topic2, after FROM ask0)"""


def kb_truth(kind: str) -> str:
    on = {"two_topic": "d.topic IN (a.topic1, a.topic2)", "topic_year": "d.topic = a.topic1 AND d.year > a.after", "topic": "d.topic = a.topic1"}[kind]
    return f"SELECT query_id, node_id FROM (SELECT a.query_id, d.doc AS node_id, count(*) OVER (PARTITION BY a.query_id) AS c, row_number() OVER (PARTITION BY a.query_id ORDER BY d.doc) AS i FROM ask a JOIN docs d ON a.kind = '{kind}' AND {on} AND d.relevance > 0.6e0) WHERE c >= 2 AND i <= 10"


def kb_graph(seed: int, tries: int = 8) -> str:
    s, n = str(seed), "(SELECT count(*) FROM docs)"
    hubs = f"greatest(3, {n} // 50)"
    names = f"[{', '.join(repr(t) for t in TOPICS)}]"
    return f"""place AS (SELECT doc, topic, row_number() OVER (PARTITION BY topic ORDER BY doc) - 1 AS place FROM docs),
sizes AS (SELECT topic AS wanted, count(*) AS size FROM docs GROUP BY 1),
tries AS (SELECT doc, topic, {between(2, 6, s, "doc", "'degree'")} AS k, unnest(range({2 * tries})) AS t FROM docs),
aims AS (SELECT *, t < {tries} AS same, CASE WHEN t < {tries} THEN topic ELSE list_filter({names}, lambda x: x <> topic)[{draw(s, "doc", "t", "'other'")} % {len(TOPICS) - 1} + 1] END AS wanted FROM tries),
spots AS (SELECT a.*, {draw(s, "doc", "t", "'target'")} % size AS place FROM aims a JOIN sizes USING (wanted)),
hits AS (SELECT a.doc, p.doc AS dst, a.same, a.k, min(a.t) AS t FROM spots a JOIN place p ON p.topic = a.wanted AND p.place = a.place WHERE p.doc <> a.doc GROUP BY ALL),
kept AS (SELECT doc, dst FROM (SELECT *, row_number() OVER (PARTITION BY doc, same ORDER BY t) AS nth FROM hits) WHERE nth <= CASE WHEN same THEN k // 2 ELSE k - k // 2 END),
near AS (SELECT doc AS src, dst, {choice(RELATIONS, s, "doc", "dst", "'relation'")} AS relation, round(0.3e0 + 0.7e0 * {uniform(s, "doc", "dst", "'weight'")}, 9) AS weight FROM kept),
hubs AS (SELECT h, {draw(s, "h", "'hub'")} % {n} AS dst FROM (SELECT unnest(range({hubs})) AS h)),
far AS (SELECT d.doc AS src, h.dst FROM docs d JOIN hubs h ON h.h = {draw(s, "d.doc", "'which'")} % {hubs} WHERE {uniform(s, "d.doc", "'to_hub'")} > 0.7e0 AND d.doc NOT IN (SELECT dst FROM hubs) AND d.doc <> h.dst)
SELECT src, dst, relation, weight FROM near UNION ALL
SELECT src, dst, 'cites_hub', round(0.7e0 + 0.3e0 * {uniform(s, "src", "dst", "'hub_weight'")}, 9) FROM far WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.src = far.src AND near.dst = far.dst)"""
