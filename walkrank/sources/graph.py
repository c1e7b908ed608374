"""Tables of a retrieval graph, loaders and sinks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkrank.functions.vectors import norm
from walkrank.scratch import Folders, Scratch, released
from walkrank.store import Store, bucket_folder, read_buckets, write_buckets

#: Every row whose id this divides is a query.
QUERY_EVERY = 100
#: Edges of a node that stand together in a task; those of a hub are dealt to as many slots as it needs.
SLOT_EDGES = 10_000
#: Rows of a kept table in a bucket.
BUCKET_ROWS = 2_000_000
#: Nodes of several slots that are sent to every task at most; more are joined.
SENT_HUBS = 100_000
#: Nodes whose ids are sent to all that read order lines, at most; with more, the lines are shuffled.
SENT_IDS = 1_000_000


def _place(node: str, slot) -> Column:
    """Where some edges of a node stand."""
    return F.xxhash64(F.col(node), slot)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node_id")


def _placed(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """The edges with place: one a node, but for hubs, whose edges are dealt to slots by what they lead to."""
    hubs = degree.where(F.col("degree") > SLOT_EDGES).select(F.col("node_id").alias("src"), F.ceil(F.col("degree") / SLOT_EDGES).alias("__slots"))
    slot = F.when(F.col("__slots").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("__slots"))).cast("int")
    return edges.join(hubs, "src", "left").select("src", "dst", _place("src", slot).alias("place"))


@dataclass(frozen=True)
class Graph:
    """nodes(node_id, vec, node_type, relevance; ``of`` adds size, the vector's norm), edges(src, dst, place), members(node_id), degree(node_id, degree). ``avg_degree`` is the mean over nodes with edges."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    degree: DataFrame
    avg_degree: DataFrame
    whole: DataFrame | None = None

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None, degree: DataFrame | None = None) -> Graph:
        degree = degrees(edges) if degree is None else degree
        members = edges.select(F.col("src").alias("node_id")).distinct() if members is None else members
        nodes = nodes if "size" in nodes.columns or "vec" not in nodes.columns else nodes.withColumn("size", norm("vec"))
        return Graph(nodes, _placed(edges.select("src", "dst"), degree), members, degree, degree.agg(F.avg("degree").alias("avg_degree")))

    def hops(self, at: DataFrame, outer: bool = False) -> DataFrame:
        """at(node_id, ...) with each dst it leads to. A hub's rows are joined slot by slot, so its edges meet those that stand there in as many tasks as they need."""
        slot, own = F.lit(0), at.columns
        if self._hubs:
            hubs = self.degree.where(F.col("degree") > SLOT_EDGES).select("node_id", F.ceil(F.col("degree") / SLOT_EDGES).cast("int").alias("__slots"))
            rows = at.join(F.broadcast(hubs) if self._hubs <= SENT_HUBS else hubs, "node_id", "left")
            at, slot = rows.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce("__slots", F.lit(1)) - 1))).drop("__slots"), F.col("__slot")
        # places are the only key, so that kept edges don't move; the difference tells nodes of one place apart
        met = (F.col("__place") == F.col("place")) & (F.col("node_id") - F.col("src") == 0)
        return at.withColumn("__place", _place("node_id", slot)).join(self.edges, met, "left" if outer else "inner").select(*own, "dst")

    @cached_property
    def _hubs(self) -> int:
        return self.degree.where(F.col("degree") > SLOT_EDGES).count()

    def kept(self) -> Graph:
        """The same graph with its tables cached for a session: every step of a walk reads them."""
        nodes, edges = self.nodes.persist(), self.edges.persist()
        degree = edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node_id").persist()
        return Graph(nodes, edges, self.members.persist(), degree, degree.agg(F.avg("degree").alias("avg_degree")).persist())

    def release(self) -> None:
        """Ends the caching of its own tables."""
        for frame in (self.nodes, self.edges, self.members, self.degree, self.avg_degree):
            frame.unpersist()

    def traits(self) -> DataFrame:
        """node_id, vec, size, relevance, degree (0 without edges), avg_degree."""
        if self.whole is not None:
            return self.whole
        mean = F.broadcast(self.avg_degree)  # one row
        return self.nodes.join(self.degree, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).join(mean)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as nodes; relevance from the part of the same key, null without one."""
    nodes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"), "label", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("node_type"))
    relevance = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.lit(0.1) + F.lit(0.9) * (F.col("p_size") - 1) / F.lit(49.0)).alias("relevance"))
    return nodes.join(relevance, "node_id", "left")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each part that is a node."""
    ids = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("part"))
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(ids, "part", "left_semi").distinct()


def load_edges(spark: SparkSession, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Parts of one order are neighbours, in both directions. Orders are keys of a few rows, so the self-join stays linear. With ``scratch``, steps are written, so that shuffle files of one go before the next."""
    lines = _lines(spark, sf_dir)
    lines = scratch.save(lines, "lines") if scratch else lines
    a, b = lines.withColumnRenamed("part", "src"), lines.withColumnRenamed("part", "dst")
    edges = a.join(b, "l_orderkey").where("src <> dst").select("src", "dst").distinct()
    return scratch.save(edges, "edges") if scratch else edges


def sources(sf_dir: str) -> list[str]:
    """What a graph of these tables, and any run over it, is made from."""
    return [f"{sf_dir}/{name}.parquet" for name in ("embeddings", "lineitem", "part")]


def graph_folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the kept graph of these tables is; it is built anew once a file of them has changed."""

    def write(folder: str) -> None:
        with Folders(spark), released(spark):
            scratch = Scratch(spark, "edges")
            edges = load_edges(spark, sf_dir, scratch)
            scratch.drop("lines")
            write_graph(Graph.of(load_nodes(spark, sf_dir), edges, degree=scratch.save(degrees(edges), "degree")), folder)

    return Store(spark).entry("graph", {"slot_edges": SLOT_EDGES}, sources(sf_dir), write)


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's tables, from the store."""
    return read_graph(spark, graph_folder(spark, sf_dir))


def kept_folder(spark: SparkSession, folder: str, name: str) -> str:
    """The files of one table of a kept graph."""
    return bucket_folder(spark, folder, name)[0]


def write_graph(graph: Graph, folder: str) -> None:
    """Nodes with all their traits in buckets of their ids, edges in those of their places: neither moves in a hop."""
    spark = graph.nodes.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with released(spark):
        n_edges = graph.degree.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
        for name, frame, rows, keys in (("nodes", graph.traits(), graph.nodes.count(), ["node_id"]), ("edges", graph.edges, n_edges, ["place"])):
            write_buckets(frame, folder, name, max(n, -(-rows // BUCKET_ROWS)), *keys)
        graph.degree.write.parquet(f"{folder}/degree")
        graph.avg_degree.write.parquet(f"{folder}/avg_degree")


def read_graph(spark: SparkSession, folder: str) -> Graph:
    nodes, edges = read_buckets(spark, folder, "nodes", "node_id"), read_buckets(spark, folder, "edges", "place")
    degree = spark.read.parquet(f"{folder}/degree")
    return Graph(nodes.drop("degree", "avg_degree"), edges, degree.select("node_id"), degree, spark.read.parquet(f"{folder}/avg_degree"), nodes)


def load_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_nodes(spark, sf_dir).where(F.col("node_id") % QUERY_EVERY == 0).select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))


def load_truth(spark: SparkSession, sf_dir: str, most: int = 10, least: int = 2) -> DataFrame:
    """(query_id, node_id): nodes of the query's label with relevance over 0.6, the first ``most`` by id, of queries with ``least`` at least."""
    nodes = load_nodes(spark, sf_dir)
    asked = nodes.where(F.col("node_id") % QUERY_EVERY == 0).select(F.col("node_id").alias("query_id"), "label")
    # of a label only the first nodes can be truths, one more should a query be among them: few rows meet the queries
    by_label = F.row_number().over(Window.partitionBy("label").orderBy("node_id"))
    first = nodes.where("relevance > 0.6").select("label", "node_id").withColumn("i", by_label).where(F.col("i") <= max(most, least) + 1)
    return first_truths(first.join(asked, "label").where("node_id <> query_id").select("query_id", "node_id"), most, least)


def first_truths(found: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """The first ``most`` nodes of each query in order of their ids, of queries with ``least`` at least."""
    by_query = Window.partitionBy("query_id")
    found = found.withColumn("n", F.count("*").over(by_query)).withColumn("i", F.row_number().over(by_query.orderBy("node_id")))
    return found.where((F.col("n") >= least) & (F.col("i") <= most)).select("query_id", "node_id")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, nbrs, degree): a node's neighbours in one row, for stores that want them so; degree counts the list."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")).withColumn("degree", F.size("nbrs"))


def adjacency_blocks(graph: Graph) -> DataFrame:
    """(node_id, block, nbrs, blocks): a node's neighbours in lists of some SLOT_EDGES, dealt by a hash: a hub has as many as it needs, other nodes one."""
    hubs = graph.degree.where(F.col("degree") > SLOT_EDGES).select("node_id", F.ceil(F.col("degree") / SLOT_EDGES).alias("blocks"))
    rows = graph.edges.select(F.col("src").alias("node_id"), "dst").join(hubs, "node_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int"))
    return rows.groupBy("node_id", "block").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"), F.first("blocks").alias("blocks"))


def degree_stats(degree: DataFrame) -> DataFrame:
    """min, max, mean and the upper median of degrees, from their counts: no sort of all nodes."""
    counts = degree.groupBy("degree").agg(F.count("*").alias("c"))
    order = Window.orderBy("degree")  # as many rows as there are different degrees
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("degree")))
    return ranked.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.sum(F.col("degree") * F.col("c")) / F.sum("c"), 6).alias("mean_degree"), middle.alias("median_degree"))


def write_csv(frame: DataFrame, path: str) -> None:
    """One headered file: for reports, which are small."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_table(frame: DataFrame, path: str) -> DataFrame:
    """Parquet, read again: a kept adjacency or any table that later jobs share."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def split_questions(frame: DataFrame, human: bool = False) -> DataFrame:
    """Questions of one split: written by people, or synthetic."""
    return frame.where(F.col("human") == F.lit(human))
