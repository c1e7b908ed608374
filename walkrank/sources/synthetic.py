"""A knowledge base over the parts of a shop: documents, a directed graph drawn among them by counters, and questions with several answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkrank.functions.rng import draw, uniform
from walkrank.sources.graph import first_truths, read

#: Topics of documents. Fixed values.
TOPICS = ["machine learning", "quantum physics", "biochemistry", "climate science", "neuroscience", "economics", "astronomy", "genetics", "renewable energy", "cryptography"]
#: Relations of near documents, and what the flag of an order line stands for. Fixed values.
RELATIONS = ["cites", "related", "extends"]
#: Rows, or draws for them, that one task is given at about.
TASK_ROWS = 250_000
FLAGS = {"A": "cites", "R": "extends", "N": "related"}


def _choice(values: list[str], *parts) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(draw(*parts), F.lit(len(values))) + 1).cast("int"))


def _between(low: int, high: int, *parts) -> Column:
    return (F.pmod(draw(*parts), F.lit(high - low + 1)) + low).cast("int")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, topic) of the documents: what a graph among them is drawn from."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), _choice(TOPICS, F.col("p_type"), "topic").alias("topic"))


def _tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks rows are dealt to, so that what one holds doesn't grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def places(docs: DataFrame, n: int) -> DataFrame:
    """(doc, topic, place): places of a topic's documents in order of their keys, from 0. Ranges of keys are ranked each by itself and start at the counts of those before."""
    low, high = docs.agg(F.min("doc"), F.max("doc")).first()
    if low is None:
        return docs.select("doc", "topic", F.lit(0).cast("bigint").alias("place"))
    width = -(-(high - low + 1) // max(1, -(-n // TASK_ROWS)))
    dealt = docs.select("doc", "topic", F.floor((F.col("doc") - low) / width).alias("range"))
    counts = dealt.groupBy("topic", "range").agg(F.count("*").alias("c"))
    first = counts.select("topic", "range", (F.sum("c").over(Window.partitionBy("topic").orderBy("range")) - F.col("c")).alias("first"))
    own = F.row_number().over(Window.partitionBy("topic", "range").orderBy("doc")) - 1
    return dealt.withColumn("own", own).join(F.broadcast(first), ["topic", "range"]).select("doc", "topic", (F.col("first") + F.col("own")).alias("place"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, id, title, content, topic, citations, year, authors, relevance) of every part: its type gives the topic, its size the relevance, its order lines how often, by how many and until when it is cited."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc")).agg(F.count("*").alias("citations"), F.count_distinct("l_suppkey").alias("authors"), F.max(F.year("l_shipdate")).alias("year"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("content"), _choice(TOPICS, F.col("p_type"), "topic").alias("topic"), F.round(0.1 + 0.9 * (F.col("p_size") - 1) / 49.0, 9).alias("relevance"))
    rows = parts.join(lines, "doc", "left")
    i = F.col("doc").cast("string")
    return rows.select("doc", F.concat(F.lit("doc_"), i).alias("id"), F.concat("topic", F.lit(" "), i).alias("title"), "content", "topic", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("authors", F.lit(0)).alias("authors"), "year", "relevance")


def graph(docs: DataFrame, n: int, seed: int = 42, tries: int = 8) -> DataFrame:
    """(src, dst, relation, weight): 2 to 6 edges a document, half of them within its topic; three in ten also link to a hub.

    Targets are drawn, not sorted out of all documents: each of some tries
    draws a place among the documents of the topic (or of others), and the
    first different ones count, so the work is a few rows a document.
    """
    spark = docs.sparkSession
    place, tasks = places(docs, n), _tasks(spark, 2 * tries * n)
    sizes = docs.groupBy("topic").agg(F.count("*").alias("size"))
    own = docs.select("doc", "topic", _between(2, 6, seed, F.col("doc"), "degree").alias("k"))
    draws = own.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2 * tries - 1)))).withColumn("same", F.col("t") < tries)
    other = F.element_at(F.array_remove(F.array(*map(F.lit, TOPICS)), F.col("topic")), (F.pmod(draw(seed, F.col("doc"), F.col("t"), "other"), F.lit(len(TOPICS) - 1)) + 1).cast("int"))
    draws = draws.withColumn("wanted", F.when(F.col("same"), F.col("topic")).otherwise(other)).join(F.broadcast(sizes.withColumnRenamed("topic", "wanted")), "wanted")
    draws = draws.withColumn("place", F.pmod(draw(seed, F.col("doc"), F.col("t"), "target"), F.col("size")).cast("int"))
    spots = place.select(F.col("doc").alias("dst"), F.col("topic").alias("wanted"), F.col("place").cast("int").alias("place")).repartition(tasks, "wanted", "place")
    hits = draws.repartition(tasks, "wanted", "place").join(spots, ["wanted", "place"]).where("dst <> doc")
    hits = hits.repartition(tasks, "doc", "same").groupBy("doc", "dst", "same", "k").agg(F.min("t").alias("t"))
    nth = F.row_number().over(Window.partitionBy("doc", "same").orderBy("t"))
    hits = hits.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("same"), F.floor(F.col("k") / 2)).otherwise(F.col("k") - F.floor(F.col("k") / 2)))
    near = hits.select(F.col("doc").alias("src"), "dst", _choice(RELATIONS, seed, F.col("doc"), F.col("dst"), "relation").alias("relation"), F.round(0.3 + 0.7 * uniform(seed, F.col("doc"), F.col("dst"), "weight"), 9).alias("weight"))
    n_hubs = max(3, n // 50)
    hubs = spark.range(n_hubs).select(F.col("id").alias("h"), F.pmod(draw(seed, F.col("id"), "hub"), F.lit(n)).alias("dst"))
    to_hub = docs.where(uniform(seed, F.col("doc"), "to_hub") > 0.7).select(F.col("doc").alias("src"), F.pmod(draw(seed, F.col("doc"), "which"), F.lit(n_hubs)).alias("h"))
    far = to_hub.join(hubs, "h").join(hubs.select(F.col("dst").alias("src")), "src", "left_anti").where("src <> dst")
    far = far.select("src", "dst", F.lit("cites_hub").alias("relation"), F.round(0.7 + 0.3 * uniform(seed, F.col("src"), F.col("dst"), "hub_weight"), 9).alias("weight"))
    return near.unionByName(far.join(near.select("src", "dst"), ["src", "dst"], "left_anti"))


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation): parts of one order, each with the others; the first relation by name that a line of the source has."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), "l_returnflag")
    tasks, names = _tasks(spark, lines.count()), sorted(FLAGS.values())
    relation = F.lit(None).cast("int")  # its place by name: the least of numbers is found by hashing, that of names by sorting
    for flag, name in FLAGS.items():
        relation = F.when(F.col("l_returnflag") == flag, names.index(name)).otherwise(relation)
    lines = lines.select("l_orderkey", "part", relation.alias("relation")).repartition(tasks, "l_orderkey")
    a = lines.withColumnRenamed("part", "src").distinct()
    b = lines.select("l_orderkey", F.col("part").alias("dst")).distinct()
    pairs = a.join(b, "l_orderkey").where("src <> dst").select("src", "dst", "relation").repartition(2 * tasks, "src", "dst")
    least = pairs.groupBy("src", "dst").agg(F.min("relation").alias("relation"))
    return least.withColumn("relation", F.get(F.array(*map(F.lit, names)), F.col("relation")))


def truth_two_topics(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """For questions(query_id, topic1, topic2): good documents of either topic."""
    asked = questions.select("query_id", F.explode(F.array_distinct(F.array("topic1", "topic2"))).alias("topic"))
    return _truth(docs, asked)


def truth_topic_year(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """For questions(query_id, topic, after): good documents of the topic from later years."""
    return _truth(docs, questions, F.col("year") > F.col("after"))


def truth_topic(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """For questions(query_id, topic): good documents of the topic."""
    return _truth(docs, questions)


def _truth(docs: DataFrame, asked: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = docs.where("relevance > 0.6").join(asked, "topic")
    rows = rows if condition is None else rows.where(condition)
    return first_truths(rows.select("query_id", F.col("doc").alias("node_id")))


def questions(spark: SparkSession, n: int = 50, seed: int = 42, years: tuple[int, int] = (2018, 2023)) -> DataFrame:
    """(query_id, kind, text, topic, topic1, topic2, after): kinds two_topic, topic_year and topic."""
    i = F.col("query_id")
    rows = spark.range(n).withColumnRenamed("id", "query_id").withColumn("kind", _choice(["topic_year", "two_topic", "topic", "topic", "topic"], seed, i, "kind"))
    first, step = F.pmod(draw(seed, i, "first"), F.lit(len(TOPICS))), F.pmod(draw(seed, i, "second"), F.lit(len(TOPICS) - 1)) + 1
    names = F.array(*map(F.lit, TOPICS))
    rows = rows.withColumn("topic1", F.element_at(names, (first + 1).cast("int"))).withColumn("topic2", F.element_at(names, (F.pmod(first + step, F.lit(len(TOPICS))) + 1).cast("int"))).withColumn("topic", F.col("topic1")).withColumn("after", _between(*years, seed, i, "after"))
    text = F.when(F.col("kind") == "two_topic", F.concat_ws(" ", "topic1", "topic2")).when(F.col("kind") == "topic_year", F.concat_ws(" ", "topic", F.col("after").cast("string"))).otherwise(F.col("topic"))
    return rows.withColumn("text", text)
