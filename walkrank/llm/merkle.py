"""Merkle trees over a table's rows: a tree for each group, one over their tops, and proofs that fold a row's digest up to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkrank.llm.scratch import Scratch, small

ARITY = 16
#: Levels that a frontier's reshuffle brings together: ARITY^3 nodes and what is above them.
REACH = 3
#: Id of the tree over the tops of the others.
UPPER = -1

_NODES = "partial boolean, tree bigint, n bigint, level int, idx bigint, top boolean, digest string, places array<int>, children array<string>"
_ROW_BITS = 33  # of monotonically_increasing_id, those that count rows within a partition


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the values one after the other: - for null, else the UTF-8 byte count, a colon and the value."""
    told = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*map(told, columns)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda own, run: F.sha2(F.concat(run["before"], own, run["after"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def size_at(n: int, level: int, arity: int) -> int:
    """Nodes of a tree of n leaves at a level."""
    for _ in range(level):
        n = -(-n // arity)
    return n


class Parents:
    """Combiners of one tree: partial parents that hold indexed digests of their children. A child's arrival completes its parent once the arity that follows from the tree's size is met; the parent then arrives at its own."""

    def __init__(self, tree: int, n: int, arity: int):
        self.tree, self.n, self.arity = tree, n, arity
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.size = [n]
        while self.size[-1] > 1:
            self.size.append(-(-self.size[-1] // arity))

    def arrive(self, level: int, idx: int, digest: str) -> Iterator[tuple]:
        """Nodes that become whole."""
        while self.size[level] > 1:
            parent, place = divmod(idx, self.arity)
            held = self.open.setdefault((level + 1, parent), {})
            held[place] = digest
            if len(held) < min(self.arity, self.size[level] - parent * self.arity):
                return
            del self.open[level + 1, parent]
            children = [held[i] for i in range(len(held))]
            level, idx, digest = level + 1, parent, hashlib.sha256("".join(children).encode()).hexdigest()
            yield (False, self.tree, self.n, level, idx, self.size[level] == 1, digest, [], children)

    def merge(self, level: int, idx: int, places: list[int], digests: list[str]) -> Iterator[tuple]:
        """Nodes that become whole with the children of another partial parent."""
        for place, digest in zip(places, digests, strict=True):
            yield from self.arrive(level - 1, idx * self.arity + place, digest)

    def frontier(self) -> Iterator[tuple]:
        for (level, idx), held in self.open.items():
            places = sorted(held)
            yield (True, self.tree, self.n, level, idx, False, None, places, [held[i] for i in places])


def _combine(arity: int, leaves: bool):
    """Whole nodes of a partition's rows, and the partial parents that wait for other partitions. Rows come in order of their trees."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
        names = ["partial", "tree", "n", "level", "idx", "top", "digest", "places", "children"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        now: Parents | None = None
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (("tree", "n", "idx", "leaf") if leaves else ("tree", "n", "level", "idx", "places", "children"))]
            for tree, n, *rest in zip(*columns, strict=True):
                if now is None or now.tree != tree:
                    out += now.frontier() if now else ()
                    now = Parents(tree, n, arity)
                out += now.arrive(0, *rest) if leaves else now.merge(*rest)
                if len(out) >= 4096:
                    yield table(out)
                    out = []
        out += now.frontier() if now else ()
        yield table(out)

    return run


def grow(scratch: Scratch, leaves: DataFrame, name: str, held: int, arity: int = ARITY) -> DataFrame:
    """(tree, n, level, idx, top, digest, children) of all nodes above leaves(tree, n, idx, leaf), of which a task has some ``held`` that follow each other.

    Partitions resolve what they hold; only frontiers, some rows a partition
    and level, are dealt out again, by an ancestor over ARITY^REACH partitions,
    and that far up again while some wait.
    """
    done, again, at, reach = [], leaves.select("tree", "n", "idx", "leaf"), 0, 1
    while arity**reach < held:
        reach += 1
    while True:
        got = again.mapInArrow(_combine(arity, at == 0), _NODES)
        rows, seen = scratch.measured(got, f"{name}-{at}", waiting=F.count_if("partial"))
        done.append(rows.where("NOT partial").drop("partial", "places"))
        if not seen["waiting"]:
            break
        at, reach = at + 1, reach + REACH
        waiting = rows.where("partial").select("tree", "n", "level", "idx", "places", "children")
        up = F.floor(F.col("idx") / F.pow(F.lit(float(arity)), F.greatest(F.lit(0), F.lit(reach) - F.col("level")))).cast("bigint")
        again = waiting.withColumn("up", up).repartition("tree", "up").sortWithinPartitions("tree", "level", "idx").drop("up")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def placed(scratch: Scratch, rows: DataFrame, name: str, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame, dict]:
    """rows in order, saved, with ``part`` and ``at``, their place in a task; where each group starts in a task: (group, part, first, before, n); and of these the number and the most rows of one.

    A sort over ranges of (group, order): one large group spans as many tasks
    as its rows need. Equal rows are told apart by where they were read.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [group, *order, "__read"]
    dealt = rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__read")
    dealt = scratch.save(dealt.withColumn("__number", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("part", F.shiftright("__number", _ROW_BITS)).withColumn("at", F.col("__number").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__number")
    # a row a group and task: a window over a group's tasks
    starts = dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    over = Window.partitionBy(group)
    starts = starts.withColumn("n", F.sum("c").over(over)).withColumn("before", F.sum("c").over(over.orderBy("part")) - F.col("c"))
    starts, seen = scratch.measured(starts, f"{name}-starts", n=F.count("*"), most=F.max("c"))
    return dealt, starts, seen


@dataclass(frozen=True)
class Manifest:
    """leaves(row, a struct of the kept columns, tree, n, idx, leaf), nodes(tree, n, level, idx, top, digest, children), and the trees(tree, name, n) in order; the root, null without rows."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    arity: int = ARITY

    def write(self, folder: str) -> None:
        """The manifest's tables, and one row of its root and arity last: a folder without that is not whole."""
        for f in ("leaves", "nodes", "trees"):
            getattr(self, f).write.mode("overwrite").parquet(f"{folder}/{f}")
        self.leaves.sparkSession.createDataFrame([(self.root, self.arity)], "root string, arity int").write.mode("overwrite").parquet(f"{folder}/root")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Manifest:
        tables = {f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Manifest) if f.name not in ("root", "arity")}
        return Manifest(**tables, **spark.read.parquet(f"{folder}/root").first().asDict())


def build(frame: DataFrame, leaf: Column, key: str = "doc_id", group: str = "source", keep: Sequence[str] | None = None, arity: int = ARITY) -> Manifest:
    """A tree for each value of ``group`` (null first, then by UTF-8 bytes), whose leaves ascend by ``key`` (null first; ties by digest), and one over their tops.

    While a level has several nodes, every ``arity`` consecutive ones, the last
    run fewer or one, become the sha256 of their digests; a lone leaf is its
    tree's top. Texts are hashed where they are read: only digests, keys and
    the columns of ``keep`` (the key) move, these in a struct, so that no name
    clashes. Repeated rows are leaves of their own; an empty table has no root.
    """
    scratch = Scratch(frame.sparkSession, "merkle")
    name = F.col(f"`{group}`").cast("string")
    # null sorts before all names
    rows = frame.select(F.struct(*(F.col(f"`{c}`") for c in keep or [key])).alias("row"), F.col(f"`{key}`").alias("__key"), F.when(name.isNull(), "-").otherwise(F.concat(F.lit("="), name)).alias("__name"), leaf.alias("leaf"))
    rows, starts, of = placed(scratch, scratch.save(rows, "digests"), "ordered", "__name", ["__key", "leaf"])
    # trees are numbered in order of their names
    names, at, by = placed(scratch, starts.select("__name", "n").distinct().withColumn("__all", F.lit(0)), "names", "__all", ["__name"])
    trees = names.join(small(at.select("part", "first", "before"), by["n"]), "part").select((F.col("at") - F.col("first") + F.col("before")).alias("tree"), "__name", "n")
    trees, seen = scratch.measured(trees, "trees", n=F.count("*"))
    starts = starts.drop("n").join(small(trees, seen["n"]), "__name")
    rows = rows.join(small(starts, of["n"]), ["__name", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before"))
    leaves = scratch.save(rows.select("row", "tree", "n", "idx", "leaf"), "leaves")
    nodes = grow(scratch, leaves, "nodes", of["most"] or 0, arity)
    tops = nodes.where("top").select("tree", F.col("digest").alias("leaf")).unionByName(leaves.where("n = 1").select("tree", "leaf"))
    tops = scratch.save(tops.select(F.lit(UPPER).cast("bigint").alias("tree"), F.lit(seen["n"]).cast("bigint").alias("n"), F.col("tree").alias("idx"), "leaf"), "tops")
    upper = grow(scratch, tops, "upper", by["most"] or 0, arity)
    root = (upper.where("top").select("digest") if seen["n"] > 1 else tops.select("leaf")).first()
    trees = trees.select("tree", F.when(F.col("__name") != "-", F.substring("__name", 2, 1 << 30)).alias("name"), "n")
    return Manifest(leaves, nodes.unionByName(upper), trees, root[0] if root else None, arity)


def _step(run: Column, place: Column) -> Column:
    """What stands to the left and to the right of a place in a run of digests."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("before"), F.array_join(F.slice(run, place + 2, F.size(run)), "").alias("after"))


def _linked(rows: DataFrame, links: DataFrame, tops: DataFrame, arity: int) -> DataFrame:
    """rows(tree, idx, ...) with path and subroot, from links(tree, idx, children, path, subroot), their parents, of which each has ``arity`` rows at most, and for a tree whose top they are from tops(tree, path, subroot)."""
    up = links.select("tree", F.col("idx").alias("__up"), F.col("children").alias("__run"), "path", "subroot")
    own = tops.select("tree", F.lit(0).cast("bigint").alias("__up"), F.lit(None).cast("array<string>").alias("__run"), "path", "subroot")
    rows = rows.withColumn("__up", F.floor(F.col("idx") / arity)).join(up.unionByName(own), ["tree", "__up"])
    step = _step(F.col("__run"), (F.col("idx") % arity).cast("int"))
    return rows.withColumn("path", F.when(F.col("__run").isNull(), F.col("path")).otherwise(F.concat(F.array(step), "path"))).drop("__up", "__run")


def _down(scratch: Scratch, nodes: DataFrame, tops: DataFrame, depth: int, name: str, arity: int) -> DataFrame:
    """links(tree, idx, children, path, subroot) of the lowest nodes, for tops(tree, level, path, subroot): level by level from the tops, by reverse links."""
    links = nodes.select("tree", "idx", "children").where("false").join(tops, "tree").drop("level")
    for level in range(depth, 0, -1):
        here = nodes.where(F.col("level") == level).select("tree", "idx", "children")
        links = scratch.save(_linked(here, links, tops.where(F.col("level") == level), arity), f"{name}-{level}")
    return links


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves (their row, leaf, ...) with subroot, root and path: array of (before, after), the siblings of each level up to the root, digests one after the other. A path's length follows from the number of rows, not its size from any group's."""
    m, arity = manifest, manifest.arity
    scratch = Scratch(m.leaves.sparkSession, "proofs")
    upper, lower = m.nodes.where(F.col("tree") == UPPER), m.nodes.where(F.col("tree") != UPPER)
    none = F.array().cast("array<struct<before:string,after:string>>")
    depth = {r["up"]: r["level"] for r in m.nodes.groupBy((F.col("tree") == UPPER).alias("up")).agg(F.max("level").alias("level")).collect()}  # two rows
    tops = lower.where("top").select("tree", "level", F.col("digest").alias("subroot")).unionByName(m.leaves.where("n = 1").select("tree", F.lit(0).alias("level"), F.col("leaf").alias("subroot")))
    # a tree's top is a leaf of the upper tree
    first = upper.where("top").select("tree", "level", none.alias("path"), "digest") if True in depth else tops.select(F.lit(UPPER).cast("bigint").alias("tree"), F.lit(0).alias("level"), none.alias("path"), F.col("subroot").alias("digest"))
    first = first.withColumnRenamed("digest", "subroot")
    rows = tops.select(F.lit(UPPER).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "level", F.col("subroot").alias("own"))
    rows = _linked(rows, _down(scratch, upper, first, depth.get(True, 0), "upper", arity), first.where("level = 0"), arity)
    tops = scratch.save(rows.select(F.col("idx").alias("tree"), "level", "path", F.col("own").alias("subroot")), "tops")
    links = _down(scratch, lower, tops, depth.get(False, 0), "links", arity)
    return _linked(m.leaves, links, tops.where("level = 0"), arity).withColumn("root", F.lit(m.root).cast("string"))
