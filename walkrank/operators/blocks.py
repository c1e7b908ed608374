"""Expected walks of many queries over most of a graph, as products of blocks: a block of edges meets a vector of masses a query, not a row an edge and query.

With w the weights of a query's nodes, A the edges and W = A w, masses of a
step are w * A'(m / W), and visits up to step k are S(k) = m(0) + w * A'(S(k-1) / W).
So one vector a query and block of nodes is written a step, and the last is the visits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.operators.search import cosines
from walkrank.scratch import Scratch, bounded, released
from walkrank.sources.graph import SENT_IDS, Graph

#: Nodes of a block at about, edges of a packed row, and of a cell of two blocks.
NODES, EDGES, CELL_EDGES = 60_000, 1 << 20, 1 << 22
#: Queries of a block: as few as make so many cells, within these.
LEAST_QUERIES, MOST_QUERIES, CELLS = 16, 128, 32
#: Of walks in which nodes alone weigh edges: edges of a row, and bytes of vectors of all nodes that a task holds at about.
ROW_EDGES, VECTORS = 1 << 16, 256 << 20
#: Of walks by weights that queries have of their own: nodes of a row, bytes of a query's vectors a node, and bytes of the vectors of all queries up to which these are shuffled, as products of blocks.
ROW_NODES, PER_NODE, FEW = 4096, 40, 64 << 20
#: Of walks whose edges a task holds: places of a block of nodes that edges start from, so that a place in it has 2 bytes.
SOURCES = 1 << 16
#: Nodes of an island of several parts at about, and queries that a task walks for at a time.
ISLAND, TOGETHER = 1 << 14, 32
#: Edges to one node in a row from which on they are summed by themselves, and how many of these at a time.
LONG, PIECE = 1024, 4096
_STATE = "qb int, query_id bigint, nb int, at binary, x binary"
_ROW = ("qb", "ob", "seq", "kind", "query_id", "a", "b", "c")
_PARTS, _KNOWN, _OWN = 1, 2, 3
#: Rows that come by a task: nodes, edges against their direction or, in walks by nodes alone, along it, and along it; and what is sent of them on.
_STREAM = "kind int, nb int, a binary, b binary, c binary"
_PAIRS, _STARTS, _EDGES = 0, 1, 2
_STEP, _BACK = 1, 2


def worth(graph: Graph, starts: int, steps: int) -> bool:
    """Whether a query's hops, as rows, would be more than a fraction of all edges."""
    row = graph.degree.agg(F.sum("degree").alias("edges"), F.avg("degree").alias("mean")).first()
    return bool(row["edges"]) and starts * max(1.0, row["mean"]) ** steps > row["edges"] / 8


def _floats(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.float64)


def _places(value: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind).astype(np.intp)


def _encoded(x: np.ndarray) -> tuple[bytes | None, bytes]:
    """Places and values of what isn't 0, or the whole if that is shorter."""
    at = np.flatnonzero(x)
    return (at.astype(np.int32).tobytes(), x[at].tobytes()) if 12 * len(at) < 8 * len(x) else (None, x.tobytes())


def _decoded(at: pa.Scalar, x: pa.Scalar, size: int) -> np.ndarray:
    if not at.is_valid:
        return _floats(x)
    out = np.zeros(size)
    out[_places(at)] = _floats(x)
    return out


def _one(schema: T.StructType, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[f.dataType.simpleString()]) for f, v in zip(schema.fields, values, strict=True)], names=schema.names)


class Blocks:
    """Nodes dealt to blocks by a hash, each with a place in its block, and the edges between two blocks as packed rows; p is an edge's factor, 1 without one."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, scratch: Scratch, n_queries: int):
        bounded(scratch.spark)
        self.scratch, n_edges = scratch, edges.count()
        self.n = max(1, -(-nodes.count() // NODES), math.ceil(math.sqrt(n_edges / CELL_EDGES)))
        self.n_queries = max(1, -(-n_queries // MOST_QUERIES), min(-(-n_queries // LEAST_QUERIES), -(-CELLS // self.n)))
        place = F.row_number().over(Window.partitionBy("nb").orderBy("node_id")) - 1
        index = nodes.select("node_id", F.pmod(F.xxhash64("node_id"), F.lit(self.n)).cast("int").alias("nb")).withColumn("pos", place)
        self.index = scratch.save(index, "index")
        self.size = self.index.agg(F.max("pos")).first()[0] + 1
        self.kind = kind = np.uint16 if self.size <= 1 << 16 else np.int32  # of an edge's ends: they go to every block of queries
        src, dst = (self.index.select(F.col("node_id").alias(k), F.col("nb").alias(f"{k}_block"), F.col("pos").alias(f"{k}_at")) for k in ("src", "dst"))
        edges = edges if "p" in edges.columns else edges.withColumn("p", F.lit(None).cast("double"))
        chunk = F.pmod(F.xxhash64("src", "dst"), F.lit(-(-n_edges // (self.n**2 * EDGES)) or 1)).alias("chunk")
        rows = edges.join(src, "src").join(dst, "dst").select("src_block", "dst_block", chunk, "src_at", "dst_at", "p")
        schema = T._parse_datatype_string("src_block int, dst_block int, src_at binary, dst_at binary, p binary")

        def packed(rows: pa.Table) -> pa.Table:
            a, b, p = (rows[c].to_numpy() for c in ("src_at", "dst_at", "p"))
            order = np.lexsort((a, b))
            factor = None if rows["p"].null_count else p[order].astype(np.float64).tobytes()
            return pa.Table.from_batches([_one(schema, rows["src_block"][0].as_py(), rows["dst_block"][0].as_py(), a[order].astype(kind).tobytes(), b[order].astype(kind).tobytes(), factor)])

        self.edges = scratch.save(rows.groupBy("src_block", "dst_block", "chunk").applyInArrow(packed, schema), "edge-blocks")

    def query_block(self) -> Column:
        return F.pmod(F.xxhash64("query_id"), F.lit(self.n_queries)).cast("int").alias("qb")

    def masses(self, at: DataFrame) -> DataFrame:
        """at(query_id, node_id, mass) as states: sparse vectors, of the blocks that have any."""
        schema = T._parse_datatype_string(_STATE)

        def packed(rows: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_one(schema, rows["qb"][0].as_py(), rows["query_id"][0].as_py(), rows["nb"][0].as_py(), rows["pos"].to_numpy().astype(np.int32).tobytes(), rows["mass"].to_numpy().astype(np.float64).tobytes())])

        rows = at.join(self.index, "node_id").select(self.query_block(), "query_id", "nb", "pos", "mass")
        return self.scratch.save(rows.groupBy("qb", "query_id", "nb").applyInArrow(packed, schema), "masses")

    def _cells(self, rows: DataFrame, *order: str) -> DataFrame:
        """Rows of a cell together, in order."""
        return rows.repartition(min(2000, 4 * self.n * self.n_queries), *order[:2]).sortWithinPartitions(*order)

    def _each(self, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def weights(self, queries: DataFrame, nodes: DataFrame, keep: list[str], weight: Column) -> DataFrame:
        """(qb, query_id, nb, w, cos), of every query and block the weights of its nodes and their cosines, NaN for none. ``weight`` reads ``keep``, which nodes(node_id, vec, ...) have, and query_id, node_id and cos, without pheromones."""
        q = queries.select(self.query_block(), self._each(self.n).alias("nb"), F.lit(1).alias("kind"), F.lit(0).alias("pos"), "query_id", F.col("qvec").alias("vec"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("node_id", *keep)))
        r = nodes.join(self.index, "node_id").select(self._each(self.n_queries).alias("qb"), "nb", F.lit(0).alias("kind"), "pos", F.lit(None).cast("bigint").alias("query_id"), "vec", "node_id", *keep)
        own = ["qb", "nb", "pos", "query_id", "node_id", *keep]
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in (r.schema[c] for c in own)), T.StructField("cos", T.DoubleType())])

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, block = None, []
            for whole in batches:
                keys = np.stack([whole.column(c).to_numpy() for c in ("qb", "nb", "kind")])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), whole.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    rows, (qb, nb, kind) = pa.Table.from_batches([whole.slice(lo, hi - lo)]), keys[:, lo].tolist()
                    if cell != (qb, nb):
                        cell, block = (qb, nb), []
                    if not kind:
                        block.append(rows)
                        continue
                    if len(block) > 1:
                        block = [pa.concat_tables(block).combine_chunks()]
                    for i in range(rows.num_rows if block else 0):
                        cos = cosines(rows["vec"].slice(i, 1), block[0]["vec"])
                        values = {c: block[0][c] for c in own} | {"query_id": pa.repeat(rows["query_id"][i], block[0].num_rows), "cos": pa.array(cos.data[0], mask=np.ma.getmaskarray(cos)[0])}
                        yield from pa.table([values[c] for c in schema.names], names=schema.names).to_batches()

        rows = self._cells(q.unionByName(r), "qb", "nb", "kind", "query_id", "pos").mapInArrow(pairs, schema)
        rows = rows.withColumn("pheromone", F.lit(0.0)).withColumn("max_pheromone", F.lit(1.0))
        rows = rows.select("qb", "query_id", "nb", "pos", weight.alias("w"), F.col("cos"))
        size, out = self.size, T._parse_datatype_string("qb int, query_id bigint, nb int, w binary, cos binary")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, w, cos = None, None, None
            for whole in batches:
                keys = np.stack([whole.column(c).to_numpy() for c in ("qb", "query_id", "nb")])
                pos, ws, cs = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "w", "cos"))
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), whole.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo < hi and (key := tuple(keys[:, lo].tolist())) != held:
                        if held:
                            yield _one(out, *held, w.tobytes(), cos.tobytes())
                        held, w, cos = key, np.zeros(size), np.full(size, np.nan)
                    w[pos[lo:hi]], cos[pos[lo:hi]] = ws[lo:hi], cs[lo:hi]
            if held:
                yield _one(out, *held, w.tobytes(), cos.tobytes())

        return self.scratch.save(rows.mapInArrow(packed, out), "weights")

    def spread(self, states: DataFrame, own: list[DataFrame], give: Callable, schema: str, back: bool = False, ids: bool = False) -> DataFrame:
        """The product of the edges (with ``back``, against their direction) with all states, given out with what each query and block has of its own.

        ``own`` are frames of (qb, query_id, nb, kind, a, b, c): of kind _KNOWN
        come before the one of kind _OWN, for which ``give`` (key, product,
        its own a, b, c, what is known, ids) makes a batch. A task holds one
        vector a query of its block, one cell of edges and one state.
        """
        at = ("dst", "src") if back else ("src", "dst")
        void = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = self.edges.select(self._each(self.n_queries).alias("qb"), F.col(f"{at[1]}_block").alias("ob"), F.col(f"{at[0]}_block").alias("seq"), F.lit(0).alias("kind"), void("bigint", "query_id"), F.col(f"{at[0]}_at").alias("a"), F.col(f"{at[1]}_at").alias("b"), F.col("p").alias("c"))
        rows = rows.unionByName(states.select("qb", self._each(self.n).alias("ob"), F.col("nb").alias("seq"), F.lit(_PARTS).alias("kind"), "query_id", F.col("at").alias("a"), F.col("x").alias("b"), void("binary", "c")))
        for frame in own:
            rows = rows.unionByName(frame.select("qb", F.col("nb").alias("ob"), F.lit(self.n).alias("seq"), "kind", "query_id", "a", "b", "c"))
        if ids:
            each = self.index.groupBy("nb").applyInArrow(_ids, "nb int, a binary")
            rows = rows.unionByName(each.select(self._each(self.n_queries).alias("qb"), F.col("nb").alias("ob"), F.lit(self.n).alias("seq"), F.lit(0).alias("kind"), void("bigint", "query_id"), "a", void("binary", "b"), void("binary", "c")))
        n, size, kind = self.n, self.size, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = part = names = None
            for batch in batches:
                qbs, obs, seqs, kinds = (batch.column(c).to_numpy() for c in _ROW[:4])
                queries, a, b, c = (batch.column(c) for c in _ROW[4:])
                for i in range(batch.num_rows):
                    if cell != (qbs[i], obs[i]):
                        cell, part, names, sums, known, edges = (qbs[i], obs[i]), -1, None, {}, {}, []
                    if part != seqs[i]:
                        part, edges = seqs[i], []
                    if kinds[i] == 0 and part == n:
                        names = np.frombuffer(a[i].as_buffer(), np.int64)
                    elif kinds[i] == 0:
                        edges.append((_places(a[i], kind), _places(b[i], kind), _floats(c[i]) if c[i].is_valid else None))
                    elif kinds[i] == _PARTS:
                        x, key = _decoded(a[i], b[i], size), queries[i].as_py()
                        for src, dst, p in edges:
                            got = np.bincount(dst, x[src] if p is None else x[src] * p, size)
                            sums[key] = sums[key] + got if key in sums else got
                    elif kinds[i] == _KNOWN:
                        known[queries[i].as_py()] = _decoded(a[i], b[i], size)
                    else:
                        key = queries[i].as_py()
                        y, m = sums.pop(key, None), known.pop(key, None)
                        yield from give((int(qbs[i]), key, int(obs[i])), np.zeros(size) if y is None else y, a[i], b[i], c[i], np.zeros(size) if m is None else m, names)

        return self._cells(rows.select(*_ROW), "qb", "ob", "seq", "kind", "query_id").mapInArrow(run, schema)


def _ids(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows["pos"].to_numpy())
    return pa.table({"nb": rows["nb"].slice(0, 1), "a": pa.array([rows["node_id"].to_numpy()[order].tobytes()], pa.binary())})


def _own(frame: DataFrame, kind: int, a: str | None = None, b: str | None = None, c: str | None = None) -> DataFrame:
    columns = ((F.lit(None).cast("binary") if x is None else F.col(x)).alias(name) for x, name in ((a, "a"), (b, "b"), (c, "c")))
    return frame.select("qb", "query_id", "nb", F.lit(kind).alias("kind"), *columns)


def _divided(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.divide(x, by, out=np.zeros_like(x), where=by > 0)


def _visits(key: tuple, votes: np.ndarray, names: np.ndarray, cos: np.ndarray | None) -> pa.RecordBatch:
    at = np.flatnonzero(votes)
    columns = {"query_id": pa.repeat(pa.scalar(key[1], pa.int64()), len(at)), "node_id": pa.array(names[at]), "votes": pa.array(votes[at])}
    if cos is not None:
        columns["cos"] = pa.array(cos[at], mask=np.isnan(cos[at]))
    return pa.RecordBatch.from_pydict(columns)


def weighted_visits(blocks: Blocks, masses: DataFrame, weights: DataFrame, steps: int) -> DataFrame:
    """(query_id, node_id, votes, cos): expected visits of walks by the weights of nodes, which are positive."""
    states, scratch = T._parse_datatype_string(_STATE), blocks.scratch
    factors = T._parse_datatype_string(_STATE + ", d binary")
    starts = _own(masses, _KNOWN, "at", "x")

    def first(key, total, w, _b, _c, m, _names):
        yield _one(factors, *key, *_encoded(_divided(m, total)), _divided(_floats(w), total).tobytes())

    def step(key, y, at, x, d, _m, _names):
        yield _one(states, *key, *_encoded(_decoded(at, x, len(y)) + _floats(d) * y))

    def last(key, y, w, cos, _c, m, names):
        yield _visits(key, m + _floats(w) * y, names, _floats(cos))

    whole = weights.select("qb", "query_id", "nb", F.lit(None).cast("binary").alias("at"), F.col("w").alias("x"))
    base = scratch.save(blocks.spread(whole, [starts, _own(weights, _OWN, "w")], first, factors, back=True), "factors")
    at = base.drop("d")
    for i in range(1, steps):
        at = scratch.save(blocks.spread(at, [_own(base, _OWN, "at", "x", "d")], step, states), f"states-{i}")
        scratch.drop(f"states-{i - 1}")
    return blocks.spread(at, [starts, _own(weights, _OWN, "w", "cos")], last, "query_id bigint, node_id bigint, votes double, cos double", ids=True)


def plain_visits(blocks: Blocks, masses: DataFrame, steps: int) -> DataFrame:
    """(query_id, node_id, votes): expected visits of walks in which each edge has its probability p, which is positive."""
    states, scratch = T._parse_datatype_string(_STATE), blocks.scratch
    starts = _own(masses, _KNOWN, "at", "x")
    each = masses.select("qb", "query_id").distinct().withColumn("nb", blocks._each(blocks.n))

    def step(key, y, _a, _b, _c, m, _names):
        yield _one(states, *key, *_encoded(m + y))

    def last(key, y, _a, _b, _c, m, names):
        yield _visits(key, m + y, names, None)

    at = masses
    for i in range(1, steps):
        at = scratch.save(blocks.spread(at, [starts, _own(each, _OWN)], step, states), f"states-{i}")
        scratch.drop(f"states-{i - 1}")
    return blocks.spread(at, [starts, _own(each, _OWN)], last, "query_id bigint, node_id bigint, votes double", ids=True)


def fits(nodes: DataFrame) -> bool:
    """Whether a task can hold a query's two vectors of all nodes."""
    return 16 * nodes.count() <= VECTORS


def _most(votes: np.ndarray, most: int | None) -> np.ndarray:
    """The places of what isn't 0, or of the ``most`` highest and all that equal the last of them to 9 digits."""
    at = np.flatnonzero(votes)
    if most is None or len(at) <= most:
        return at
    return at[votes[at] >= np.partition(votes[at], -most)[-most] - 2e-9]


def _slots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, to, n): the different dst by falling number of edges, and what leads to them: all of each that has more than LONG, then the first of all others, the second of those that have one, and so on."""
    order = np.lexsort((src, dst))
    to, first, n = np.unique(dst[order], return_index=True, return_counts=True)
    by = np.argsort(-n, kind="stable")
    to, first, n, src = to[by], first[by], n[by], src[order]
    hubs = int((n > LONG).sum())
    parts = [src[:0], *(src[lo : lo + c] for lo, c in zip(first[:hubs], n[:hubs], strict=True))]
    parts += [src[first[hubs : hubs + have] + i] for i, have in enumerate(_having(n[hubs:]))]
    return np.concatenate(parts), to, n


def _having(n: np.ndarray) -> list[int]:
    """How many of the falling numbers n exceed 0, 1, 2 and so on."""
    return np.searchsorted(-n, -np.arange(n[0]), side="left").tolist() if len(n) else []


def _indexed(nodes: DataFrame, n_blocks: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The nodes with block and place in it, and how many places a block has."""
    place = F.row_number().over(Window.partitionBy("nb").orderBy("node_id")) - 1
    index = scratch.save(nodes.withColumn("nb", F.pmod(F.xxhash64("node_id"), F.lit(n_blocks)).cast("int")).withColumn("pos", place), "places")
    return index, (index.agg(F.max("pos")).first()[0] or 0) + 1


def _placed_edges(graph: Graph, places: DataFrame) -> DataFrame:
    """(src_at, dst_at) of the edges between places(node_id, at). Up to SENT_IDS places are sent to the edges; of more, edges meet what they start from where they stand, so they are shuffled once, by their other end."""
    if places.count() <= SENT_IDS:
        src, dst = (F.broadcast(places.select(F.col("node_id").alias(k), F.col("at").cast("int").alias(f"{k}_at"))) for k in ("src", "dst"))
        return graph.edges.select("src", "dst").join(src, "src").join(dst, "dst").select("src_at", "dst_at")
    rows = graph.hops(places.select("node_id", F.col("at").cast("int").alias("src_at"))).select("src_at", "dst")
    rows = rows.join(places.select(F.col("node_id").alias("dst"), F.col("at").cast("int").alias("dst_at")), "dst")
    return rows.select("src_at", "dst_at")


def _edge_rows(edges: DataFrame, n_edges: int, kind: int) -> DataFrame:
    """edges(src_at, dst_at) as packed rows of this kind. What leads to a node stands in one row, but for nodes that most edges lead to."""
    row = T._parse_datatype_string(_STREAM)

    def packed(rows: pa.Table) -> pa.Table:
        src, to, n = _slots(*(rows[c].to_numpy() for c in ("src_at", "dst_at")))
        return pa.Table.from_batches([_one(row, kind, 0, *(x.astype(np.int32).tobytes() for x in (src, to, n)))])

    full = edges.groupBy("dst_at").agg(F.ceil(F.count("*") / ROW_EDGES).alias("slots")).where("slots > 1")
    slot = F.pmod(F.xxhash64("src_at"), F.coalesce("slots", F.lit(1)))
    rows = edges.join(full, "dst_at", "left").withColumn("row", F.pmod(F.xxhash64("dst_at", slot), F.lit(max(1, -(-n_edges // ROW_EDGES)))).cast("int"))
    return rows.select("row", "src_at", "dst_at").groupBy("row").applyInArrow(packed, row)


def _counts(kept: DataFrame) -> dict[int, int]:
    """How many rows of each kind come by tasks."""
    with released(kept.sparkSession):
        return {r["kind"]: r["count"] for r in kept.groupBy("kind").count().collect()}


def _add_edges(into: np.ndarray, of: np.ndarray, src: np.ndarray, dst: np.ndarray, n: np.ndarray) -> None:
    """Adds to the rows dst of ``into`` those of ``of`` that lead to them, as ``_slots`` has them."""
    lo, hubs = 0, int((n > LONG).sum())
    for to, size in zip(dst[:hubs], n[:hubs]):
        for at in range(lo, lo + size, PIECE):
            into[to] += of.take(src[at : min(at + PIECE, lo + size)], axis=0).sum(axis=0)
        lo += size
    sums = np.zeros((len(n) - hubs, of.shape[1]))
    held = np.empty_like(sums)
    for have in _having(n[hubs:]):
        sums[:have] += np.take(of, src[lo : lo + have], axis=0, out=held[:have], mode="clip")
        lo += have
    into[dst[hubs:]] += sums


class _Walk:
    """The walk of some queries: rows come in order of steps, and all of a step before the next."""

    def __init__(self, qb: int, whole: int, steps: int, counts: dict[int, int], most: int | None, own: dict[str, pa.Buffer]):
        self.qb, self.steps, self.counts, self.most, self.step, self.seen = qb, steps, counts, most, 0, 0
        self.names, self.out, self.into = np.full(whole, -1), np.zeros(whole), np.zeros(whole)
        self.ids, self.q, self.at, self.mass = (np.frombuffer(own[x], kind).copy() for x, kind in (("ids", np.int64), ("q", np.int32), ("at", np.int32), ("mass", np.float64)))
        # a row a node, so that an edge moves neighbouring numbers of all queries
        self.visits, self.sums = np.zeros((whole, len(self.ids))), np.zeros((whole, len(self.ids)))
        np.add.at(self.visits, (self.at, self.q), self.mass)

    def node_row(self, lo, ids, out, into):
        self.names[lo : lo + len(ids)], self.out[lo : lo + len(ids)], self.into[lo : lo + len(ids)] = ids, out, into
        self.seen += 1

    def edge_row(self, step, src, dst, n):
        if step != self.step:
            self.close()
            self.step = step
            self.visits *= self.out[:, None]
        _add_edges(self.sums, self.visits, src, dst, n)
        self.seen += 1

    def close(self):
        """A step is whole: its sums become the visits so far."""
        if self.seen != self.counts.get(min(1, int(self.step)), 0):
            raise RuntimeError(f"step {self.step} has {self.seen} rows of {self.counts}")
        self.seen = 0
        if self.step:
            self.sums *= self.into[:, None]
            np.add.at(self.sums, (self.at, self.q), self.mass)
            self.visits, self.sums = self.sums, self.visits
            self.sums[:] = 0

    def end(self):
        self.close()
        if self.step != self.steps and self.counts.get(1):
            raise RuntimeError(f"{self.step} steps of {self.steps}")
        for i, query in enumerate(self.ids.tolist()):
            votes = self.visits[:, i]
            at = _most(votes, self.most)
            yield pa.RecordBatch.from_pydict({"query_id": pa.repeat(pa.scalar(query, pa.int64()), len(at)), "node_id": pa.array(self.names[at]), "votes": pa.array(votes[at])})


def streamed_visits(nodes: DataFrame, graph: Graph, at: DataFrame, steps: int, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(query_id, node_id, votes): expected visits of walks in which the edge from u to v has the probability out(u) * into(v), for nodes(node_id, out, into), the graph's edges and the starts at(query_id, node_id, mass). With ``most``, of each query those that may be among so many highest to 9 digits.

    A task has some queries and walks all their steps by itself: it holds two
    vectors of all nodes a query, and the rows of edges come by once a step,
    from the shared folder. So neither edges nor vectors are shuffled or
    written a step.
    """
    bounded(scratch.spark)
    with released(scratch.spark):
        n, n_edges, n_queries = nodes.count(), graph.edges.count(), at.select("query_id").distinct().count()
    n_blocks = max(1, -(-n // NODES))
    each = max(1, min(VECTORS // max(1, 16 * n), -(-n_queries // CELLS)))
    n_tasks = max(1, -(-n_queries // each))
    index, size = _indexed(nodes, n_blocks, scratch)
    where = F.col("nb") * F.lit(size) + F.col("pos")
    row = T._parse_datatype_string(_STREAM)

    def block(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["pos"].to_numpy())
        ids, out, into = (rows[c].to_numpy()[order] for c in ("node_id", "out", "into"))
        return pa.Table.from_batches([_one(row, 0, rows["nb"][0].as_py(), ids.tobytes(), out.tobytes(), into.tobytes())])

    edges = _placed_edges(graph, index.select("node_id", where.alias("at")))
    kept = scratch.save(index.groupBy("nb").applyInArrow(block, row).unionByName(_edge_rows(edges, n_edges, 1)), "rows")
    counts = _counts(kept)

    group = T._parse_datatype_string("qb int, ids binary, q binary, at binary, mass binary")

    def starts(rows: pa.Table) -> pa.Table:
        ids, q = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        return pa.Table.from_batches([_one(group, rows["qb"][0].as_py(), ids.tobytes(), q.astype(np.int32).tobytes(), rows["at"].to_numpy().astype(np.int32).tobytes(), rows["mass"].to_numpy().astype(np.float64).tobytes())])

    asked = at.join(index, "node_id").select(F.pmod(F.xxhash64("query_id"), F.lit(n_tasks)).cast("int").alias("qb"), "query_id", where.alias("at"), "mass")
    asked = scratch.save(asked.groupBy("qb").applyInArrow(starts, group), "starts")
    scratch.drop("places")
    asked = asked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    own = [F.when(F.col("step") == 0, F.col(c)).alias(c) for c in ("ids", "q", "at", "mass")]
    asked = asked.select("qb", "step", *own).repartitionByRange(n_tasks, "qb").sortWithinPartitions("qb", "step")
    # each row of a task's queries and steps meets all rows of nodes or edges, one after the other
    met = asked.hint("shuffle_replicate_nl").join(kept.coalesce(1), F.expr("(step = 0 AND kind = 0) OR (step > 0 AND kind = 1)"))
    whole = n_blocks * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            qbs, steps_, nbs = (batch.column(c).to_numpy() for c in ("qb", "step", "nb"))
            a, b, c = (batch.column(x) for x in ("a", "b", "c"))
            for i in range(batch.num_rows):
                if walk is None or walk.qb != qbs[i]:
                    if walk is not None:
                        yield from walk.end()
                    walk = _Walk(qbs[i], whole, steps, counts, most, {x: batch.column(x)[i].as_buffer() for x in ("ids", "q", "at", "mass")})
                if steps_[i] == 0:
                    walk.node_row(nbs[i] * size, *(np.frombuffer(x[i].as_buffer(), kind) for x, kind in ((a, np.int64), (b, np.float64), (c, np.float64))))
                else:
                    walk.edge_row(steps_[i], *(_places(x[i]) for x in (a, b, c)))
        if walk is not None:
            yield from walk.end()

    return met.mapInArrow(run, "query_id bigint, node_id bigint, votes double")


def streams(n_nodes: int, n_queries: int) -> bool:
    """Whether walks by weights of their own have more vectors than are shuffled, and a task can hold those of a query."""
    return 8 * n_nodes * n_queries > FEW and PER_NODE * n_nodes <= VECTORS


def _sent(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _received(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()


class _WeightedWalk:
    """The walk of some queries, each with weights of its own: first come the weights of all nodes, then edges against their direction for the totals, then edges along it, once a step."""

    def __init__(self, whole: int, steps: int, counts: dict[int, int], starts: pa.Table, ids: np.ndarray):
        self.ids, self.steps, self.counts, self.step, self.seen = ids, steps, counts, 0, 0
        self.q, self.at, self.mass = (starts[c].to_numpy() for c in ("q", "at", "mass"))
        self.names = np.full(whole, -1)
        # a row a node, so that an edge moves neighbouring numbers of all queries
        self.weight, self.total, self.here, self.sums = (np.zeros((whole, len(ids))) for _ in range(4))
        self.cos = np.full((whole, len(ids)), np.nan)

    def pairs(self, q, at, names, weight, cos):
        self.names[at], self.weight[at, q], self.cos[at, q] = names, weight, cos
        self.seen += len(q)

    def edge_row(self, step, src, dst, n):
        if step != self.step:
            self.close()
            self.step = step
        into, of = (self.total, self.weight) if step == 1 else (self.sums, self.here)
        _add_edges(into, of, src, dst, n)
        self.seen += 1

    def close(self):
        """A step is whole: ``here`` becomes what of each node's visits so far goes to a weight of one of its neighbours."""
        if self.seen != (self.counts[0] * len(self.ids), self.counts.get(1, 0), self.counts.get(2, 0))[min(2, self.step)]:
            raise RuntimeError(f"step {self.step} has {self.seen} rows of {self.counts}")
        self.seen = 0
        if self.step:
            self.sums *= self.weight
            np.add.at(self.sums, (self.at, self.q), self.mass)
            if self.step == 1:
                np.divide(1.0, self.total, out=self.total, where=self.total > 0)
            if self.step <= self.steps:
                self.sums *= self.total
            self.here, self.sums = self.sums, self.here
            self.sums[:] = 0

    def end(self):
        self.close()
        if not self.step:  # no edges
            np.add.at(self.here, (self.at, self.q), self.mass)
        elif self.step != self.steps + 1:
            raise RuntimeError(f"{self.step - 1} steps of {self.steps}")
        for i, query in enumerate(self.ids.tolist()):
            found = np.flatnonzero(self.here[:, i])
            for lo in range(0, len(found), ROW_EDGES):
                at = found[lo : lo + ROW_EDGES]
                cos = self.cos[at, i]
                yield pa.RecordBatch.from_pydict({"query_id": pa.repeat(pa.scalar(query, pa.int64()), len(at)), "node_id": pa.array(self.names[at]), "votes": pa.array(self.here[at, i]), "cos": pa.array(cos, mask=np.isnan(cos))})


def streamed_weighted_visits(nodes: DataFrame, graph: Graph, at: DataFrame, queries: DataFrame, keep: list[str], weight: Column, steps: int, scratch: Scratch) -> DataFrame:
    """(query_id, node_id, votes, cos): expected visits of walks by the weights of nodes, which each query has of its own; ``weight`` reads ``keep``, which nodes(node_id, vec, ...) have, and query_id, node_id and cos, without pheromones.

    As in ``streamed_visits`` a task walks all steps for some queries, and
    nodes and edges come by from the shared folder: first the nodes, of which
    it forms cosines and weights, then the edges. So no vector of queries x
    nodes is shuffled or written.
    """
    bounded(scratch.spark)
    with released(scratch.spark):
        n, n_edges, n_queries = nodes.count(), graph.edges.count(), at.select("query_id").distinct().count()
    each = max(1, min(VECTORS // max(1, PER_NODE * n), -(-n_queries // CELLS)))
    index, size = _indexed(nodes.select("node_id", "vec", *keep), max(1, -(-n // ROW_NODES)), scratch)
    whole = (index.agg(F.max("nb")).first()[0] or 0) * size + size
    places = index.select("node_id", (F.col("nb") * F.lit(size) + F.col("pos")).alias("at"))
    row = T._parse_datatype_string(_STREAM)

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        return pa.Table.from_batches([_one(row, 0, rows["nb"][0].as_py(), _sent(rows.select(["node_id", "vec", *keep])), None, None)])

    edges = _placed_edges(graph, places)
    back = edges.select(F.col("dst_at").alias("src_at"), F.col("src_at").alias("dst_at"))
    kept = index.groupBy("nb").applyInArrow(block, row).unionByName(_edge_rows(back, n_edges, 1)).unionByName(_edge_rows(edges, n_edges, 2))
    kept = scratch.save(kept, "rows")
    counts = _counts(kept) | {0: n}

    # a hash deals queries to groups, and a group's queries to blocks, none of which has more than ``each``
    groups = max(1, n_queries // (8 * each))
    by_group = Window.partitionBy("group").orderBy("query_id")
    dealt = at.select("query_id").distinct().withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    dealt = dealt.select("query_id", "group", F.floor((F.row_number().over(by_group) - 1) / each).alias("part"))
    group = T._parse_datatype_string("qb bigint, asked binary, starts binary")

    def starts(key: tuple, rows: pa.Table) -> pa.Table:
        ids, first, q = np.unique(rows["query_id"].to_numpy(), return_index=True, return_inverse=True)
        own = pa.table({"q": pa.array(q.astype(np.int64)), "at": rows["at"], "mass": rows["mass"]})
        qb = key[0].as_py() << 32 | key[1].as_py()
        return pa.Table.from_pydict({"qb": pa.array([qb], pa.int64()), "asked": pa.array([_sent(rows.select(["query_id", "qvec"]).take(pa.array(first)))], pa.binary()), "starts": pa.array([_sent(own)], pa.binary())})

    asked = at.join(places, "node_id").join(dealt, "query_id").join(queries.select("query_id", "qvec"), "query_id")
    asked = scratch.save(asked.select("group", "part", "query_id", "at", "mass", "qvec").groupBy("group", "part").applyInArrow(starts, group), "starts")
    scratch.drop("places")
    n_tasks = max(1, asked.count())
    asked = asked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps + 1))))
    asked = asked.select("qb", "step", *(F.when(F.col("step") == 0, F.col(c)).alias(c) for c in ("asked", "starts"))).repartitionByRange(n_tasks, "qb").sortWithinPartitions("qb", "step")
    met = asked.hint("shuffle_replicate_nl").join(kept.coalesce(1), F.expr("kind = least(step, 2)"))

    traits = [index.schema[c] for c in ("node_id", *keep)]
    known = T.StructType([T.StructField("query_id", T.LongType()), *traits, T.StructField("cos", T.DoubleType())])
    schema = T.StructType([*T._parse_datatype_string("sent int, step int, q int, at int, a binary, b binary, c binary").fields, *known.fields])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_of, own, any_pair = None, None, None

        def batch_of(pair: pa.Table, sent: int, step: int, q: int, at: np.ndarray, a=None, b=None, c=None) -> list[pa.RecordBatch]:
            m = pair.num_rows
            values = {x: pa.repeat(pa.scalar(v, pa.int32()), m) for x, v in (("sent", sent), ("step", step), ("q", q))} | {"at": pa.array(at, pa.int32())}
            values |= {x: pa.nulls(m, pa.binary()) if v is None else pa.array([v], pa.binary()) for x, v in (("a", a), ("b", b), ("c", c))}
            return pa.table({f.name: values[f.name] if f.name in values else pair[f.name] for f in schema.fields}).to_batches()

        for batch in batches:
            qbs, on, nbs = (batch.column(x).to_numpy() for x in ("qb", "step", "nb"))
            for i in range(batch.num_rows):
                a, b, c = (batch.column(x)[i] for x in ("a", "b", "c"))
                if on[i]:  # edges go by, with columns of some pair: what weighs pairs sees no other values
                    yield from batch_of(any_pair, _EDGES, int(on[i]), 0, np.zeros(1), a.as_py(), b.as_py(), c.as_py())
                    continue
                nodes = _received(a)
                begins = block_of != qbs[i]
                if begins:
                    block_of, own = qbs[i], _received(batch.column("asked")[i])
                at = nbs[i] * size + np.arange(nodes.num_rows)
                cos = cosines(own["qvec"], nodes["vec"])
                for j in range(own.num_rows):
                    values = {f.name: nodes[f.name] for f in traits} | {"query_id": pa.repeat(own["query_id"][j], nodes.num_rows), "cos": pa.array(cos.data[j], mask=np.ma.getmaskarray(cos)[j])}
                    pair = pa.table({f.name: values[f.name] for f in known.fields})
                    if begins:
                        begins, any_pair = False, pair.slice(0, 1)
                        yield from batch_of(any_pair, _STARTS, 0, 0, np.zeros(1), batch.column("starts")[i].as_py(), own["query_id"].to_numpy().astype(np.int64).tobytes())
                    yield from batch_of(pair, _PAIRS, 0, j, at)

    rows = met.mapInArrow(pairs, schema).withColumn("pheromone", F.lit(0.0)).withColumn("max_pheromone", F.lit(1.0))
    rows = rows.select("sent", "step", "q", "at", "a", "b", "c", "node_id", "cos", weight.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            sent, on, q, at, names = (batch.column(x).to_numpy() for x in ("sent", "step", "q", "at", "node_id"))
            w, cos = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("w", "cos"))
            cuts = [0, *(np.flatnonzero((sent[1:] != _PAIRS) | (sent[:-1] != _PAIRS)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                a, b, c = (batch.column(x)[lo] for x in ("a", "b", "c"))
                if sent[lo] == _STARTS:
                    if walk is not None:
                        yield from walk.end()
                    walk = None  # its vectors go before others come
                    walk = _WeightedWalk(whole, steps, counts, _received(a), np.frombuffer(b.as_buffer(), np.int64).copy())
                elif sent[lo] == _PAIRS:
                    walk.pairs(q[lo:hi], at[lo:hi], names[lo:hi], w[lo:hi], cos[lo:hi])
                else:
                    walk.edge_row(int(on[lo]), *(_places(x) for x in (a, b, c)))
        if walk is not None:
            yield from walk.end()

    return rows.mapInArrow(run, "query_id bigint, node_id bigint, votes double, cos double")


def holds(n_nodes: int, n_edges: int) -> bool:
    """Whether a task can hold so many edges, in both directions, beside the vectors of a query."""
    return 4 * n_edges + PER_NODE * n_nodes <= VECTORS


def _symmetric(edges: DataFrame) -> bool:
    """Whether each edge has its reverse: the edges' hashes are those of their reverses."""
    there, back = F.xxhash64("src", "dst"), F.xxhash64("dst", "src")
    row = edges.agg(*(f(x) for x in (there, back) for f in (F.bit_xor, lambda h: F.sum(F.shiftright(h, 32))))).first()
    return tuple(row[:2]) == tuple(row[2:])


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the ends of the edges a, b, and all that have their labels, the lowest label of the two. A label is a place that has itself as label."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _labelled(whole: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each place the lowest that edges join it to."""
    label, held, n = np.arange(whole), [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n > EDGES:
            _join_labels(label, *(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if held:
        _join_labels(label, *(np.concatenate(x) for x in zip(*held)))
    return label


def islands_of(nodes: DataFrame, graph: Graph, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(node_id, island, at, size) of all nodes: no edge leaves an island, ``at`` is the place in it and ``size`` how many it has; and the nodes and edges of the largest. Parts of the graph that nothing joins are islands, small ones together."""
    rows = nodes.select("node_id").repartitionByRange(max(1, -(-nodes.count() // NODES)), "node_id").sortWithinPartitions("node_id")
    rows = scratch.save(rows.select("node_id", F.spark_partition_id().alias("nb"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos")), "ranges")
    with released(scratch.spark):
        sizes = {r["nb"]: r["n"] for r in rows.groupBy("nb").agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1))]).tolist()
    whole, least = before[-1], ISLAND
    rows = rows.select("node_id", (F.array(*map(F.lit, before))[F.col("nb")] + F.col("pos")).cast("int").alias("at"))

    def joined(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return _labelled(whole, (tuple(batch.column(c).to_numpy().astype(np.intp) for c in (0, 1)) for batch in batches))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = joined(batches)
        at = np.flatnonzero(label != np.arange(whole))
        yield pa.RecordBatch.from_pydict({"a": pa.array(at, pa.int32()), "b": pa.array(label[at], pa.int32())})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = joined(batches)
        order = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.diff(label[order], prepend=-1))
        island = np.repeat(first // least, np.diff(first, append=whole))  # parts that begin within so many places are one
        begin, size = np.unique(island, return_index=True, return_counts=True)[1:]
        each = np.repeat(begin, size)
        columns = {"at": order, "island": island, "place": np.arange(whole) - each, "size": np.repeat(size, size)}
        yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int32()) for c, x in columns.items()})

    # tasks send what joins their edges, a row a node at most
    found = _placed_edges(graph, rows).mapInArrow(forest, "a int, b int").repartition(1).mapInArrow(dealt, "at int, island int, place int, size int")
    found = F.broadcast(found) if whole <= SENT_IDS else found
    places = scratch.save(rows.join(found, "at").select("node_id", "island", F.col("place").alias("at"), "size"), "places")
    scratch.drop("ranges")
    with released(scratch.spark):
        most = places.join(graph.degree, "node_id", "left").groupBy("island").agg(F.max("size").alias("n"), F.sum("degree").alias("edges")).agg(F.max("n"), F.max("edges")).first()
    return places, most[0] or 0, most[1] or 0


class _HeldWalk:
    """The walks of some queries on an island, by a task that holds its edges: nodes and edges come once, in any order."""

    def __init__(self, asked: pa.Table, starts: pa.Table, size: int, weight: Callable | None, traits: list[str]):
        self.ids, self.size, self.weigh = asked["query_id"].to_numpy().astype(np.int64), size, weight
        self.starts = [starts[c].to_numpy() for c in ("q", "at", "mass")]
        self.names, self.rows, self.seen = np.full(size, -1), {_STEP: [], _BACK: []}, Counter()
        self.traits = {c: np.zeros(size) for c in traits}
        if weight:
            self.vectors = asked["qvec"]
            self.weight, self.cos = np.zeros((size, len(self.ids))), np.full((size, len(self.ids)), np.nan)

    def node_row(self, nodes: pa.Table) -> None:
        at = nodes["at"].to_numpy()
        self.names[at] = nodes["node_id"].to_numpy()
        for c, own in self.traits.items():
            own[at] = pc.fill_null(nodes[c].cast(pa.float64()), 0.0).to_numpy()
        for lo in range(0, len(at) if self.weigh else 0, PIECE):
            here, vectors = at[lo : lo + PIECE], nodes["vec"].slice(lo, PIECE)
            cos = cosines(self.vectors, vectors)
            self.weight[here] = self.weigh({c: own[here][:, None] for c, own in self.traits.items()} | {"cos": cos.data.T}, np.ma.getmaskarray(cos).T)
            self.cos[here] = cos.filled(np.nan).T
        self.seen[_PAIRS] += 1

    def edge_row(self, kind: int, first: int, src: np.ndarray, dst: np.ndarray, n: np.ndarray) -> None:
        self.rows[kind].append((first, src, dst, n))
        self.seen[kind] += 1

    def product(self, kind: int, of: np.ndarray) -> np.ndarray:
        into = np.zeros_like(of)
        for first, src, dst, n in self.rows[kind]:
            _add_edges(into, of[first:], src.astype(np.intp), dst, n)
        return into

    def walked(self, lo: int, out: np.ndarray, into: np.ndarray, steps: int) -> np.ndarray:
        """Visits of the queries from lo on, a row a node, of walks that take the edge from u to v with the probability out(u) * into(v)."""
        q, at, mass = self.starts
        own = (q >= lo) & (q < lo + TOGETHER)
        q, at, mass = q[own] - lo, at[own], mass[own]
        here = np.zeros((self.size, min(TOGETHER, len(self.ids) - lo)))
        np.add.at(here, (at, q), mass)
        for _ in range(steps):
            here *= out
            here = self.product(_STEP, here)
            here *= into
            np.add.at(here, (at, q), mass)
        return here

    def end(self, steps: int, counts: dict[int, int], back: int, few: Callable) -> Iterator[pa.RecordBatch]:
        """What is found: ``few`` gives the places to return of votes, cos and traits."""
        if dict(self.seen) != counts:
            raise RuntimeError(f"a task has rows {dict(self.seen)} of {counts}")
        for lo in range(0, len(self.ids), TOGETHER):  # as many as stay near: an edge moves neighbouring numbers of all of them
            if self.weigh:
                into = np.ascontiguousarray(self.weight[:, lo : lo + TOGETHER])
                out = self.product(back, into)
                np.divide(1.0, out, out=out, where=out > 0)
            else:
                into, out = (self.traits[c][:, None] for c in ("into", "out"))
            votes = self.walked(lo, out, into, steps)
            for i, query in enumerate(self.ids[lo : lo + TOGETHER].tolist()):
                own = self.cos[:, lo + i] if self.weigh else None
                found = few(votes[:, i], own, self.traits)
                for first in range(0, len(found), ROW_EDGES):
                    at = found[first : first + ROW_EDGES]
                    columns = {"query_id": pa.repeat(pa.scalar(query, pa.int64()), len(at)), "node_id": pa.array(self.names[at]), "votes": pa.array(votes[at, i])}
                    yield pa.RecordBatch.from_pydict(columns | ({"cos": pa.array(own[at], mask=np.isnan(own[at]))} if self.weigh else {}))


def few_by_score(most: int, score: Callable) -> Callable:
    """Of a query those alone that may be among the ``most`` of highest score, which is of arrays, to 10 digits."""

    def few(votes: np.ndarray, cos: np.ndarray, traits: dict[str, np.ndarray]) -> np.ndarray:
        at = np.flatnonzero(votes)
        if len(at) <= most:
            return at
        found = np.where(np.isnan(cos[at]), 0.0, score({"votes": votes[at], "cos": cos[at]} | {c: x[at] for c, x in traits.items()}))
        found = np.where(np.isnan(found), np.inf, found)
        return at[found >= np.partition(found, -most)[-most] - 1e-9]

    return few


def few_by_votes(most: int | None) -> Callable:
    return lambda votes, _cos, _traits: _most(votes, most)


def _island_edges(graph: Graph, places: DataFrame, kind: int, back: bool = False) -> DataFrame:
    """Edges as packed rows of this kind, each of an island and a block of what they start from. A node that most edges lead to has a part in the rows of each block."""
    row = T._parse_datatype_string("island int, " + _STREAM)

    def packed(rows: pa.Table) -> pa.Table:
        first = rows["first"][0].as_py()
        src, to, n = _slots(*(rows[c].to_numpy() for c in ("src_at", "dst_at")))
        return pa.Table.from_batches([_one(row, rows["island"][0].as_py(), kind, first, (src - first).astype(np.uint16).tobytes(), to.astype(np.int32).tobytes(), n.astype(np.int32).tobytes())])

    with released(places.sparkSession):
        n, n_edges = places.count(), graph.edges.count()
    src, dst = (places.select(F.col("node_id").alias(x), F.col("at").alias(f"{x}_at"), *more) for x, more in (("dst" if back else "src", ["island"]), ("src" if back else "dst", [])))
    src, dst = (src.withColumnsRenamed({"dst_at": "src_at"}), dst.withColumnsRenamed({"src_at": "dst_at"})) if back else (src, dst)
    src, dst = (F.broadcast(x) if n <= SENT_IDS else x for x in (src, dst))
    edges = graph.edges.select("src", "dst").join(src, src.columns[0]).join(dst, dst.columns[0])
    first = (F.col("src_at") - F.pmod("src_at", F.lit(SOURCES))).cast("int").alias("first")
    dealt = F.pmod(F.xxhash64("dst_at"), F.lit(max(1, -(-n_edges // ROW_EDGES)))).cast("int")
    # an island has its share of the rows: as many as it has edges for
    share = F.greatest(F.lit(1), F.ceil(F.col("degree") / ROW_EDGES)).cast("int")
    degree = places.join(graph.degree, "node_id").groupBy("island").agg(F.sum("degree").alias("degree")).select("island", share.alias("rows"))
    edges = edges.join(F.broadcast(degree), "island").select("island", first, F.pmod(dealt, F.col("rows")).alias("row"), "src_at", "dst_at")
    return edges.groupBy("island", "first", "row").applyInArrow(packed, row)


def island_visits(nodes: DataFrame, graph: Graph, at: DataFrame, steps: int, scratch: Scratch, few: Callable, islands: DataFrame, queries: DataFrame | None = None, keep: list[str] | None = None, weight: Callable | None = None) -> DataFrame:
    """What ``streamed_visits`` gives for nodes(node_id, out, into), or, with ``weight`` of arrays of ``keep`` and cos, ``streamed_weighted_visits`` for queries(query_id, qvec), where tasks can hold the edges of an island.

    A task has some queries that start on an island, and gets its nodes and
    edges once, from the shared folder. Walks don't leave their islands, so
    what one can't reach costs nothing; pairs of queries and nodes don't leave
    the task, but for what ``few`` chooses.
    """
    bounded(scratch.spark)
    own = ["vec", *keep] if weight else ["out", "into"]
    with released(scratch.spark):
        same, n_queries = not weight or _symmetric(graph.edges), at.select("query_id").distinct().count()
        begun = at.join(islands, "node_id").select("query_id", "island").distinct().count()
    row = T._parse_datatype_string("island int, " + _STREAM)

    def block(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_one(row, rows["island"][0].as_py(), _PAIRS, rows["row"][0].as_py(), _sent(rows.select(["at", "node_id", *own])), None, None)])

    placed = nodes.select("node_id", *own).join(islands.drop("size"), "node_id").withColumn("row", F.floor(F.col("at") / ROW_NODES).cast("int"))
    kept = placed.groupBy("island", "row").applyInArrow(block, row).unionByName(_island_edges(graph, islands, _STEP))
    kept = scratch.save(kept if same else kept.unionByName(_island_edges(graph, islands, _BACK, back=True)), "rows")
    with released(scratch.spark):
        counts: dict[int, dict[int, int]] = {}
        for r in kept.groupBy("island", "kind").count().collect():
            counts.setdefault(r["island"], {})[r["kind"]] = r["count"]

    # on an island a hash deals queries to groups, and a group's queries to blocks, none of which has more than ``each``
    each = F.greatest(F.lit(1), F.least(F.floor(F.lit(VECTORS) / (PER_NODE * F.col("size"))), F.lit(-(-begun // CELLS)))).cast("int")
    pairs = at.join(islands, "node_id").select("query_id", "island", "size").distinct().withColumn("each", each)
    pairs = pairs.withColumn("group", F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.floor(F.lit(n_queries) / (8 * F.col("each"))))).cast("int"))
    by_group = Window.partitionBy("island", "group").orderBy("query_id")
    dealt = pairs.select("query_id", "island", "group", F.floor((F.row_number().over(by_group) - 1) / F.col("each")).cast("int").alias("part"))
    group, asked_of = T._parse_datatype_string("qb binary, on int, size int, asked binary, starts binary"), ["query_id", *(["qvec"] if weight else [])]

    def starts(key: tuple, rows: pa.Table) -> pa.Table:
        _, first, q = np.unique(rows["query_id"].to_numpy(), return_index=True, return_inverse=True)
        begins = pa.table({"q": pa.array(q.astype(np.int64)), "at": rows["at"], "mass": rows["mass"]})
        qb = b"".join(x.as_py().to_bytes(4, "big") for x in key)
        return pa.table({"qb": pa.array([qb], pa.binary()), "on": pa.array([key[0].as_py()], pa.int32()), "size": rows["size"].slice(0, 1), "asked": pa.array([_sent(rows.select(asked_of).take(pa.array(first)))], pa.binary()), "starts": pa.array([_sent(begins)], pa.binary())})

    asked = at.join(islands, "node_id").join(dealt, ["query_id", "island"])
    asked = asked.join(queries.select(*asked_of), "query_id") if weight else asked
    asked = scratch.save(asked.select("island", "group", "part", "size", "at", "mass", *asked_of).groupBy("island", "group", "part").applyInArrow(starts, group), "starts")
    scratch.drop("places")
    # a task's row of queries stays, and all rows of nodes and edges of its island go by it
    met = kept.coalesce(1).hint("shuffle_replicate_nl").join(asked.repartitionByRange(max(1, asked.count()), "qb"), F.expr("island = on"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[bytes, tuple[int, _HeldWalk]] = {}
        for batch in batches:
            islands, kinds, nbs, sizes = (batch.column(x).to_numpy() for x in ("island", "kind", "nb", "size"))
            for i in range(batch.num_rows):
                qb, (a, b, c) = batch.column("qb")[i].as_py(), (batch.column(x)[i] for x in ("a", "b", "c"))
                if qb not in walks:
                    walks[qb] = int(islands[i]), _HeldWalk(_received(batch.column("asked")[i]), _received(batch.column("starts")[i]), int(sizes[i]), weight, own[1:] if weight else own)
                if kinds[i] == _PAIRS:
                    walks[qb][1].node_row(_received(a))
                else:
                    walks[qb][1].edge_row(int(kinds[i]), int(nbs[i]), *(np.frombuffer(x.as_buffer(), kind).copy() for x, kind in ((a, np.uint16), (b, np.int32), (c, np.int32))))
        while walks:
            island, walk = walks.popitem()[1]
            yield from walk.end(steps, counts[island], _STEP if same else _BACK, few)

    return met.mapInArrow(run, "query_id bigint, node_id bigint, votes double" + (", cos double" if weight else ""))
