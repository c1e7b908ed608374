"""Exact nearest nodes of each query, fetches, and the drop zone of the walkers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.functions.vectors import cosine, norm
from walkrank.params import Params

#: Queries that one row of nodes meets at a time, and nodes that meet them in one cell.
QUERY_BLOCK, NODE_BLOCK = 8192, 8192
#: Queries and nodes of a cell whose pairs are all returned.
PAIR_BLOCK = 1024
#: Scores that are held at a time within a cell.
_SCORES = 1 << 19


def faulty(vector: str, dims) -> Column:
    """Why a vector can't be compared with those of ``dims`` components, as null, length or non-finite; null if it can be."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNull(), "null").when(F.size(vector) != dims, "length").when(odd, "non-finite")


def common_length(frame: DataFrame, vector: str) -> int | None:
    """The number of components that most vectors have; of equally many, the smaller. None without vectors."""
    sizes = frame.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c"))
    row = sizes.agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("n")).first()
    return row["n"]


def finite(frame: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector is whole: of ``dims`` components (the common length), each a finite number."""
    dims = common_length(frame, vector) if dims is None else dims
    return frame.where("false") if dims is None else frame.where(faulty(vector, dims).isNull())


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; zeros stay."""
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(size > 0, size, 1.0)[:, None]


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Whole vectors of one length as rows, without an object for each."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(vectors), -1 if len(flat) else 0)


def best_of(asked: pa.Table, known: pa.Table, n: int) -> pa.Table:
    """(query_id, node_id, score): of asked(query_id, qvec) and known(node_id, vec) the n highest cosines of each query, and all that equal them to 10 digits up to n by id. Some queries at a time: what they hold besides the vectors doesn't grow with the cell."""
    queries, nodes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if asked.num_rows and known.num_rows:
        known = known.select(["node_id", "vec"]).sort_by("node_id")
        ids, vectors, own, step = known["node_id"].to_numpy(), unit(matrix(known["vec"])), unit(matrix(asked["qvec"])), max(1, _SCORES // known.num_rows)
        for lo in range(0, len(own), step):
            scores = own[lo : lo + step] @ vectors.T
            for query, row in zip(asked["query_id"].to_numpy()[lo : lo + step], scores, strict=True):
                ordered = np.round(row, 10)
                least = np.partition(ordered, -n)[-n] if len(row) > n else -np.inf
                best = np.flatnonzero(ordered >= least)
                best = best[np.argsort(-ordered[best], kind="stable")][:n]
                queries.append(np.full(len(best), query))
                nodes.append(ids[best])
                found.append(row[best])
    return pa.table({"query_id": np.concatenate(queries), "node_id": np.concatenate(nodes), "score": np.concatenate(found)})


def merged(scored: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, node_id, score): the first n of what blocks gave."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "node_id", "score")


def top_n(queries: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, node_id, score): the n nodes of highest cosine; equal scores (to 10 digits) by id. Nodes and queries without a whole vector, of the nodes' common length and finite numbers, take no part.

    Blocks of queries meet blocks of nodes in a grid whose cells are matrix
    products of bounded size; each keeps n nodes a query, and a window merges
    the cells.
    """
    dims = common_length(nodes, "vec")
    q = finite(queries.select("query_id", "qvec"), "qvec", dims)
    r = finite(nodes.select("node_id", "vec"), "vec", dims)
    q_blocks, r_blocks = (max(1, -(-frame.count() // size)) for frame, size in ((q, QUERY_BLOCK), (r, NODE_BLOCK)))
    r_blocks = max(r_blocks, min(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("node_id"), F.lit(r_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))

    def cell(asked: pa.Table, known: pa.Table) -> pa.Table:
        return best_of(asked, known, n)

    scored = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(cell, "query_id bigint, node_id bigint, score double")
    return merged(scored, n)


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the places of the vectors that have it, without null components, and their matrix."""
    column = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in set(sizes.tolist()) - {-1}:
        places = np.flatnonzero(sizes == n)
        flat = column.take(pa.array(places)).flatten()
        odd = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(places), n).any(axis=1)
        out[n] = places[~odd], flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), n)[~odd]
    return out


def cosines(asked: pa.ChunkedArray, known: pa.ChunkedArray, epsilon: float = 1e-8) -> np.ma.MaskedArray:
    """The cosine of each of asked with each of known as a matrix product; masked without a vector, or where two have other lengths."""
    out, left, right = np.ma.masked_all((len(asked), len(known))), _by_length(asked), _by_length(known)
    for n in left.keys() & right.keys():
        (i, a), (j, b) = left[n], right[n]
        size = np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b)) + epsilon
        out[np.ix_(i, j)] = (a @ b.T) / size
    return out


def all_pairs(queries: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, node_id, *keep, cos): every query with every node, and columns of the node; cos is null without a vector.

    Cells of a grid, blocks of queries against blocks of nodes, are matrix
    products of bounded size: neither side is sent whole to a task.
    """
    q, r = queries.select("query_id", "qvec"), nodes.select("node_id", "vec", *keep)
    q_blocks, r_blocks = (max(1, -(-frame.count() // PAIR_BLOCK)) for frame in (q, r))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r_blocks - 1).cast("bigint"))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("node_id"), F.lit(r_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
    schema = T.StructType([q.schema["query_id"], *(r.schema[c] for c in ("node_id", *keep)), T.StructField("cos", T.DoubleType())])

    def cell(asked: pa.Table, known: pa.Table) -> pa.Table:
        cos = cosines(asked["qvec"], known["vec"])
        i, j = (pa.array(x.ravel()) for x in np.indices(cos.shape))
        columns = [asked["query_id"].take(i), *(known[c].take(j) for c in ("node_id", *keep)), pa.array(cos.data.ravel(), mask=np.ma.getmaskarray(cos).ravel())]
        return pa.table(columns, names=schema.names)

    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(cell, schema)


def fetch(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, pos, node_id, vec) for request(request_id, ids): in order, repeats kept, null for missing nodes."""
    return requests.select("request_id", F.posexplode("ids").alias("pos", "node_id")).join(nodes.select("node_id", "vec"), "node_id", "left").select("request_id", "pos", "node_id", "vec")


def members_of_pool(pool: DataFrame, members: DataFrame) -> DataFrame:
    """The pool's nodes that are in the graph. The pool is cut before, so it may shrink."""
    return pool.join(members.select("node_id").distinct(), "node_id", "left_semi").select("query_id", "rank", "node_id", "score")


def drop_zone(pool: DataFrame, params: Params) -> DataFrame:
    """(query_id, rank, node_id, weight, share) of the first ``start_subset`` members: weight falls by ``drop_slope`` a rank; a smaller pool keeps the weights of its ranks."""
    order = Window.partitionBy("query_id").orderBy("rank")
    zone = pool.withColumn("i", F.row_number().over(order)).where(F.col("i") <= params.start_subset)
    weight = 1.0 + F.lit(params.drop_slope) * (F.lit(params.start_subset) - F.col("i"))
    zone = zone.select("query_id", F.col("i").alias("rank"), "node_id", weight.alias("weight"))
    return zone.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id")))


def starts(queries: DataFrame, graph, params: Params) -> DataFrame:
    return drop_zone(members_of_pool(top_n(queries, graph.nodes, params.initial_pool_size), graph.members), params)


def sized(queries: DataFrame) -> DataFrame:
    """query_id, qvec and qsize, its norm: formed once a query, not once a pair."""
    return queries.select("query_id", "qvec", norm("qvec").alias("qsize"))


def similarity(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (query_id, node_id, ...) with cos; null where a vector is missing."""
    rows = pairs.join(nodes.select("node_id", "vec", "size"), "node_id", "left").join(sized(queries), "query_id", "left")
    return rows.withColumn("cos", cosine("qvec", "vec", sizes=("qsize", "size"))).drop("vec", "qvec", "size", "qsize")
