"""Graphs from stores outside Spark: what a store must offer, a data source that reads it in partitions, and datasets by name."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from walkrank.sources.graph import Graph

#: Tables of a store, and the column by which each can be asked for some rows alone.
SCHEMAS = {"nodes": "node_id bigint, vec array<double>, node_type string, relevance double", "edges": "src bigint, dst bigint"}
KEYS = {"nodes": "node_id", "edges": "src"}
_PUSHED = "spark.sql.python.filterPushdown.enabled"


@runtime_checkable
class VectorStore(Protocol):
    """Vectors in parts that tasks read apart. A part is any value that can be pickled."""

    def node_parts(self) -> Sequence[Any]: ...

    def nodes(self, part: Any, ids: set[int] | None) -> Iterable[pa.RecordBatch]:
        """The nodes of a part: all, or those of some ids."""


@runtime_checkable
class GraphStore(Protocol):
    """Edges in parts that tasks read apart."""

    def edge_parts(self) -> Sequence[Any]: ...

    def edges(self, part: Any, sources: set[int] | None) -> Iterable[pa.RecordBatch]:
        """The edges of a part: all, or those that leave some nodes."""


def opened(maker: str, arguments: Mapping) -> Any:
    """A store made by <module>:<name> with plain arguments: tasks open their own."""
    module, _, name = maker.partition(":")
    return getattr(importlib.import_module(module), name)(**arguments)


@dataclass
class Part(InputPartition):
    token: Any


class _Reader(DataSourceReader):
    def __init__(self, maker: str, arguments: dict, table: str):
        self.maker, self.arguments, self.table = maker, arguments, table
        self.ids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality with some keys; leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (KEYS[self.table],):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = asked if self.ids is None else self.ids & asked
            else:
                yield f

    def partitions(self) -> Sequence[Part]:
        store = opened(self.maker, self.arguments)
        return [Part(p) for p in (store.node_parts() if self.table == "nodes" else store.edge_parts())]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store = opened(self.maker, self.arguments)
        yield from (store.nodes if self.table == "nodes" else store.edges)(partition.token, self.ids)


class StoreSource(DataSource):
    """format("walkrank_store") with options maker, arguments (JSON) and table (nodes or edges)."""

    @classmethod
    def name(cls) -> str:
        return "walkrank_store"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["maker"], json.loads(self.options.get("arguments", "{}")), self.options["table"])


def read_store(spark: SparkSession, maker: str, table: str, **arguments: Any) -> DataFrame:
    """A table of a store; filters on its key go to the store."""
    if table not in SCHEMAS:
        raise ValueError(f"no table {table!r}: {', '.join(SCHEMAS)}")
    spark.dataSource.register(StoreSource)
    spark.conf.set(_PUSHED, "true")
    return spark.read.format(StoreSource.name()).option("maker", maker).option("arguments", json.dumps(arguments)).option("table", table).load()


def store_graph(spark: SparkSession, maker: str, edge_maker: str | None = None, **arguments: Any) -> Graph:
    """A graph whose vectors and edges come from stores, from one or from two."""
    return Graph.of(read_store(spark, maker, "nodes", **arguments), read_store(spark, edge_maker or maker, "edges", **arguments))


class ParquetStore:
    """Both stores over folders of Parquet files, one file a part: as an example, and for files that Spark's own readers don't see."""

    def __init__(self, nodes: str, edges: str):
        self.folder = {"nodes": nodes, "edges": edges}

    def _parts(self, table: str) -> list[str]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.folder[table])
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))

    def _batches(self, table: str, path: str, ids: set[int] | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder[table])
        names = [c.split(" ", 1)[0] for c in SCHEMAS[table].split(", ")]
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=names):
                batch = batch.select(names)
                yield batch if ids is None else batch.filter(pc.is_in(batch.column(KEYS[table]), pa.array(sorted(ids), pa.int64())))

    def node_parts(self) -> list[str]:
        return self._parts("nodes")

    def nodes(self, part: str, ids: set[int] | None) -> Iterator[pa.RecordBatch]:
        return self._batches("nodes", part, ids)

    def edge_parts(self) -> list[str]:
        return self._parts("edges")

    def edges(self, part: str, sources: set[int] | None) -> Iterator[pa.RecordBatch]:
        return self._batches("edges", part, sources)


_DATASETS: dict[str, Callable[..., Graph]] = {}


def register_dataset(name: str, load: Callable[..., Graph]) -> None:
    """Makes load(spark, **options) known by a name."""
    _DATASETS[name] = load


def load_dataset(spark: SparkSession, name: str, **options: Any) -> Graph:
    if name not in _DATASETS:
        raise ValueError(f"no dataset {name!r}: {', '.join(sorted(_DATASETS)) or 'none is registered'}")
    return _DATASETS[name](spark, **options)


register_dataset("parquet", lambda spark, nodes, edges: store_graph(spark, f"{__name__}:ParquetStore", nodes=nodes, edges=edges))


def neighbours(spark: SparkSession, maker: str, node_id: int, **arguments: Any) -> DataFrame:
    """(src, dst) of one node, which the store alone looks up."""
    return read_store(spark, maker, "edges", **arguments).where(F.col("src") == node_id)
