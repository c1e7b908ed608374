"""Tables kept between sessions: found by a key of settings and source files, visible only when whole."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.scratch import delete, file_system, shared_root

#: Raised when what the library keeps, or how it is computed, changes.
VERSION = 1
#: Setting that names the folder; else one in the folder of spark.checkpoint.dir.
FOLDER = "spark.walkrank.store"
_DONE = "_done-"


def source_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Changes when a file below the paths comes, goes, or has another size or time. Only the list of files is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    own = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count("*"), F.sum(own.cast("decimal(38,0)")), F.bit_xor(own)).first()
    return "|".join(map(str, row))


class Store:
    """A folder of kept tables.

    An entry is written as an attempt, and counts from when a marker names it:
    an empty file, so there is no half of it. An attempt that is lost is never
    seen; of two that end, both are whole and the first by name is read.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or spark.conf.get(FOLDER, None) or f"{shared_root(spark)}/walkrank-store").rstrip("/")

    def key(self, kind: str, settings: Mapping, paths: Sequence[str] = ()) -> str:
        """Settings are plain values: anything else, such as a function, is a TypeError."""
        told = json.dumps([VERSION, settings, sorted(paths)], sort_keys=True) + (source_state(self.spark, paths) if paths else "")
        return f"{kind}/{hashlib.sha256(told.encode()).hexdigest()[:24]}"

    def names(self, key: str) -> list[str]:
        """What stands under a kind or key."""
        path, files = file_system(self.spark, f"{self.folder}/{key}")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def find(self, key: str) -> str | None:
        """The folder of a whole entry."""
        done = [n for n in self.names(key) if n.startswith(_DONE)]
        return f"{self.folder}/{key}/{done[0].removeprefix(_DONE)}" if done else None

    def put(self, key: str, write: Callable[[str], None]) -> str:
        """Has an entry written to a new folder, then makes it visible."""
        name = uuid.uuid4().hex[:12]
        write(f"{self.folder}/{key}/{name}")
        path, files = file_system(self.spark, f"{self.folder}/{key}/{_DONE}{name}")
        files.create(path, False).close()
        return self.find(key)

    def entry(self, kind: str, settings: Mapping, paths: Sequence[str], write: Callable[[str], None]) -> str:
        """The folder of the entry for these settings and files, written if there is none."""
        key = self.key(kind, settings, paths)
        return self.find(key) or self.put(key, write)

    def tidy(self, kind: str, keep: Sequence[str] = ()) -> int:
        """Removes a kind's entries but those of the keys to keep, and attempts that were never finished; how many."""
        gone = 0
        path, files = file_system(self.spark, f"{self.folder}/{kind}")
        for status in files.listStatus(path) if files.exists(path) else []:
            key = f"{kind}/{status.getPath().getName()}"
            done = self.find(key)
            stays = {done.rsplit("/", 1)[1], _DONE + done.rsplit("/", 1)[1]} if key in keep and done else set()
            gone += not stays
            for name in [key] if not stays else [f"{key}/{n}" for n in self.names(key) if n not in stays]:
                delete(self.spark, f"{self.folder}/{name}")
        return gone


def write_buckets(frame: DataFrame, folder: str, name: str, n: int, *columns: str) -> None:
    """A table in n files of rows of equal hash, sorted, at <folder>/<name>-<n>: joins on the columns don't move its rows."""
    dealt = frame.repartition(n, *columns).sortWithinPartitions(*columns)
    table = f"walkrank_{name}_{uuid.uuid4().hex[:12]}"
    dealt.write.bucketBy(n, *columns).sortBy(*columns).format("parquet").option("path", f"{folder}/{name}-{n}").saveAsTable(table)
    frame.sparkSession.sql(f"DROP TABLE {table}")  # an external table: its files stay


def bucket_folder(spark: SparkSession, folder: str, name: str) -> tuple[str, str]:
    """Where a table in buckets is, and their number."""
    path, files = file_system(spark, folder)
    found = next(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().rsplit("-", 1)[0] == name)
    return f"{folder}/{found}", found.rsplit("-", 1)[1]


def read_buckets(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table as a session's catalogue has it, so that its buckets count."""
    own, n = bucket_folder(spark, folder, name)
    table = f"walkrank_{name}_{hashlib.sha256(own.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(own).schema.toDDL()
        by = ", ".join(columns)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{own}'")
    return spark.table(table)
