"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of an Arrow batch that a task sends to its Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Who owns the folders that this thread begins.
_owner: ContextVar[Folders | None] = ContextVar("walkrank_folders", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one is set in local mode, as in tests; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="walkrank-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The path, and what its files are reached with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, folder: str) -> None:
    path, files = file_system(spark, folder)
    files.delete(path, True)  # False if there is none


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB in this session, unless it names a size itself: several long texts or vectors don't meet in one."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every query that is formed and executed within go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Folders:
    """Owns the folders of intermediate tables that are begun within it, by this thread, and removes them at its end.

    What lazy results of such operators read goes with them, so results have
    to be written within. Owners nest; other threads have their own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self._token: Token | None = None

    def __enter__(self) -> Folders:
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._token)
        while self.paths:
            delete(self.spark, self.paths.pop())


class Scratch:
    """A folder of intermediate tables for one run of one operator.

    ``save`` writes a frame as Parquet and rereads it: later stages then start
    from shared files and outlive any executor. Shuffle files of the finished
    write are released at once, so disk use is that of the largest step. The
    folder stays until its owner, ``Folders``, ends; without one, with the
    shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if (owner := _owner.get()) is not None:
            owner.paths.append(self.path)

    def save(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        with released(self.spark):
            frame.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later frame reads."""
        for name in names:
            delete(self.spark, f"{self.path}/{name}")
